"""Sequence packing by non-negative least squares (operator 9).

A document's ids (tokenizer ids, then the end id) are cut into full windows of 2048, a
piece whose length is a multiple of 64, and a tail of under 64; in every other document (by
a hash) the middle piece is cut into powers of two times 64, which fit any gap, so that
even documents of one single length leave little padding. Of each length the pieces are
counted; these at most 2048 numbers are all that the driver sees. Combinations of up to four
multiples of 64 that fill a window, and of up to three tails that fill 64 (which then count as
a piece of 64), are enumerated; least squares gives how often to repeat each, rounded down;
what is left over is packed greedily, longest first. The plan is a table of intervals:
pieces of length L with ranks a..b go to sequences s.. at a fixed offset.

Ranks come without a global sort: pieces are numbered inside (length, bucket), and counts of
buckets are summed up, so a length that a third of all pieces share is spread over buckets.

Defined cases: null and empty texts are one piece, the end id alone; repeated rows are packed
each; an empty table gives no rows; other columns are ignored. Texts are tokenised whole.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.frames import stage
from ledgerwatch.llm.nnls import exact_plan, greedy_plan
from ledgerwatch.llm.words import BLANK, fold, slices, span_hashes, text_buffers

WINDOW, GRID = 2048, 64
FINE = 8  # largest fine piece, in units of GRID; a power of two
END_ID = 1
PIECES_PER_BUCKET = 500
MOST_BUCKETS = 4096
CACHED_PIECES = 2_000_000  # kept between batches of a task; a longer list starts anew
SLOT_BITS = 22


class PieceIds:
    """Tokenizer ids of text pieces, encoded once each and found again by their hash."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.closes = np.zeros(tokenizer.get_vocab_size() + 1, bool)  # ids that end a word
        self.closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)  # by the top bits of a hash; the first comer has it
        self.others: dict[int, int] = {}
        self.keys = np.zeros(1 << 16, np.uint64)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 17, np.uint32)
        self.known = self.used = 0

    def numbers(self, keys: np.ndarray, text_of) -> np.ndarray:
        """The number of each key; ``text_of(i)`` is the text of the i-th."""
        at = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot[at].astype(np.int64)
        miss = np.flatnonzero((out < 0) | (self.keys[out] != keys))
        if len(miss):
            values, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            found = [self.others.get(k, -1) for k in values.tolist()]
            new = [i for i, n in enumerate(found) if n < 0]
            base = self.known
            self._add(values[new], [text_of(int(miss[first[i]])) for i in new])
            for n, i in enumerate(new, base):
                found[i] = n
                place = int(values[i]) >> (64 - SLOT_BITS)
                if self.slot[place] < 0:
                    self.slot[place] = n
                else:
                    self.others[int(values[i])] = n
            out[miss] = np.array(found)[back]
        return out

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self._encode(texts)
        sizes = np.array([len(x) for x in ids], np.int64)
        self.keys, self.starts, self.sizes = (_room(x, self.known + len(keys)) for x in (self.keys, self.starts, self.sizes))
        self.flat = _room(self.flat, self.used + int(sizes.sum()))
        here = slice(self.known, self.known + len(keys))
        self.keys[here], self.sizes[here], self.starts[here] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + int(sizes.sum())] = np.fromiter((i for x in ids for i in x), np.uint32)
        self.known += len(keys)
        self.used += int(sizes.sum())

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Pieces of letters only are encoded many to a line, as their last ids tell them apart."""
        out: list[list[int] | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        lines = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        batch = lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        for line, ids in zip(lines, batch([" ".join(texts[i] for i in line) for line in lines]), strict=True):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(line):
                for i, a, b in zip(line, [0, *ends], ends, strict=False):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, batch([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


#: 0 white space, 1 ASCII letters, 2 ASCII punctuation but for ' < |, 4 all else
_CLASS = np.array([0 if BLANK[i] else 4 if i > 127 or chr(i) in "'<|" or chr(i).isdigit() or i < 32 or i == 127 else 1 if chr(i).isalpha() else 2 for i in range(256)], np.uint8)


def text_ids(column: pa.Array, known: PieceIds, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (each closed by ``end``), and the offsets of the texts.

    The tokenizer folds case, drops white space and never joins across it, nor an ASCII letter
    to ASCII punctuation; the pieces between such borders can be encoded singly.
    """
    data, offsets = text_buffers(column)
    body = data.tobytes()
    if b"<|" not in body:  # special tokens are told by their case
        data = fold(data)
    kind = _CLASS[data]
    solid = kind > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] + kind[:-1] == 3
    before, after = np.concatenate([[False], solid]), np.concatenate([solid, [False]])
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    row = np.searchsorted(offsets, starts, "right") - 1
    number = known.numbers(span_hashes(data, starts, ends), lambda i: body[starts[i] : ends[i]].decode("utf-8", "replace"))
    size = known.sizes[number]
    of = np.repeat(np.arange(len(size)), size)
    behind = np.cumsum(size) - size
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row, size, minlength=len(offsets) - 1).astype(np.int64) + 1)])
    out = np.full(int(cuts[-1]), end, "<u4")
    run = np.arange(len(of))
    out[run + row[of]] = known.flat[run + (known.starts[number] - behind)[of]]  # one end id per earlier text
    return out, cuts


def cut(n: int, finely: bool = False) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; ``finely``: the grid piece in powers of two up to 512."""
    full, rest = divmod(n, WINDOW)
    lengths = [WINDOW] * full
    grid = rest // GRID
    if finely:
        lengths += [GRID * FINE] * (grid // FINE) + [GRID << i for i in range(FINE.bit_length() - 2, -1, -1) if grid % FINE >> i & 1]
    elif grid:
        lengths.append(GRID * grid)
    if rest % GRID:
        lengths.append(rest % GRID)
    starts = np.cumsum([0, *lengths[:-1]]).tolist()
    return list(zip(starts, lengths, strict=True))


_KNOWN: dict[str, PieceIds] = {}  # of this Python worker, by tokenizer file: tasks that follow go on with it


def _known_pieces(tokenizer_file: str) -> PieceIds:
    if tokenizer_file not in _KNOWN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _KNOWN[tokenizer_file] = PieceIds(Tokenizer.from_file(tokenizer_file))
    return _KNOWN[tokenizer_file]


def pieces(docs: DataFrame, key: str, text: str, tokenizer_file: str) -> DataFrame:
    """One row per piece: key, row hash, start, length, checksum, ids of the document."""
    slim = docs.select(docs[key], F.xxhash64(docs[key], docs[text].cast("string")).alias("row"), docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known_pieces(tokenizer_file)
        for batch in batches:
            for a, b in slices(batch.column(2), 2 << 20):
                ids, cuts = text_ids(batch.column(2).slice(a, b - a), known)
                finely = (batch.column(1).slice(a, b - a).to_numpy() & 1).tolist()
                rows = []
                for i in range(b - a):
                    lo, n = int(cuts[i]), int(cuts[i + 1] - cuts[i])
                    rows += [(a + i, s, m, zlib.crc32(ids[lo + s : lo + s + m]), n) for s, m in cut(n, finely[i])]
                of, *numbers = zip(*rows, strict=True)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), *[pa.array(x, pa.int64()) for x in numbers]],
                    [key, "row", "start", "length", "ids_crc32", "doc_tokens"],
                )
                if known.known > CACHED_PIECES:
                    known.clear()

    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def plan_intervals(counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) for every piece counted.

    Sequences number on from 0. Ranks of a length start at 0.
    """
    full = counts.get(WINDOW, 0)
    tails = {x: n for x, n in counts.items() if x < GRID}
    tail_plan = exact_plan(tails, GRID, 3)
    blocks = sum(n for _, n in tail_plan)  # tails that together fill 64
    grid = Counter({x: n for x, n in counts.items() if GRID <= x < WINDOW})
    real = grid[GRID]
    grid[GRID] += blocks
    grid_plan = [(tuple(x * GRID for x in c), n) for c, n in exact_plan({x // GRID: n for x, n in grid.items() if n}, WINDOW // GRID, 4)]
    left = Counter(tails) + grid
    for combos in (tail_plan, grid_plan):
        for c, n in combos:
            for x in c:
                left[x] -= n
    out, used, sequence = [], defaultdict(int), 0
    if full:
        out.append((WINDOW, 0, full - 1, 0, 0))
        sequence = full
    for x in tails:  # their first ranks go into blocks
        used[x] = sum(n * c.count(x) for c, n in tail_plan)
    for c, n in [*grid_plan, *greedy_plan(left, WINDOW)]:
        offset = 0
        for x in c:
            out.append((x, used[x], used[x] + n - 1, sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    # ranks of length 64 from ``real`` on are blocks of tails: hand their places to the tails
    slots = [s for s in out if s[0] == GRID and s[2] >= real]
    out = [s if s[0] != GRID else (GRID, s[1], min(s[2], real - 1), s[3], s[4]) for s in out if s[0] != GRID or s[1] < real]
    block, ranks = real, defaultdict(int)
    for c, n in tail_plan:
        inner = 0
        for x in c:
            for _, first, last, seq, offset in slots:
                a, b = max(first, block), min(last, block + n - 1)
                if a <= b:
                    out.append((x, ranks[x] + a - block, ranks[x] + b - block, seq + a - first, offset + inner))
            ranks[x] += n
            inner += x
        block += n
    return out


def pack(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    table = stage(pieces(docs, key, text, tokenizer_file), "pieces")
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most 2048 rows
    buckets = max(1, min(MOST_BUCKETS, sum(counts.values()) // PIECES_PER_BUCKET))
    table = table.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "start")) - 1
    sizes = table.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = table.withColumn("local", local).join(before, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("before"))
    # lengths are at most 2048 and a length is in few combinations: the intervals are a small table
    intervals = spark.createDataFrame(plan_intervals(counts), "length bigint, first bigint, last bigint, seq bigint, offset bigint")
    found = ranked.join(F.broadcast(intervals), "length").where("rank between first and last")
    return found.select(
        F.col(f"`{key}`"), "start", "length", "ids_crc32", "doc_tokens", (F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
