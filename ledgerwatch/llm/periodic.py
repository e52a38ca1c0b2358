"""Periodic runs of words (operator 12): stretches in which a group of words comes again and again.

A run is a longest stretch of words that repeats with a smallest period q, of at least 2 q and
at least ``LEAST`` words. Method: scale-tiled distribution.

* **Explode.** For each octave of periods B..2B-1 a text is cut into tiles of ``TILE`` words or
  four octaves, whichever is more, each overlapping the next by 2 B places, so that whatever
  part of a run is too short to be told in one tile lies whole in its neighbour. Periods below 8 are one octave.
* **Solve.** In a tile stands a boundary every B words. A word equal to the one q further
  starts a stretch of equal places; a run of period q has q of them or more in a row, so one
  boundary lies among them. The boundary's two Z-functions, of what follows it and (backwards)
  of what is before it, tell for every q of the octave how far the stretch goes on; both stop at
  the tile's ends. Places with too few equal neighbours are dropped word by word, the others measured by
  bisection on prefix sums modulo two primes. Periods that are multiples of a smaller one
  are dropped in the tile: the first two periods show it. So a text of one word over and over
  gives one fragment a tile, and work is n log^2 n for any text.
* **Shuffle and stitch.** Fragments are dealt by (document, period); those that meet or
  overlap are one run. Only fragments, and words of texts that have some, are shuffled.

Tiles are solved in the task that reads the text, many at once, with arrays bounded by ``PAIRS``.

Defined cases: null and blank texts have no words and no runs; rows are told apart by a number
of their own, so repeated rows and rows with equal or null keys give one result each; an empty table gives no
rows; other columns are left out. Texts are read whole; a row of over 4 MB is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.frames import stage
from ledgerwatch.llm.words import slices, words_of

LEAST = 12  # words of a run
TILE = 4096  # words of a tile, at least
BASE = 8  # periods below are one octave
PAIRS = 1 << 20  # (boundary, period) pairs compared at a time
LONG_WORD = 256  # bytes; longer words get a cryptographic hash
PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1640531527)

FRAGMENTS = "array<struct<period:bigint,start:bigint,stop:bigint>>"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of texts, one after another, and the texts' offsets among them."""
    w = words_of(column)
    ids = w.hashes.copy()
    for i in np.flatnonzero(w.ends - w.starts > LONG_WORD):
        ids[i] = int.from_bytes(hashlib.blake2b(w.data[w.starts[i] : w.ends[i]].tobytes(), digest_size=8).digest(), "little")
    return ids, np.concatenate([[0], np.cumsum(w.per_row())]).astype(np.int64)


class Equal:
    """Equality of stretches of ids by prefix sums modulo two primes; nothing of a text's make-up can turn them against it."""

    def __init__(self, ids: np.ndarray, furthest: int):
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, _BASES, strict=True):
            power = np.ones(1, np.int64)
            n = max(len(ids), furthest) + 1
            while len(power) < n:
                power = np.concatenate([power, power * pow(base, len(power), prime) % prime])[:n]
            value = (ids % np.uint64(prime)).astype(np.int64)
            before = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(value * power[: len(ids)] % prime, out=before[1:])  # below 2^31 a word
            self.sums.append(before % prime)
            self.powers.append(power)

    def __call__(self, a: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` ids from ``a`` on equal those ``shift`` further."""
        out = np.ones(len(a), bool)
        for prime, s, power in zip(PRIMES, self.sums, self.powers, strict=True):
            out &= (s[a + length] - s[a]) % prime * power[shift] % prime == (s[a + shift + length] - s[a + shift]) % prime
        return out

    def forward(self, a: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Z-function after a boundary: how many ids from ``a`` on equal those ``shift`` further, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self(a, shift, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def backward(self, a: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Z-function before a boundary: how many ids just before ``a`` equal those ``shift`` further, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self(a - middle, shift, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def tiles(offsets: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of every tile of an octave (its least period), over all texts long enough."""
    size = np.diff(offsets)
    least, most = (1, BASE - 1) if octave < BASE else (octave, 2 * octave - 1)
    core, overlap = max(TILE, 4 * octave), max(2 * octave, 2 * BASE)
    rows = np.flatnonzero(size >= max(LEAST, 2 * least))
    count = np.maximum(1, -((least - size[rows]) // core))  # the last one holds a pair at least
    row = np.repeat(rows, count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[row] + number * core
    return row, first, np.minimum(offsets[row + 1], first + core + overlap + most)


@lru_cache(1 << 16)
def parts(period: int) -> tuple[int, ...]:
    """The period over each of its prime factors."""
    out, rest, p = [], period, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(period // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, period // rest) if rest > 1 else tuple(out)


def solve(ids: np.ndarray, equal: Equal, row: np.ndarray, first: np.ndarray, end: np.ndarray, octave: int) -> np.ndarray:
    """Fragments in the tiles of an octave: columns row, period, first equal place, end of equal places."""
    periods = np.arange(1, BASE) if octave < BASE else np.arange(octave, 2 * octave)
    step = BASE // 2 if octave < BASE else octave
    count = np.maximum(0, -((first + periods[0] - end) // step))  # boundaries with an equal place to come
    tile = np.repeat(np.arange(len(row)), count)
    at = first[tile] + step * (np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count))
    need = np.maximum(periods, LEAST - periods)
    found = []
    chunk = max(1, PAIRS // len(periods))
    last = len(ids) - 1
    for i in range(0, len(at), chunk):
        c, t = at[i : i + chunk], tile[i : i + chunk]
        there = c[:, None] + periods
        b, k = np.nonzero((ids[np.minimum(there, last)] == ids[c][:, None]) & (there < end[t][:, None]))
        if not len(b):
            continue
        c, t, q, m = c[b], t[b], periods[k], need[k]
        # cheap first: equal neighbours, word by word, up to half the base on either side
        after, before = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
        for j in range(1, BASE - 2):
            ok = np.flatnonzero((after == j) & (c + q + j < end[t]))
            after[ok[ids[c[ok] + j] == ids[c[ok] + q[ok] + j]]] += 1
            ok = np.flatnonzero((before == j - 1) & (c - j >= first[t]))
            before[ok[ids[c[ok] - j] == ids[c[ok] + q[ok] - j]]] += 1
        near = np.flatnonzero(after + before >= BASE - 2)
        c, t, q, m = c[near], t[near], q[near], m[near]
        after = equal.forward(c, q, end[t] - q - c)
        before = equal.backward(c, q, c - first[t])
        long = np.flatnonzero(after + before >= m)
        found.append(np.stack([t[long], q[long], c[long] - before[long], c[long] + after[long]], axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    out = np.unique(np.concatenate(found), axis=0)  # several boundaries lie in one stretch
    primitive = np.ones(len(out), bool)
    check = [(i, d) for i, q in enumerate(out[:, 1].tolist()) for d in parts(q)]
    if check:
        i, d = np.array(check).T
        primitive[i[equal(out[i, 2], d, 2 * out[i, 1] - d)]] = False
    out = out[primitive]
    out[:, 0] = row[out[:, 0]]
    return out


def fragments(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the fragments of runs in all tiles: columns row, period, start, stop (of equal places, in the text)."""
    ids, offsets = word_ids(column)
    size = np.diff(offsets)
    longest = int(size.max(initial=0))
    equal, found, octave = None, [np.zeros((0, 4), np.int64)], 1
    while longest >= max(LEAST, 2 * octave):
        equal = equal or Equal(ids, longest)
        found.append(solve(ids, equal, *tiles(offsets, octave), octave))
        octave = BASE if octave < BASE else 2 * octave
    out = np.concatenate(found)
    out[:, 2:] -= offsets[out[:, 0], None]
    return size, out


def explode_and_solve(docs: DataFrame, key: str, text: str, order: Callable[[object, int], np.ndarray | None] | None) -> DataFrame:
    """row, key, n_words, fragments; words (joined by one space) where there are fragments, else the digest of the words."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs[key], docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                keys, plain = part.column(1).to_pylist() if order else [None] * (b - a), []
                for k, body in zip(keys, part.column(2).cast(pa.binary()).fill_null(b"").to_pylist(), strict=True):
                    words = body.split()  # at just the bytes 20 and 09 to 0D
                    if order is not None and (chosen := order(k, len(words))) is not None:
                        words = [words[i] for i in chosen.tolist()]
                    plain.append(b" ".join(words))
                texts = pa.array(plain, pa.binary()).view(pa.string())
                size, found = fragments(texts)
                found = found[np.argsort(found[:, 0], kind="stable")]
                cuts = np.searchsorted(found[:, 0], np.arange(len(plain) + 1)).astype(np.int32)
                some = np.diff(cuts) > 0
                rows = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["period", "start", "stop"])
                digest = [None if s else hashlib.sha256(x).hexdigest() for s, x in zip(some.tolist(), plain, strict=True)]
                kept = [x if s else None for s, x in zip(some.tolist(), plain, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), rows), pa.array(kept, pa.binary()).view(pa.string()), pa.array(digest, pa.string())],
                    ["row", key, "n_words", "fragments", "words", "digest"],
                )

    kind = slim.schema[1].dataType.simpleString()
    return slim.mapInArrow(run, f"row bigint, `{key}` {kind}, n_words bigint, fragments {FRAGMENTS}, words string, digest string")


def stitch(solved: DataFrame) -> DataFrame:
    """row, start, length, period of every run: fragments of one document and period that meet or overlap are one."""
    each = solved.select("row", F.inline("fragments"))
    w = Window.partitionBy("row", "period").orderBy("start", "stop")
    reached = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("fresh", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    each = each.withColumn("number", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = each.groupBy("row", "period", "number").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return one.select("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per row: key, n_words, runs (by start, then period), collapsed, collapsed_sha256.

    ``collapsed`` is the text without the repeated parts of its runs, its words joined by one
    space; null where no run was found, when it is the text's own words. The digest is of that
    text in both cases. ``order`` (key, number of words) may give the numbers in which words are read.
    """
    solved = stage(explode_and_solve(docs, key, text, order), "solved")
    some = solved.where("digest is null")
    runs = stitch(some).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))  # of one text
    found = some.select("row", F.col(f"`{key}`"), "n_words", "words").join(runs, "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                out = [collapsed(t.split(b" "), [(r["start"], r["length"], r["period"]) for r in rs]) for t, rs in zip(texts, part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(out, pa.binary()).view(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in out])],
                    [key, "n_words", "runs", "collapsed", "collapsed_sha256"],
                )

    kind = found.schema[0].dataType.simpleString()
    cut = found.mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs {RUNS}, collapsed string, collapsed_sha256 string")
    whole = solved.where("digest is not null").select(
        F.col(f"`{key}`"), "n_words", F.expr(f"cast(array() as {RUNS})").alias("runs"), F.expr("cast(null as string)").alias("collapsed"), F.col("digest").alias("collapsed_sha256")
    )
    return cut.unionByName(whole)
