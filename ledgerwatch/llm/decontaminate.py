"""Benchmark decontamination (operator 3): BM25 retrieval with block-max WAND, then an overlap check.

Every training text is cut into passages of 64 words, one each 32 words, and every passage is
a query against an index of the test items. An item's question (all lines but the last, or its
only line), its answer (the last of several lines) and the whole are entries of their own, long
ones in pieces that overlap. All entries at or above ``SCORE`` of their own score are retrieved;
then question and answer are compared with the text around the passage on 3-word windows. An
item is leaked if the text holds ``LEAST_OVERLAP`` of the windows of the whole, of the question,
of the answer, or of a stretch of ``ENTRY_WORDS`` words of the whole, or ``RUN`` of its words on
end. Of a question shorter than ``SPECIFIC`` words all windows must be there; one shorter than
``LEAST_WORDS``, or an answer shorter than ``SPECIFIC``, says nothing alone.
Words are runs of letters and digits (and any non-ASCII character), A-Z folded.

Scale: texts are read once per shard of the index, without a shuffle. A shard holds at most
``SHARD_CHARS`` characters of items, which bounds what is sent to the executors; more items
make more shards, with the document frequencies of all items.

Defined cases: null and blank texts or items never match; an item of fewer than 3 words is
compared as a whole; rows with equal ids or texts are reported once per row; an empty table
on either side gives no rows; other columns are ignored or carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.frames import per_slice
from ledgerwatch.llm.wand import BlockMaxIndex, document_frequency
from ledgerwatch.llm.words import NOT_ALNUM, words_of

PASSAGE, STRIDE = 64, 32
ENTRY_WORDS = 48  # longer parts are indexed in pieces
PIECE, PIECE_STRIDE = 36, 12  # so that every run of RUN words is in one piece whole
RUN = 24
SPECIFIC = 8
LEAST_WORDS = 5
SCORE = 0.4
WINDOW = 3
LEAST_OVERLAP = 0.6
SHARD_CHARS = 16_000_000


def _hashes(texts: list[str]) -> list[np.ndarray]:
    w = words_of(pa.array(texts, pa.string()), lower=True, blank=NOT_ALNUM)
    cuts = np.searchsorted(w.rows, np.arange(len(texts) + 1))
    return [w.hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _windows(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the windows of a part; a shorter part is one window."""
    n = min(WINDOW, len(hashes))
    out = np.zeros(max(len(hashes) - n + 1, 0) if n else 0, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
    return out + np.uint64(n)


def question_and_answer(text: str) -> tuple[str, str]:
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return (" ".join(lines), "") if len(lines) < 2 else (" ".join(lines[:-1]), lines[-1])


class Reference:
    """Items of one shard: index entries and the windows of question and answer."""

    def __init__(self, ids: list, texts: list[str], terms: np.ndarray, frequency: np.ndarray, n_all: int, mean_length: float, score: float):
        self.ids = ids
        pairs = [question_and_answer(t) for t in texts]
        self.question, self.answer, self.ordered = [], [], []
        entries, self.part_of, least = [], [], []  # of each entry: item, part, words of the part
        for item, (q, a) in enumerate(zip(_hashes([p[0] for p in pairs]), _hashes([p[1] for p in pairs]), strict=True)):
            self.question.append(np.unique(_windows(q)))
            self.answer.append(np.unique(_windows(a)))
            self.ordered.append(_windows(np.concatenate([q, a])))
            for part, words in parts_of(q, a):
                for piece in entry_pieces(words):
                    entries.append(piece)
                    self.part_of.append((item, part, len(words)))
                    least.append(least_words(part, words))
        self.index = BlockMaxIndex(entries, terms, frequency, n_all, mean_length, score, least)

    def overlap(self, item: int, around: np.ndarray) -> tuple[float, float, float]:
        """Share of the windows of question, answer and both that the words ``around`` hold."""
        q, a = self.question[item], self.answer[item]
        held = {n: _windows_of(around, n) for n in {min(WINDOW, 1), 2, WINDOW}}
        n_q, n_a = (sum(np.isin(x, y).sum() for y in held.values()) for x in (q, a))
        whole = len(q) + len(a)
        return n_q / len(q) if len(q) else 0.0, n_a / len(a) if len(a) else 0.0, (n_q + n_a) / whole if whole else 0.0

    def leaked(self, entry: int, around: np.ndarray) -> tuple[float, float, float] | None:
        """The overlaps if the words ``around`` hold enough of the entry's part of the item."""
        item, part, n_words = self.part_of[entry]
        q, a, both = self.overlap(item, around)
        if part == WHOLE:
            good = both >= LEAST_OVERLAP or _stretch(np.isin(self.ordered[item], _windows_of(around, WINDOW)))
        else:
            good = (q if part == QUESTION else a) >= (LEAST_OVERLAP if n_words >= SPECIFIC else 1)
        return (q, a, both) if good else None


def _stretch(held: np.ndarray) -> bool:
    """Whether a run of RUN words, or LEAST_OVERLAP of the windows in some ENTRY_WORDS words, are held."""
    total = np.concatenate([[0], np.cumsum(held)])
    run, some = RUN - WINDOW + 1, ENTRY_WORDS - WINDOW + 1
    return len(held) >= run and (total[run:] - total[:-run]).max() == run or len(held) >= some and (total[some:] - total[:-some]).max() >= LEAST_OVERLAP * some


def _windows_of(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
    return out + np.uint64(n)


def entry_pieces(words: np.ndarray) -> list[np.ndarray]:
    """The words, or pieces of PIECE of them that overlap; the last ones end with the words."""
    if len(words) <= ENTRY_WORDS:
        return [words] if len(words) else []
    last = len(words) - PIECE
    return [words[i : i + PIECE] for i in [*range(0, last, PIECE_STRIDE), last]]


WHOLE, QUESTION, ANSWER = range(3)


def parts_of(question: np.ndarray, answer: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The parts of an item that are indexed: the whole, and of two parts each that can say something."""
    both = [(p, w) for p, w in ((QUESTION, question), (ANSWER, answer)) if len(w) >= (LEAST_WORDS if p == QUESTION else SPECIFIC)]
    return [(WHOLE, np.concatenate([question, answer])), *(both if len(question) and len(answer) else [])]


def least_words(part: int, words: np.ndarray) -> int:
    """How many words of a short question or answer a passage holds at least if it is leaked (0: no bound)."""
    if part == WHOLE or len(words) > PASSAGE // 4:
        return 0
    return len(words) if len(words) < SPECIFIC else math.ceil(LEAST_OVERLAP * len(np.unique(_windows(words)))) + WINDOW - 1


def leaks(column: pa.Array, ref: Reference) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(row, item, best score, question, answer and whole overlap) of the leaked items of each text."""
    w = words_of(column, lower=True, blank=NOT_ALNUM)
    first = np.searchsorted(w.rows, np.arange(w.n_rows + 1))
    n_words = np.diff(first)
    # passages are numbered through all rows; the last one of a text may be short
    n_passages = np.maximum(-(-np.maximum(n_words - (PASSAGE - STRIDE), 1) // STRIDE), 1)
    base = np.concatenate([[0], np.cumsum(n_passages)])
    term = ref.index.lookup(w.hashes)
    known = np.flatnonzero(term >= 0)
    step = (known - first[w.rows[known]]) // STRIDE
    here = np.minimum(step, n_passages[w.rows[known]] - 1)
    passage = np.concatenate([base[w.rows[known]] + here, base[w.rows[known]] + np.maximum(step - 1, 0)])
    best: dict[tuple[int, int], tuple] = {}
    for p in ref.index.candidates(passage, np.concatenate([term[known]] * 2)).tolist():
        row = int(np.searchsorted(base, p, "right")) - 1
        start = int(first[row]) + (p - int(base[row])) * STRIDE
        stop = min(start + PASSAGE, int(first[row + 1]))
        for entry, score in ref.index.search(term[start:stop]):
            item, _, reach = ref.part_of[entry]
            around = w.hashes[max(start - reach, int(first[row])) : min(stop + reach, int(first[row + 1]))]
            found = ref.leaked(entry, around)
            score *= ref.index.share[entry] / ref.index.threshold
            if found and (found[2], score) > best.get((row, item), (-1,))[:2]:
                best[row, item] = (found[2], score, *found[:2])
    for (row, item), (both, score, q, a) in sorted(best.items()):
        yield row, item, score, q, a, both


def reference_shards(items: DataFrame, item: str, text: str, score: float = SCORE) -> list[Reference]:
    """The index in shards of at most SHARD_CHARS characters (a longer item is a shard of its own).

    The driver reads the items one at a time; the test items are the small side by their nature.
    """
    rows = items.select(F.col(f"`{item}`").alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).orderBy("i", "t")
    shards, size = [], SHARD_CHARS + 1
    for r in rows.toLocalIterator():
        if size + len(r.t) > SHARD_CHARS:
            shards.append(([], []))
            size = 0
        shards[-1][0].append(r.i)
        shards[-1][1].append(r.t)
        size += len(r.t)
    pieces = [p for _, texts in shards for q, a in zip(*[_hashes([x[k] for x in map(question_and_answer, texts)]) for k in (0, 1)], strict=True) for _, words in parts_of(q, a) for p in entry_pieces(words)]
    terms, frequency = document_frequency(pieces)
    mean = float(np.mean([len(p) for p in pieces])) if pieces else 0.0
    return [Reference(ids, texts, terms, frequency, len(pieces), mean, score) for ids, texts in shards]


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and leaked item: key, item, score, question, answer and whole overlap."""
    slim = docs.select(docs[key], docs[text].cast("string").alias("_text"))
    kinds = slim.schema[0].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, score double, question_overlap double, answer_overlap double, overlap double"
    out = None
    for ref in reference_shards(items, item, item_text):

        def work(batch: pa.RecordBatch, ref: Reference = ref) -> pa.RecordBatch | None:
            found = list(leaks(batch.column(1), ref))
            if not found:
                return None
            rows, of, *numbers = zip(*found, strict=True)
            kind = pa.int64() if kinds[1] == "bigint" else None
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([ref.ids[i] for i in of], kind), *[pa.array(x, pa.float64()) for x in numbers]],
                [key, item, "score", "question_overlap", "answer_overlap", "overlap"],
            )

        part = slim.mapInArrow(per_slice(work, "_text"), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no leaked item, with all their columns."""
    for ref in reference_shards(items, item, item_text):

        def work(batch: pa.RecordBatch, ref: Reference = ref) -> pa.RecordBatch:
            stays = np.ones(batch.num_rows, bool)
            stays[[row for row, *_ in leaks(batch.column(batch.schema.get_field_index(text)), ref)]] = False
            return batch.filter(pa.array(stays))

        docs = docs.mapInArrow(per_slice(work, text), docs.schema)
    return docs
