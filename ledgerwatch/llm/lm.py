"""Language-model scoring with a subword lattice (operator 5).

Tokens are words (A-Z folded) and one end per text. The lattice of a word holds every
segmentation into pieces of an existing subword vocabulary; the pieces' scores start from the
vocabulary's ranks and are fitted on the words of the training texts by expected counts, each
different word once. Over each word seen in training lies one more arc, the word itself.
With absolute discounting (D from the numbers of words seen once and twice)

    P(word) = max(c - D, 0) / N  +  (D V / N) * P(word in the lattice)

so probabilities of all words and the end sum to one. ``score`` is the log10 probability of
the text; ``base_score`` is the add-one unigram score of the same tokens.

Scale: texts are dealt to chunks of some 24 MB; a chunk lists its different words once, so
that words, not tokens, are shuffled. A word's counts meet in a window over its hash (one row
per chunk, whatever its frequency), the lattice works once per different word, and chunks
take their values back. Driver and broadcasts hold piece scores only (the vocabulary's size).

Defined cases: a null or blank text is the end alone; a null id has the crc32 of an empty
text; rows with equal ids are scored each; without training rows c, N and V are 0 and the
lattice keeps its initial scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.frames import crc_mod, stage
from ledgerwatch.llm.lattice import Vocabulary, expected_counts, log_probabilities
from ledgerwatch.llm.words import slices, words_of

HELD_OUT_MOD, HELD_OUT = 7, 2
CHUNK_BYTES = 24_000_000
LEAST_CHUNKS = 18
ROUNDS = 2  # passes of expected counts
SMOOTH = 0.01  # added to every piece count
WORDS_AT_ONCE = 50_000
LOG10 = float(np.log(10))

_VOCABULARY: dict[str, Vocabulary] = {}  # of this Python worker, by file


def vocabulary(file: str) -> Vocabulary:
    if file not in _VOCABULARY:
        _VOCABULARY[file] = Vocabulary.load(file)
    return _VOCABULARY[file]


def chunk_words(docs: DataFrame) -> DataFrame:
    """chunk, key (word hash), word, n (uses in training rows) of every different word of a chunk.

    ``docs`` has chunk, id, held, text and is partitioned by chunk. A chunk that arrives in
    several batches may list a word more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for chunk in np.unique(chunks).tolist():
                part = batch.filter(pa.array(chunks == chunk))
                for a, b in slices(part.column(3), 1 << 20):
                    w = words_of(part.column(3).slice(a, b - a), lower=True)
                    train = ~part.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                    keys, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                    n = np.bincount(back, train[w.rows], minlength=len(keys)).astype(np.int64)
                    waiting.setdefault(chunk, []).append((keys, n, _spans(w.data, w.starts[first], w.ends[first])))
        for chunk, parts in waiting.items():
            keys = np.concatenate([p[0] for p in parts])
            keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
            words = pa.chunked_array([p[2] for p in parts]).take(pa.array(first)).combine_chunks()
            for a in range(0, len(keys), WORDS_AT_ONCE):
                at = slice(a, a + WORDS_AT_ONCE)
                columns = [np.full(len(keys[at]), chunk, np.int32), keys[at].view(np.int64), words[at], n[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "key", "word", "n"])

    return docs.mapInArrow(run, "chunk int, key bigint, word string, n bigint")


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string array of byte spans."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    body = pa.py_buffer(data[at].tobytes())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32).tobytes()), body)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to tables of at least WORDS_AT_ONCE rows."""
    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(parts)
            parts, n = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


def fit_pieces(words: DataFrame, file: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log piece scores from different words, each counted once."""
    scores = vocabulary(file).start
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], scores: np.ndarray = scores) -> Iterator[pa.RecordBatch]:
            v = vocabulary(file)
            total = np.zeros(v.size)
            for table in _gathered(batches):
                total += expected_counts(table.column(0).to_pylist(), np.ones(table.num_rows), v, scores)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        rows = words.select("word").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.full(len(scores), SMOOTH)
        for r in rows:
            total[r.piece] += r.n
        scores = np.log(total / total.sum())
    return scores


def word_values(words: DataFrame, file: str, scores: np.ndarray) -> DataFrame:
    """chunk, key, c, lattice (natural log) per row of ``words``; equal neighbours are worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file)
        for table in _gathered(batches):
            keys = table.column("key").to_numpy()
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            value = log_probabilities(table.column("word").take(pa.array(first)).to_pylist(), v, scores)[back]
            columns = [table.column(c).combine_chunks() for c in ("chunk", "key", "c")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value.astype(np.float32))], ["chunk", "key", "c", "lattice"])

    return words.select("chunk", "key", "word", "c").mapInArrow(run, "chunk int, key bigint, c bigint, lattice float")


def score_texts(docs: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    slim = docs.select(docs[key].alias("id"), (crc_mod(key, HELD_OUT_MOD) == HELD_OUT).alias("held"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held"), 1).otherwise(0))).first()
    chunks, train_rows = max(LEAST_CHUNKS, (size[0] or 0) // CHUNK_BYTES), size[1] or 0
    slim = slim.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "id", "held", "text")

    found = chunk_words(slim.repartition(chunks, "chunk"))
    same = Window.partitionBy("key")
    counted = found.withColumns({"c": F.sum("n").over(same), "lead": F.min("chunk").over(same) == F.col("chunk")})
    words = stage(counted.select("chunk", "key", "word", "c", "lead"), "words")
    seen = words.where("lead and c > 0")
    total = seen.agg(F.count("*"), F.sum("c"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)), F.sum(F.when(F.col("c") == 2, 1).otherwise(0))).first()
    types, tokens, once, twice = (x or 0 for x in total)
    types, tokens = types + (train_rows > 0), tokens + train_rows  # the end is a token
    discount = once / (once + 2 * twice) if once else 0.5
    scores = fit_pieces(seen, vocabulary_file)
    values = word_values(words, vocabulary_file, scores)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, keys = left.combine_chunks(), right.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, c = keys[order], right.column("c").to_numpy()[order]
        base = np.log10((c + 1) / (tokens + types + 1))
        spread = discount * types / tokens if tokens else 1.0
        arc = np.maximum(c - discount, 0) / max(tokens, 1)
        with np.errstate(divide="ignore"):
            log = np.logaddexp(np.log(arc), np.log(spread) + right.column("lattice").to_numpy()[order].astype(np.float64)) / LOG10
        end = max(train_rows - discount, 0) / max(tokens, 1) or 1.0
        end_base, end_log = np.log10((train_rows + 1) / (tokens + types + 1)), np.log10(end)
        out = []
        texts = left.column("text").combine_chunks()
        for a, b in slices(texts, 1 << 20):
            w = words_of(texts.slice(a, b - a), lower=True)
            at = np.searchsorted(keys, w.hashes)
            n = w.per_row().astype(np.int64)
            known = w.per_row(c[at] > 0).astype(np.int64) + (train_rows > 0)
            out.append((n + 1, known, w.per_row(base[at]) + end_base, w.per_row(log[at]) + end_log))
        n, known, base_score, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table(
            [left.column("id"), left.column("held"), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base_score), pa.array(score)],
            [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = slim.schema["id"].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    # a chunk of blank texts has no words: outer on that side
    return slim.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(lambda left, right: run(left, right) if left.num_rows else _none(schema, left, key), schema)


def _none(schema: str, left: pa.Table, key: str) -> pa.Table:
    kinds = [left.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array([], k) for k in kinds], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
