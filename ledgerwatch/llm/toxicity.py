"""Toxicity by a weighted finite-state grammar (operator 8).

Words are mapped to the grammar's classes. Threats, targets, negations and verbs of saying are
short fixed lists; insults are a lexicon of words and word beginnings with log-odds weights,
learned from labelled texts (a few well-known insults start it). The composed grammar scores
clauses; the sum of a text's clause scores is mapped to a probability by a monotone table
fitted on labelled texts that the lexicon has not seen.

Labels: at most ``LABELLED`` rows of each kind among the training rows, those of least hash, are
used (that bounds what is broadcast: an id, a kind, a part). Every text is scored whole, from
its words alone. Copies among the labelled texts count once (same least shingle hash).

Defined cases: null, empty and blank texts get the score of a text without events; rows with
equal ids are scored each; several labels of one id count as their largest; without labels of
both kinds the start lexicon and a fixed table are used; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.frames import crc_mod, per_slice, stage
from ledgerwatch.llm.grammar import clause_score
from ledgerwatch.llm.words import NOT_ALNUM, Words, by_row, mix, slices, words_of

HELD_OUT_MOD, HELD_OUT = 4, 2
LABELLED = 10_000  # of each kind
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
LEAST_TEXTS = 5  # toxic texts that must hold a lexicon entry
LEAST_WEIGHT = 2.0
THRESHOLD = 0.3
BINS = 24
BIN_WIDTH = 2.0  # of clause score
STRONG = 8.0  # clause score of more than one event of fair weight

# start lexicon and class words
INSULTS = "idiot idiots moron morons stupid worthless scum loser losers pathetic disgusting imbecile trash clown".split()
START_WEIGHT = 3.0
CLASSES = {
    "H": "kill hurt destroy beat shoot stab burn punch töten schlagen tuer frapper matar golpear".split(),
    "Y": "you your yours yourself u he she him they them people du dich euch ihr sie tu toi vous vos te ti usted ustedes".split(),
    "N": "not no never neither without isn't aren't nicht kein keine nie pas jamais sans nunca sin".split(),
    "R": "said says say wrote writes quoted claims claimed told reported according sagte schrieb laut dit écrit selon dijo escribió según".split(),
}
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[list(b".!?;:\n")] = True


def _text_words(column: pa.Array) -> Words:
    return words_of(column, lower=True, blank=NOT_ALNUM)


def feature_keys(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, keys): whole words, then their beginnings of each length (longer words only)."""
    out = [(np.arange(len(w.starts)), w.hashes)]
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lead = np.zeros(len(w.starts), np.uint64)
    for i in range(max(BEGINNINGS)):
        lead |= data[w.starts + i].astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in BEGINNINGS:
            long = np.flatnonzero(w.ends - w.starts > i + 1)
            out.append((long, mix(lead[long] + (np.uint64(i + 1) << np.uint64(56)))))
    return out


def _one(words: list[str]) -> np.ndarray:
    return words_of(pa.array(words)).hashes


class Lexicon:
    """Classes and weights of words by key."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        known = dict(zip(keys.tolist(), weights.tolist(), strict=True))
        for k in _one(INSULTS).tolist():
            known.setdefault(k, START_WEIGHT)
        self.keys = np.array(sorted(known), np.uint64)
        self.weights = np.array([known[k] for k in self.keys.tolist()])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.classes = sorted((k, c) for c, words in CLASSES.items() for k in _one(words).tolist())
        self.class_keys = np.array([k for k, _ in self.classes], np.uint64)

    def _match(self, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def insult_weights(self, w: Words) -> np.ndarray:
        """Largest weight of any entry that is the word or begins it; 0 for none."""
        out = np.zeros(len(w.starts))
        for numbers, keys in feature_keys(w):
            maybe = np.flatnonzero(self.bits[(keys >> np.uint64(44)).astype(np.int64)])
            at = self._match(keys[maybe], self.keys)
            hit = at >= 0
            np.maximum.at(out, numbers[maybe[hit]], self.weights[at[hit]])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Summed clause scores of each text."""
        w = _text_words(column)
        out = np.zeros(w.n_rows)
        insults = self.insult_weights(w)
        classes = self._match(w.hashes, self.class_keys)
        threats = np.array([c == "H" for _, c in self.classes])[classes] & (classes >= 0)
        clause = np.cumsum(_CLAUSE_END[w.data])[w.starts] if len(w.starts) else np.zeros(0, np.int64)
        # only clauses that hold an insult or a threat can score
        place = w.rows.astype(np.int64) * (len(w.data) + 1) + clause
        worth = np.isin(place, place[(insults > 0) | threats])
        marked = np.flatnonzero(worth & ((insults > 0) | (classes >= 0)))
        if not len(marked):
            return out
        cuts = np.flatnonzero(np.diff(place[marked])) + 1
        for part in np.split(marked, cuts):
            out[w.rows[part[0]]] += clause_score(
                [(i, "I", insults[i]) if insults[i] > 0 else (i, self.classes[classes[i]][1], 1.0) for i in part.tolist()]
            )
        return out


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int) -> DataFrame:
    """text, toxic, part of the labelled training rows; at most ``bound`` labels of each kind."""
    kinds = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    kinds = kinds.where(crc_mod("_id", HELD_OUT_MOD) != HELD_OUT)
    order = F.xxhash64("_id", F.lit(11))
    few = kinds.where("toxic = 1").orderBy(order).limit(bound).union(kinds.where("toxic = 0").orderBy(order).limit(bound))
    few = few.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(10)).cast("int"))
    return docs.select(docs[key].alias("_id"), docs[text].cast("string").alias("text")).join(F.broadcast(few), "_id").select("text", "toxic", "part")


def _sketched(sample: DataFrame) -> DataFrame:
    """The sample with a sketch per text: near copies mostly share it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _text_words(batch.column(0))
        first, keys = w.windows(3)
        sketch = np.full(w.n_rows, 2**64 - 1, np.uint64)
        np.minimum.at(sketch, w.rows[first], mix(keys))
        blank = sketch == np.uint64(2**64 - 1)
        sketch[blank] = mix(np.arange(int(blank.sum())) + 1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch.view(np.int64))], ["text", "toxic", "part", "sketch"])

    return sample.mapInArrow(per_slice(work, "text"), "text string, toxic int, part int, sketch bigint")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """key, texts and toxic texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                w = _text_words(part.column(0))
                toxic = part.column(1).to_numpy()
                keys, rows = (np.concatenate(x) for x in zip(*[(k, w.rows[n]) for n, k in feature_keys(w)], strict=True))
                _, lead = np.unique(by_row(keys, rows), return_index=True)
                keys, rows = keys[lead], rows[lead]
                values, back = np.unique(keys, return_inverse=True)
                n, t = np.bincount(back), np.bincount(back, toxic[rows])
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n), pa.array(t.astype(np.int64))], ["key", "n", "toxic"])

    return sample.mapInArrow(run, "key bigint, n bigint, toxic bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def monotone(n: np.ndarray, positive: np.ndarray, prior: float, smooth: float = 1.0) -> np.ndarray:
    """Probabilities that do not fall from bin to bin: shares pooled where they fall.

    A bin without much evidence is drawn to the prior, from STRONG on to one half.
    """
    blocks: list[list[float]] = []
    for i in range(len(n)):
        blocks.append([positive[i], n[i], 1])
        while len(blocks) > 1 and blocks[-1][1] and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            p, m, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + m, blocks[-1][2] + k]
    out, low = [], 0.0
    for p, m, k in blocks:
        low = max(low, (p + smooth * (0.5 if len(out) > STRONG / BIN_WIDTH else prior)) / (m + smooth))
        out += [low] * int(k)
    return np.array(out)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and the probability of each score bin."""
    fallback = np.concatenate([[0.05], np.linspace(0.4, 0.95, BINS - 1)])
    sample = stage(_sketched(labelled_texts(docs, labels, key, text, label, bound)).dropDuplicates(["sketch"]), "labelled")
    kinds = {(r.toxic, r.late): r.n for r in sample.groupBy("toxic", (F.col("part") >= 7).alias("late")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = kinds.get((1, False), 0), kinds.get((0, False), 0)
    if not toxic or not clean:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0)), fallback
    counts = _feature_counts(sample.where("part < 7").select("text", "toxic"))
    share = lambda a, n: (F.col(a) + 0.5) / (n + 1.0)
    weight = F.log(share("toxic", toxic) / ((F.col("n") - F.col("toxic") + 0.5) / (clean + 1.0)))
    entries = counts.where(f"toxic >= {LEAST_TEXTS}").withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT).select("key", "weight").collect()
    lexicon = Lexicon(np.array([r.key for r in entries], np.int64).view(np.uint64), np.array([r.weight for r in entries], float))

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(score_bins(lexicon.scores(batch.column(0))))], ["toxic", "bin"])

    late = sample.where("part >= 7").select("text", "toxic").mapInArrow(per_slice(binned, "text"), "toxic int, bin bigint")
    # the sample has its own mix of kinds: each kind is weighed up to its share of all training labels
    all_kinds = labels.where(crc_mod(key, HELD_OUT_MOD) != HELD_OUT).agg(F.sum(F.col(label)), F.sum(1 - F.col(label))).first()
    drawn = {k: max(kinds.get((k, True), 0), 1) for k in (0, 1)}
    total = (all_kinds[0] or 0) + (all_kinds[1] or 0)
    size = drawn[0] + drawn[1]
    scale = {1: (all_kinds[0] or 0) / total * size / drawn[1], 0: (all_kinds[1] or 0) / total * size / drawn[0]}
    n, positive = np.zeros(BINS), np.zeros(BINS)
    for r in late.groupBy("toxic", "bin").agg(F.count("*").alias("n")).collect():  # at most 2 x BINS rows
        n[r.bin] += r.n * scale[r.toxic]
        positive[r.bin] += r.n * scale[r.toxic] * r.toxic
    if not n.sum():
        return lexicon, fallback
    return lexicon, monotone(n, positive, (all_kinds[0] or 0) / total)


def score_bins(scores: np.ndarray) -> np.ndarray:
    """0 without events, then one bin per BIN_WIDTH."""
    return np.where(scores <= 0, 0, np.minimum(1 + (scores / BIN_WIDTH).astype(np.int64), BINS - 1))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = LABELLED) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted, then the summed clause score."""
    lexicon, table = fit(docs, labels, key, text, label, bound)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clauses = lexicon.scores(batch.column(2))
        score = table[score_bins(clauses)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(clauses)],
            [key, "held_out", "score", "predicted", "clause_score"],
        )

    slim = docs.select(docs[key], (crc_mod(key, HELD_OUT_MOD) == HELD_OUT).alias("held_out"), docs[text].cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(per_slice(work, "_text"), f"`{key}` {kind}, held_out boolean, score double, predicted int, clause_score double")
