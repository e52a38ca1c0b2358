"""Near-duplicate classes by DartMinHash signatures and a banded join (operator 10).

Texts are compared by their sets (or counts) of five-word shingles, A-Z folded. Two texts
of similarity 0.8 or more share at least one of 24 bands of 5 coordinates except with
probability (1 - 0.8^5)^24 = 7e-5, less above.

1. Equal texts form a class; one signature per class goes on (map-side combined, so a
   text that is a third of all rows is no hot key).
2. Band rows are grouped into buckets. No bucket is expanded into its pairs: every member
   meets the bucket's representative, and pairs that pass a size bound and a one-bit sketch
   are verified on their exact shingles.
3. Verified links give components (labels spread to neighbours and jump, each step written
   to the shared folder).
4. Members of a bucket that ended up in different components meet further representatives,
   more in each round, until every pair of the bucket in different components has been looked
   at. So the bucket's links are whole without listing pairs of one class. A bucket's members are
   dealt into blocks, each one row, and its representatives copied to each, so no task gets a whole
   bucket and the join needs no dealing anew. When the copies for all that is left are few, the round is the last.

Defined cases: a text without words (null, empty, blank) has no shingles, is nobody's
near copy and, if equal texts repeat, each row stands alone; rows with equal ids or texts
are members of one class; an empty table gives no rows; other columns are ignored. A null
id stays null; the class id is the least id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.darts import signatures
from ledgerwatch.llm.frames import fresh, per_slice, stage
from ledgerwatch.llm.words import by_row, mix, repeated, words_of

SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5
#: of 120 one-bit coordinates two texts of similarity 0.8 agree in 108 on average (deviation 3.3)
LEAST_BITS = 95
PAIRS_PER_SALT = 500
BLOCK = 300  # members of a bucket that meet its representatives in one task
FIRST_SHARE, GROWTH = 32, 16  # representatives of a bucket in the first round, and how many times as many in the next
FINISH = 20_000  # copies of representatives, over all tasks: where all that is left makes no more, the round is the last
#: longer sketches: texts of similarity 0.8 agree in 864 of 960 bits on average (deviation 9.3)
LONG, LEAST_LONG = 960, 824

SHINGLE = 5


def shingles(column: pa.Array, n: int = SHINGLE, weight: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and weight of every distinct word shingle of each text.

    A-Z are folded. A text of fewer than ``n`` words is one shingle. ``weight`` is ``set``
    (every shingle counts 1) or ``count`` (its number of occurrences).
    """
    w = words_of(column, lower=True)
    first, keys = w.windows(n)
    rows = w.rows[first]
    per_row = w.per_row()
    short = np.flatnonzero((per_row > 0) & (per_row < n))
    if len(short):
        lead = np.searchsorted(w.rows, short)
        whole = np.array([hash_words(w.hashes[a : a + c]) for a, c in zip(lead, per_row[short], strict=True)], np.uint64)
        rows, keys = np.concatenate([rows, short]), np.concatenate([keys, whole])
        order = np.argsort(rows, kind="stable")
        rows, keys = rows[order], keys[order]
    weights = np.ones(len(keys))
    own = by_row(keys, rows)
    twice = np.flatnonzero(repeated(own))
    if len(twice):
        _, lead, count = np.unique(own[twice], return_index=True, return_counts=True)
        drop = np.ones(len(twice), bool)
        drop[lead] = False
        if weight == "count":
            weights[twice[lead]] = count
        keep = np.ones(len(keys), bool)
        keep[twice[drop]] = False
        rows, keys, weights = rows[keep], keys[keep], weights[keep]
    return rows, keys, weights


def hash_words(hashes: np.ndarray) -> np.uint64:
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * np.uint64(0x9E3779B97F4A7C15) + h
    return out


def band_rows(column: pa.Array, bands: int, rows_per_band: int, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size (or weight), band keys and a one-bit-per-coordinate sketch (two longs) of each text."""
    rows, keys, weights = shingles(column, weight=weight)
    n, k = len(column), bands * rows_per_band
    sig = signatures(rows, keys, weights, n, k)
    size = np.bincount(rows, weights, minlength=n).astype(np.int64)
    band = np.full((n, bands), 0, np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for c in range(rows_per_band):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, c::rows_per_band])
    bits = np.zeros((n, 128), np.uint8)
    bits[:, : min(k, 128)] = (mix(sig[:, :128]) >> np.uint64(17)).astype(np.uint8) & 1
    return size, band.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def text_signatures(docs: DataFrame, bands: int, rows_per_band: int, weight: str) -> DataFrame:
    """``docs`` has id, h1, h2, text; texts become size, bands and sketch; texts without words fall out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, band, bits = band_rows(batch.column(3), bands, rows_per_band, weight)
        out = pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(size), pa.array(list(band), pa.list_(pa.int64())), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
            ["id", "h1", "h2", "size", "bands", "b1", "b2"],
        )
        return out.filter(pa.array(size > 0))

    kind = docs.schema[0].dataType.simpleString()
    schema = f"id {kind}, h1 bigint, h2 bigint, size bigint, bands array<bigint>, b1 bigint, b2 bigint"
    return docs.mapInArrow(per_slice(work, "text", 2 << 20), schema)


def shingle_sets(texts: DataFrame, weight: str) -> DataFrame:
    """``texts`` has node, text, bands; gives node, shingle keys (sorted), their weights for counts, and bands."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys, weights = shingles(batch.column(1), weight=weight)
        order = np.lexsort((keys, rows))
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))
        columns = [batch.column(0), lists(keys[order].view(np.int64)), lists(weights[order].astype(np.int32)), batch.column(2)]
        return pa.RecordBatch.from_arrays(columns, ["node", "keys", "counts", "bands"])

    return texts.mapInArrow(per_slice(work, "text", 2 << 20), "node bigint, keys array<bigint>, counts array<int>, bands array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, weight: str) -> DataFrame:
    """The pairs (a, b, other columns) whose exact weighted Jaccard similarity reaches ``similarity``.

    A node that is in very many pairs is salted: its set is repeated once per 500 pairs.
    """
    load = pairs.groupBy("b").agg((F.floor(F.count("*") / PAIRS_PER_SALT) + 1).cast("int").alias("salts"))
    right = (
        load.join(sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("cb")), "b")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    )
    left = (
        pairs.join(load, "b")
        .withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
        .join(sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("ca")), "a")
    )
    both = left.join(right, ["b", "salt"])
    if weight == "set":
        common, total = F.size(F.array_intersect("ka", "kb")), F.size("ka") + F.size("kb")
    else:
        total_of = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
        in_b = F.map_from_arrays("kb", "cb")
        shared = F.zip_with("ka", "ca", lambda k, n: F.least(n, F.coalesce(F.element_at(in_b, k), F.lit(0))))
        common, total = total_of(shared), total_of(F.col("ca")) + total_of(F.col("cb"))
    return both.withColumn("common", common).withColumn("total", total).where(
        F.col("common") >= similarity * (F.col("total") - F.col("common"))
    ).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of ``links`` (a, b).

    Each step takes the least label among neighbours, then the label of that label, so the
    number of steps grows with the logarithm of a component's width. ``links`` is read in each
    step, so it should be stored; repeated links are as good as one.
    """
    edges = links.union(links.select("b", "a")).toDF("node", "other")
    label = edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    while True:
        around = edges.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = label.join(around, "node").select("node", F.least("label", "near").alias("new"), "label")
        jump = label.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = stage(step.join(jump, "new").select("node", F.least("new", "far").alias("new"), "label"), "labels")
        label = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return label


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with labels replaced where ``merged`` (node, label) knows a smaller one."""
    return rows.join(merged.toDF("label", "_less"), "label", "left").withColumn("label", F.coalesce("_less", "label")).drop("_less")


def _close(similarity: float):
    """Whether sizes and sketches of a member and a representative leave the pair possible."""
    differ = F.bit_count(F.col("b1").bitwiseXOR(F.col("rep_b1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("rep_b2")))
    bound = F.least("size", "rep_size") >= similarity * F.greatest("size", "rep_size")
    return bound & (differ <= BANDS * BAND_ROWS - LEAST_BITS)


def text_classes(base: DataFrame, weight: str = "set", similarity: float = SIMILARITY) -> DataFrame:
    """Classes of equal texts and their components: node, h1, h2, copy_id, n_copies, label.

    ``base`` has id, h1, h2 (two hashes of the text) and text.
    """
    sig = text_signatures(base, BANDS, BAND_ROWS, weight)
    first = lambda c: F.first(c).alias(c)  # noqa: E731 - equal texts have equal signatures
    nodes = stage(
        sig.groupBy("h1", "h2").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"), *map(first, ["size", "bands", "b1", "b2"]))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    rows = nodes.select("node", "size", "b1", "b2", F.explode("bands").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("node").alias("rep"), F.min_by(F.struct("size", "b1", "b2"), "node").alias("r"), F.count("*").alias("members")).where("members > 1")
    rows = stage(
        rows.join(heads.select("bucket", "members", "rep", F.col("r.size").alias("rep_size"), F.col("r.b1").alias("rep_b1"), F.col("r.b2").alias("rep_b2")), "bucket"),
        "buckets",
    )
    pairs = rows.where((F.col("node") != F.col("rep")) & _close(similarity)).select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = stage(pairs, "pairs")
    texts = _texts(base, nodes, rows.select("node").distinct())
    sets = stage(shingle_sets(texts, weight), "sets")
    links = stage(verified(pairs, sets, similarity, weight), "links")
    label = rows.select("node").distinct().join(components(links), "node", "left")
    label = stage(label.select("node", F.coalesce("label", "node").alias("label")), "components")
    label = _remaining(rows, sets, label, similarity, weight)
    return nodes.select("node", "h1", "h2", "copy_id", "n_copies").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = docs[text].cast("string")
    return docs.select(docs[key].alias("id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"), body.alias("text"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", weight: str = "set", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: key, class_id (least key of its near-duplicate class),
    copy_id (least key among equal texts), n_copies (rows of equal text).

    Rows without words have their own key as class_id and copy_id.
    """
    base = _hashed(docs, key, text)
    classes = text_classes(base, weight, similarity)
    least = classes.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    classes = classes.join(least, "label").select("h1", "h2", "class_id", "copy_id", "n_copies")
    return base.drop("text").join(classes, ["h1", "h2"], "left").select(
        F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate class, with all columns: the one of least key (null last), then text hash.

    Rows without words all stay; of rows with equal key and text in a class one stays.
    """
    classes = text_classes(_hashed(docs, key, text), "set", similarity)
    first = F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "h1", "h2"))
    stay = classes.groupBy("label").agg(first.alias("s")).select(F.col("s.copy_id").alias("id"), F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"))
    h1, h2, wordy = (fresh(docs, c) for c in ("_h1", "_h2", "_wordy"))
    body = F.col(f"`{text}`").cast("string")
    marked = docs.withColumns({h1: F.xxhash64(body), h2: F.xxhash64(F.lit(7), body), wordy: F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    wanted = stay.toDF("_sid", "_s1", "_s2")
    kept = marked.where(F.col(wordy)).join(wanted, F.col(f"`{key}`").eqNullSafe(F.col("_sid")) & (F.col(h1) == F.col("_s1")) & (F.col(h2) == F.col("_s2")), "left_semi")
    once = kept.dropDuplicates([key, h1, h2])
    return once.unionByName(marked.where(~F.col(wordy))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _texts(base: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text and bands of the wanted nodes: the row with the class's least id, once."""
    ids = nodes.join(wanted, "node").select("node", "h1", "h2", F.col("copy_id").alias("id"), "bands")
    found = base.join(ids, (base.h1 == ids.h1) & (base.h2 == ids.h2) & base.id.eqNullSafe(ids.id)).select("node", "text", "bands")
    return found.groupBy("node").agg(F.first("text").alias("text"), F.first("bands").alias("bands"))


def long_sketches(sets: DataFrame) -> DataFrame:
    """node, bands and LONG one-bit coordinates in columns s0, s1, ... (64 each) from shingle sets."""
    names = [f"s{i}" for i in range(LONG // 64)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, counts = part.column(1), part.column(2)
                rows = np.repeat(np.arange(part.num_rows), keys.value_lengths().to_numpy())
                sig = signatures(rows, keys.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy().astype(np.float64), part.num_rows, LONG)
                bits = np.packbits((mix(sig) >> np.uint64(17)).astype(np.uint8) & 1, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), *[pa.array(bits[:, i]) for i in range(len(names))]], ["node", "bands", *names])

    return sets.mapInArrow(work, "node bigint, bands array<bigint>, " + ", ".join(f"{n} bigint" for n in names))


def _remaining(rows: DataFrame, sets: DataFrame, label: DataFrame, similarity: float, weight: str) -> DataFrame:
    """``label`` with the links inside buckets between members of different components added.

    Further representatives are drawn by hash; each round has ``GROWTH`` times as many per bucket
    as the one before, the last all, and goes on only with members that were none and with buckets that
    still hold several components. Members that are left get longer sketches, so that families of
    texts a little below the similarity are told apart without their shingles; a pair counts
    in the first bucket it shares.
    """

    def open_buckets(rest: DataFrame) -> tuple[DataFrame, int]:
        """Members of buckets with several components, the blocks of each bucket, and the copies that all as representatives would make."""
        several = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
        kept = stage(rest.drop("blocks").join(several.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket"), "rest")
        return kept, kept.agg(F.sum("blocks")).first()[0] or 0

    order = (F.xxhash64("node", "bucket").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) * F.col("members")
    rest, copies = open_buckets(rows.select("bucket", "node", "size", order.alias("order")).join(label, "node"))
    if not copies:
        return label
    left = rest.select("node").distinct()
    sketches = stage(long_sketches(sets.join(left, "node", "left_semi")), "sketches")
    parts = [c for c in sketches.columns if c != "node"]
    rep = lambda c: F.col(f"r_{c}")
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(rep(c))) for c in parts if c != "bands"), F.lit(0))
    near = (F.least("size", "r_size") >= similarity * F.greatest("size", "r_size")) & (differ <= LONG - LEAST_LONG)
    band = lambda i: F.get("bands", F.lit(i))  # noqa: E731 - no lambda over the array: the join stays compiled
    shared = F.coalesce(*[F.when(band(i) == F.get(rep("bands"), F.lit(i)), band(i)) for i in range(BANDS)])
    share = FIRST_SHARE
    while copies:
        last = copies <= FINISH
        full = rest.join(sketches, "node")
        reps = full if last else full.where(F.col("order") < share)
        reps = reps.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"r_{c}") for c in ("node", "size", "order", "label", *parts)])
        members = full.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "size", "order", "label", *parts)).alias("members"))
        # opened before the join, so its condition is part of it: pairs that are not near are no rows
        met = members.select("bucket", "block", F.inline("members")).join(reps, ["bucket", "block"])
        met = met.where((F.col("label") != F.col("r_label")) & (F.col("order") >= F.col("r_order")) & near & (shared == F.col("bucket")))
        met = met.select(F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b"), F.least("label", "r_label").alias("la"), F.greatest("label", "r_label").alias("lb"))
        pairs = stage(met, "pairs")
        linked = stage(verified(pairs, sets, similarity, weight).select(F.col("la").alias("a"), F.col("lb").alias("b")), "links")
        if not linked.isEmpty():
            merged = components(linked)  # of components: the graph of those that were still apart
            label, rest = stage(_relabelled(label, merged), "components"), _relabelled(rest, merged)
        if last:
            break
        rest, copies = open_buckets(rest.where(F.col("order") >= share))
        share *= GROWTH
    return label
