"""Line dedup by distinct-site spread (operator 7, DataFrame functions only).

Per line (trimmed, by 64-bit hash) HyperLogLog sketches of its sites and of the texts that
hold it merge by aggregation. Lines whose estimate is near the threshold are counted
exactly. A line on ``min_sites`` sites or more, in as many different texts, is boilerplate;
so is a line of ``LONG_WORDS`` words or more in ``min_texts`` different texts, on however few
sites. Boilerplate lines go from every text. Equal copies of one text are one text and spread
nothing, and so are near copies: of all texts that hold such lines, those of similarity
``SIMILARITY`` (sets of five-word shingles) and chains of them count as one, and the lines are
counted again.

Scale: the sketches are combined map-side, so a line that is in a third of all rows is one
row per task. Lines meet the boilerplate list in two joins: the at most ``HOT`` lines that
have a share of 1/HOT of all occurrences are broadcast (no more can exist), the others are
joined by hash. What goes back to the texts is keyed by row: the numbers of its lines that go.

Defined cases: null text stays null and has no lines; blank lines are never removed; a null
site counts as one site; repeated rows are cleaned alike; an empty table gives no rows; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.frames import fresh, stage

MIN_SITES = 10
LONG_WORDS = 50  # from here on texts alone decide
MIN_TEXTS = 10  # for these
SIMILARITY = 0.8  # of near copies
SHINGLE = 5
POINTS = [n << 61 for n in range(-4, 4)]  # spread over the hashes; near copies meet by the shingle nearest to one: 0.8 fails all 8 with probability 3e-6
LG_K = 12  # relative error of an estimate 1.6 %
MARGIN = 0.1
HOT = 2000
BLANK = " \t\n\x0b\x0c\r"


def _inner(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _is_long(line: Column) -> Column:
    """Whether the trimmed line has LONG_WORDS words; words are looked at only where so many fit."""
    words = rf"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{LONG_WORDS - 1}}}[^\x20\x09-\x0D]"
    return F.when(F.length(line) >= 2 * LONG_WORDS - 1, line.rlike(words)).otherwise(False)


def _row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key, text)


def line_table(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """One row per line of each row that is not blank: row, text and line hash, line number, site, whether the line is long."""
    body = docs[text].cast("string")
    # the outer form: the inner one splits every text a second time, to leave out those without lines
    raw = docs.select(
        _row_key(docs[key], body).alias("row"), F.xxhash64(body).alias("body"), F.coalesce(docs[site].cast("string"), F.lit("")).alias("site"),
        F.posexplode_outer(F.split(body, "\n")).alias("pos", "raw"),
    )
    inner = raw.select("row", "body", "site", "pos", _inner(F.col("raw")).alias("inner")).where(F.length("inner") > 0)
    return inner.select("row", "body", "site", "pos", F.xxhash64("inner").alias("line"), _is_long(F.col("inner")).alias("long"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS) -> DataFrame:
    """line, n_sites, n_texts, n_rows of the lines on ``min_sites`` sites or more, in as many texts,
    and of the long lines in ``min_texts`` texts or more.

    Counts beyond the margin of the threshold are estimates.
    """
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n_sites"), F.hll_sketch_estimate(F.hll_sketch_agg("body", LG_K)).alias("n_texts"), F.count("*").alias("n_rows"),
        F.max("long").alias("long"),
    )

    def reach(at):
        return (F.least("n_sites", "n_texts") >= at(min_sites)) | F.col("long") & (F.col("n_texts") >= at(min_texts))

    spread = stage(spread.where(reach(lambda n: n * (1 - MARGIN) - 1)), "spread")
    sure = reach(lambda n: n * (1 + MARGIN) + 2)
    near = spread.where(~sure).select("line", "n_rows", "long")
    seen = lines.join(near.select("line"), "line", "left_semi")
    exact = (
        seen.select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("n_sites"))
        .join(seen.select("line", "body").distinct().groupBy("line").agg(F.count("*").alias("n_texts")), "line")
        .join(near, "line").where(reach(lambda n: n))
    )
    return spread.where(sure).unionByName(exact).drop("long")


def _marked(lines: DataFrame, found: DataFrame) -> DataFrame:
    """row, pos of every occurrence of a found line."""
    total = lines.count()
    hot = F.col("n_rows") * HOT >= total
    slim = lines.select("row", "pos", "line")
    many = F.broadcast(found.where(hot).select("line"))
    few = found.where(~hot).select("line")
    return slim.join(many, "line", "left_semi").union(slim.join(few, "line", "left_semi")).drop("line")


def _distance(hashes: str, point: int) -> Column:
    """Of the hash nearest to ``point``, what sets it apart from it."""
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(point))))


def _copy_links(texts: DataFrame, similarity: float) -> DataFrame:
    """body, rep: links between near copies among different ``texts`` (body, text).

    A bucket holds the texts that share the shingle nearest to a point. Each text meets one
    text of each of its buckets; pairs are checked on all shingles. Two copies stay apart
    where neither meets the other nor a copy of it in any of their buckets.
    """
    words = F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), "")
    # the words side by side with those that follow; an end that lacks words is no shingle of its own
    ahead = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}") for i in range(SHINGLE)])
    shingles = F.slice(ahead, 1, F.greatest(F.size("words") - SHINGLE + 1, F.lit(1)))
    hashes = F.array_distinct(F.transform(shingles, lambda x: F.xxhash64(x)))
    sets = texts.select("body", words.alias("words")).select("body", hashes.alias("set"))
    # a text without words has one shingle, as all such texts
    sets = stage(sets.select("body", F.when(F.size("set") > 0, F.col("set")).otherwise(F.array(F.lit(0).cast("bigint"))).alias("set")), "shingles")
    # hashes are random, so the one nearest to a fixed point is a random shingle, the same in near copies
    minima = F.array(*[F.xxhash64(F.lit(n), _distance("set", point)) for n, point in enumerate(POINTS)])
    rows = stage(sets.select("body", F.explode_outer(minima).alias("bucket")), "buckets")
    # another order in each bucket, so that a text of many copies meets several of them
    least = F.min(F.col("body").bitwiseXOR(F.col("bucket"))).bitwiseXOR(F.col("bucket"))
    heads = rows.groupBy("bucket").agg(least.alias("rep"), F.count("*").alias("members")).where("members > 1")
    pairs = rows.join(heads, "bucket").where("body <> rep").select("body", "rep").distinct()
    met = pairs.join(sets, "body").join(sets.toDF("rep", "rep_set"), "rep")
    common = F.size(F.array_intersect("set", "rep_set"))
    return stage(met.where(common >= similarity * (F.size("set") + F.size("rep_set") - common)).select("body", "rep"), "copies")


def copy_keys(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """body, copy: the least body of its chain of near copies, for all ``texts`` (body, text) that have one.

    Every round takes the least key among the linked texts and then the key of that key,
    until no key changes: the rounds grow with the logarithm of the longest chain.
    """
    links = _copy_links(texts, similarity)
    both = links.union(links.select("rep", "body")).toDF("body", "other")
    keys = stage(both.groupBy("body").agg(F.least(F.min("other"), F.col("body")).alias("copy")), "keys")
    while True:
        near = both.join(keys.toDF("other", "next"), "other").groupBy("body").agg(F.min("next").alias("next"))
        lower = keys.join(near, "body").select("body", F.col("copy").alias("was"), F.least("copy", "next").alias("copy"))
        onward = keys.toDF("copy", "onward")
        moved = stage(lower.join(onward, "copy").select("body", "was", F.least("copy", "onward").alias("copy")), "keys")
        if moved.where("copy <> was").isEmpty():
            return keys
        keys = moved.drop("was")


def without_copies(docs: DataFrame, text: str, lines: DataFrame, found: DataFrame, row: Column, min_sites: int, min_texts: int) -> DataFrame:
    """``found`` without the lines that are boilerplate only as near copies hold them."""
    body = F.col(f"`{text}`").cast("string")
    # one row of each text first, by ids alone: equal texts and those without such lines are not moved
    holders = docs.select(row.alias("row"), F.xxhash64(body).alias("body")).join(_marked(lines, found).select("row"), "row", "left_semi")
    one = holders.groupBy("body").agg(F.min("row").alias("row"))
    texts = docs.select(row.alias("row"), body.alias("text")).join(one, "row")
    holders = texts.groupBy("body").agg(F.first("text").alias("text"))  # rows that repeat have one key
    copies = copy_keys(holders)
    if copies.isEmpty():
        return found
    # counting copies as one takes away at most the texts that are copies: most lines stay without a recount
    held = lines.join(found.select("line"), "line", "left_semi").groupBy("body", "line").agg(F.max("long").alias("long"))
    merged = held.join(copies.select("body"), "body", "left_semi").groupBy("line").agg(F.count("*").alias("merged"), F.max("long").alias("long"))
    need = F.when(F.col("long"), min(min_sites, min_texts)).otherwise(min_sites)
    doubtful = found.join(merged, "line").where(F.col("n_texts") * (1 - MARGIN) - 1 - F.col("merged") < need)
    doubtful = stage(doubtful.select("line"), "doubtful")
    again = lines.join(doubtful, "line", "left_semi").join(copies, "body", "left")
    again = stage(again.select("line", "long", "site", F.coalesce("copy", "body").alias("body")), "again")
    sure = boilerplate_lines(again, min_sites, min_texts).select("line")
    return stage(found.join(doubtful, "line", "left_anti").unionByName(found.join(sure, "line", "left_semi")), "boilerplate")


def _without(parts: Column, drop: Column) -> Column:
    """``parts`` without the positions ``drop`` (ascending): the stretches between them, in time linear in the parts."""

    def between(parts: Column):
        def stretch(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)
            return F.slice(parts, start + 1, F.when(i == F.size(drop), F.size(parts)).otherwise(F.get(drop, i)) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), stretch))

    # bound as a name, so that the text is split once and not for every stretch
    return F.get(F.transform(F.array(parts), between), 0)


def remove_boilerplate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, removed: str | None = None, min_texts: int = MIN_TEXTS,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all columns stay, ``removed`` names an added count of lines."""
    lines = stage(line_table(docs, key, text, site), "lines")
    found = stage(boilerplate_lines(lines, min_sites, min_texts), "boilerplate")
    body = F.col(f"`{text}`").cast("string")
    row_key = _row_key(F.col(f"`{key}`"), body)
    sure = without_copies(docs, text, lines, found, row_key, min_sites, min_texts)
    per_row = _marked(lines, sure).groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("_drop"))
    row, drop, kept = (fresh(docs, c) for c in ("_row", "_drop_lines", "_kept"))
    joined = docs.withColumn(row, row_key).join(per_row.select(F.col("row").alias(row), F.col("_drop").alias(drop)), row, "left")
    joined = joined.withColumn(kept, F.when(F.col(drop).isNotNull(), _without(F.split(body, "\n"), F.col(drop))))
    new_text = F.when(F.col(kept).isNotNull(), F.array_join(F.col(kept), "\n")).otherwise(body)
    columns = [new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        columns.append(F.when(F.col(kept).isNotNull(), F.size(drop)).otherwise(0).cast("bigint").alias(removed))
    return joined.select(*columns)
