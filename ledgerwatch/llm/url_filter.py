"""URL filter (operator 6, DataFrame functions and pyspark.ml only).

Host and path rules decide where one fits. Every other url is judged by gradient-boosted trees
on lexical features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of
the host's suffix, of the path's first segment and of its ending. The trees are trained on
labelled urls; without given labels, those are the urls that a rule decides. At most about
``LABELLED`` of them, chosen by hash, fit the trees; the statistics use all of them.

Scale: features are computed inside the row, suffix statistics are one aggregation each and
joined back (their tables are as long as there are suffixes; Spark measures them before it
broadcasts). A suffix that most rows share is one row per task in the aggregation.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is judged by the trees; without labelled urls of both kinds the trees are not trained and the
one kind there is (or ``allow``) is the verdict; repeated rows are judged alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.frames import stage

#: (rule, verdict): host and path prefix; a rule holds for the host and its subdomains, the longest wins
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LABELLED = 20_000
TREES, DEPTH = 12, 4
SMOOTH = 20.0  # rows of average kind added to every statistic
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    body = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(body, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(body, r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits; null if none."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        if slash:
            fits = fits & path.startswith("/" + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters that ``pattern`` matches."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    p = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    distinct = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(distinct, F.lit(0.0), lambda total, c: total - p(c) * F.log2(p(c)))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    body = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(body, r"\?([^#]*)", 1)
    count = lambda text, what: F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))
    return {
        "f_length": F.length(body), "f_host_length": F.length(host), "f_path_length": F.length(path), "f_query_length": F.length(query),
        "f_depth": count(path, "/"), "f_labels": count(host, ".") + F.when(host == "", 0).otherwise(1), "f_hyphens": count(host, "-"),
        "f_digits": _share(body, "0-9"), "f_host_digits": _share(host, "0-9"), "f_marks": _share(body, r"-_~%.=&"),
        "f_entropy": entropy(body), "f_host_entropy": entropy(host),
        "f_parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "f_fragment": body.contains("#").cast("int"),
        "f_secure": body.startswith("https://").cast("int"), "f_encoded": count(body, "%"),
    }


#: name -> the part of a url whose labelled rows are counted
SUFFIXES = {
    "s_suffix": lambda host, path: F.substring_index(host, ".", -1),
    "s_domain": lambda host, path: F.substring_index(host, ".", -2),
    "s_head": lambda host, path: F.regexp_extract(path, r"^/([^/]*)", 1),
    "s_ending": lambda host, path: F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1),
}


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, score (log-odds of block by the trees, null where a rule decides).

    ``labels`` (url, block 0/1) replaces the rules' own verdicts as training data.
    """
    kind = dict(rules)
    with_parts = lambda df, address: df.withColumns(dict(zip(["host", "path"], host_and_path(address), strict=True)))
    blocked = F.coalesce(*[F.when(F.col("rule") == r, F.lit(int(v == "block"))) for r, v in kind.items()]) if kind else F.lit(None).cast("int")
    rows = with_parts(pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url")), F.col("url"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("block", blocked)
    parts = {name: part(F.col("host"), F.col("path")) for name, part in SUFFIXES.items()}
    rows = rows.withColumns(parts)
    if labels is None:
        known = rows.where("block is not null")
    else:
        known = with_parts(labels.select(F.col("url").cast("string").alias("url"), F.col("block").cast("int").alias("block")), F.col("url")).withColumns(parts)
    known = known.select("url", "host", "path", "block", *SUFFIXES)

    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("block"), F.lit(0)).alias("blocked")).first()
    rule_verdict = F.when(F.col("block") == 1, "block").when(F.col("block") == 0, "allow")
    if not 0 < total.blocked < total.n:
        only = "block" if total.blocked else "allow"
        return rows.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce(rule_verdict, F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))

    prior = total.blocked / total.n
    statistics = {name: stage(known.groupBy(name).agg(F.count("*").alias("n"), F.sum("block").alias("b")), name) for name in SUFFIXES}
    lexical = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    names = [*lexical, *[f"{s}_{x}" for s in SUFFIXES for x in ("rate", "size")]]

    def featured(df: DataFrame, own: bool) -> DataFrame:
        """``own``: the row itself is among the counted ones and is taken out of its statistics."""
        for s, counts in statistics.items():
            n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0))
            if own:
                n, b = n - 1, b - F.col("block")
            df = df.join(counts, s, "left").withColumns({f"{s}_rate": (b + SMOOTH * prior) / (n + SMOOTH), f"{s}_size": F.log1p(n)}).drop("n", "b")
        return VectorAssembler(inputCols=names, outputCol="features").transform(df.withColumns(lexical).withColumns({c: F.col(c).cast("double") for c in names}))

    share = min(1.0, LABELLED / total.n)
    sample = known.where(F.pmod(F.xxhash64("url", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    training = stage(featured(sample, True).select("features", F.col("block").cast("double").alias("label")), "training").coalesce(8)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(training)
    judged = model.transform(featured(rows.where("rule is null"), False))
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array("rawPrediction")[1]
    free = judged.select(F.col("key").alias(key), "host", "path", "rule", F.when(F.col("prediction") == 1, "block").otherwise("allow").alias("verdict"), score.alias("score"))
    ruled = rows.where("rule is not null").select(F.col("key").alias(key), "host", "path", "rule", rule_verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(free)
