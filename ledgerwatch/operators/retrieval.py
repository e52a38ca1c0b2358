"""Ranking of policy text for alerts (BM25 over the search index) and of vectors (cosine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.rules import RuleSet
from ledgerwatch.operators.search_index import SearchIndex

SUFFIX = " STR filing narrative"
TYPOLOGIES = ("AML_LAYERING", "MONEY_MULE", "SANCTIONS", "OTHER")


def alert_query() -> Column:
    return F.concat(F.col("typology"), F.lit(" "), F.concat_ws(" ", "flag_names"), F.lit(SUFFIX))


def alert_vocabulary(rules: RuleSet | None = None) -> list[str]:
    """Every word an alert query can hold; known from the rules, not from the data."""
    rules = rules or RuleSet()
    text = " ".join([r.flag for r in rules.rules] + list(TYPOLOGIES)) + SUFFIX
    return sorted(set(text.lower().replace("_", " ").split()))


def alert_queries(alerts: DataFrame) -> DataFrame:
    """The distinct queries of alerts: query_id, query_text; at most 4 typologies x 2^9 flag sets."""
    return alerts.select(alert_query().alias("query_text")).distinct().select(F.col("query_text").alias("query_id"), "query_text")


def policy_hits(alerts: DataFrame, index: SearchIndex, k: int = 6, **attributes: str | list[str] | None) -> DataFrame:
    """Retrieved sections per distinct alert query: labels and context in rank order."""
    ranked = index.search(alert_queries(alerts), alert_vocabulary(), k, bounded=True, **attributes)
    ranked = ranked.join(index.texts(ranked), "section")
    entry = F.struct(
        "rank", "section",
        F.concat(F.lit("["), "section", F.lit("] ("), "doc_title", F.lit(") "), "chunk_text").alias("passage"),
    )
    return (
        ranked.groupBy(F.col("query_id").alias("query_text"))
        .agg(F.array_sort(F.collect_list(entry)).alias("hits"))
        .select(
            "query_text",
            F.transform("hits", lambda h: h["section"]).alias("allowed"),
            F.concat_ws("\n\n", F.transform("hits", lambda h: h["passage"])).alias("context"),
        )
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def nearest_vectors(corpus: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows whose vector has the greatest cosine with one query vector: a scan and a top-k."""
    pair = corpus.select(key, F.col(vector).cast("array<double>").alias("v"), query.cast("array<double>").alias("q"))
    cosine = _dot(F.col("v"), F.col("q")) / F.sqrt(_dot(F.col("v"), F.col("v")) * _dot(F.col("q"), F.col("q")))
    return pair.select(key, F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def centroid(corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean vector as a one-row frame: averages per position, put in order."""
    parts = corpus.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))  # one entry per dimension
    return parts.agg(F.transform(ordered, lambda s: s["mean"]).alias("vector"))
