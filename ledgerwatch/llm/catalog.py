"""Queries of the training-data operators: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm.boilerplate import remove_boilerplate
from ledgerwatch.llm.decontaminate import leaked_items
from ledgerwatch.llm.frames import table
from ledgerwatch.llm.html_text import extract_pages
from ledgerwatch.llm.infill import fill_in_middle, restored
from ledgerwatch.llm.licenses import scan_licenses
from ledgerwatch.llm.lm import score_texts
from ledgerwatch.llm.neardup import near_duplicates
from ledgerwatch.llm.packing import pack
from ledgerwatch.llm.periodic import periodic_runs
from ledgerwatch.llm.quality import repetition_report
from ledgerwatch.llm.token_files import checksums, write_token_files
from ledgerwatch.llm.toxicity import score_toxicity
from ledgerwatch.llm.url_filter import judge_urls
from ledgerwatch.session import shared_dir


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer lies; a parameter of the operators, its file is not ours."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(table(spark, sf_dir, "documents"))


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs, removed="n_removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(spark, write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files"), tokenizer_file()))


def planted_order(key: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a text whose tail repeats, for a tenth of the keys; else None."""
    h = zlib.crc32(str(key if key is not None else "").encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), order=planted_order))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one, and digests of the list of runs and of the collapsed text."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p)))")
    found = found.withColumn("_longest", longest)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    length, period = -F.col("_longest.l"), F.col("_longest.p")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_longest.s").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * -_longest.l) div _longest.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_html_text, op3_decontamination, op4_repetition, op5_lattice_score, op6_url_filter, op7_line_spread, op8_toxicity, op9_packing,
        op10_near_duplicates, op11_token_files, op12_periodic_runs, op13_fill_in_middle,
    )
}
#: None of them has a plain SQL form: hashing, compression, markup, trees, tokenizers, automata. Tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
