"""Token ids in Parquet files (operator 11).

Texts are dealt to files by ranges of their key, sorted, tokenised whole and written as one
row per document: ``part`` (the file's number), the key, ``start`` (ids before the document
in its file), ``n_tokens`` and ``ids``, a list column. The format is set, not left to
defaults: ids are dictionary-encoded (a vocabulary of under 2^16 gives two bytes an id or
less), the ascending numbers beside them delta-encoded, row groups end at ``ROW_GROUP`` bytes, pages at
``PAGE`` bytes or ``PAGE_ROWS`` rows, and every page has its least and largest value in the page
index. A read of some documents, or of some stretch of the whole id stream, opens only the
pages that the index admits; a read of numbers leaves the ids where they are.

A second, small table beside the files has one row per file: its documents, ids, and the ids
before it. It is computed from the written files and turns starts inside a file into starts
in the stream; nothing has to be written twice.

Spark writes and commits the files, so a lost executor costs one task; any file system that
Spark reaches will do. A key that a third of all rows share is spread over files by the
text's hash, and equal rows by a number of their own.

Defined cases: null and empty texts are the end id alone; null keys come first; rows with
one key are ordered by the text's hash; equal rows are written each; an empty table gives no rows;
other columns are left out. Texts are tokenised whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.packing import END_ID, PieceIds, text_ids
from ledgerwatch.llm.words import slices

ROW_GROUP = 16 << 20
PAGE = 256 << 10
PAGE_ROWS = 1000
CACHED_PIECES = 500_000  # kept between texts of a worker; a longer list starts anew
DICTIONARY = 1 << 20  # bytes; a vocabulary beyond it falls back to delta encoding

#: Settings of Spark's Parquet writer
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(DICTIONARY),
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "compression": "zstd",
}

_KNOWN: dict[str, PieceIds] = {}  # of this Python worker, by tokenizer file


def _encoder(tokenizer_file: str) -> PieceIds:
    if tokenizer_file not in _KNOWN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _KNOWN[tokenizer_file] = PieceIds(Tokenizer.from_file(tokenizer_file))
    if _KNOWN[tokenizer_file].known > CACHED_PIECES:
        _KNOWN[tokenizer_file].clear()
    return _KNOWN[tokenizer_file]


def ordered(docs: DataFrame, key: str, text: str, files: int | None) -> DataFrame:
    """Key and text, dealt to tasks by ranges of the key and sorted inside each."""
    slim = docs.select(docs[key], docs[text].cast("string").alias("_text"))
    slim = slim.select("*", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col(f"`{key}`").asc_nulls_first(), F.col("_hash"), F.xxhash64("_row")]
    dealt = slim.repartitionByRange(files, *order) if files else slim.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).select(F.col(f"`{key}`"), "_text")


def encoded(rows: DataFrame, key: str, tokenizer_file: str, end: int = END_ID) -> DataFrame:
    """One row per row, in its order: part, key, start inside the part, n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                ids, cuts = text_ids(batch.column(1).slice(a, b - a), _encoder(tokenizer_file), end)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int32)))
                numbers = [np.full(b - a, part, np.int32), before + cuts[:-1], np.diff(cuts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[0]), batch.column(0).slice(a, b - a), pa.array(numbers[1]), pa.array(numbers[2]), lists],
                    ["part", key, "start", "n_tokens", "ids"],
                )
                before += int(cuts[-1])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"part int, `{key}` {kind}, start bigint, n_tokens int, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, key: str = "doc_id", text: str = "text", end: int = END_ID, files: int | None = None) -> str:
    """Write ``path``/ids and ``path``/parts; gives ``path``.

    ``files``: how many files to deal the rows to; unset, the session's shuffle partitions,
    which adaptive execution joins where they are small.
    """
    spark = docs.sparkSession
    encoded(ordered(docs, key, text, files), key, tokenizer_file, end).write.options(**FORMAT).parquet(f"{path}/ids")
    written = spark.read.parquet(f"{path}/ids")
    parts = written.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    parts.select("part", "documents", "tokens", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: part, documents, tokens, and the ids in all files before it."""
    return spark.read.parquet(f"{path}/parts")


def read_numbers(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start in the stream, n_tokens of every document, without reading ids."""
    return _placed(spark.read.parquet(f"{path}/ids").select("part", f"`{key}`", "start", "n_tokens"), read_parts(spark, path))


def read_documents(spark: SparkSession, path: str, chosen: Column | str) -> DataFrame:
    """key, start in the stream, n_tokens and ids of the documents that ``chosen`` (on the key) admits.

    Row groups and pages whose least and largest key it rules out are not read.
    """
    return _placed(spark.read.parquet(f"{path}/ids").where(chosen), read_parts(spark, path))


def read_stretch(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids ``first`` (included) to ``last`` (excluded) of the stream, one row per document touched.

    The small table tells the files; inside each, ``start`` prunes pages on one side.
    """
    places = read_parts(spark, path).where(f"before < {last} and before + tokens > {first}").select("part", "before").collect()
    rows = spark.read.parquet(f"{path}/ids")
    if not places:
        return _placed(rows.where("false"), read_parts(spark, path))
    # files at the two ends are cut inside, those between are read whole
    low, high = min(places), max(places)
    inside = F.col("part").between(low.part, high.part) & ((F.col("part") < high.part) | (F.col("start") < last - high.before))
    inside &= (F.col("part") > low.part) | (F.col("start") + F.col("n_tokens") > first - low.before)
    placed = _placed(rows.where(inside), read_parts(spark, path))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    upto = F.least(F.lit(last) - F.col("start"), F.col("n_tokens")).cast("int")
    return placed.withColumns({"ids": F.slice("ids", skip + 1, upto - skip), "start": F.col("start") + skip, "n_tokens": upto - skip})


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts.select("part", "before"), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def checksums(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start in the stream, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit) of the files' documents."""
    rows = spark.read.parquet(f"{path}/ids").select("part", f"`{key}`", "start", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            cuts = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            sizes = pa.array(np.diff(cuts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, pa.array(sums, pa.int64())], ["part", key, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[1].dataType.simpleString()
    found = rows.mapInArrow(run, f"part int, `{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return _placed(found, read_parts(spark, path))
