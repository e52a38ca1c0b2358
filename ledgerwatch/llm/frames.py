"""Small helpers on frames that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import shared_dir

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, size: int = 4 << 20):
    """An Arrow mapper that hands ``work`` row ranges of about ``size`` bytes of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerwatch.llm.words import slices

        for batch in batches:
            for start, stop in slices(batch.column(batch.schema.get_field_index(column)), size):
                out = work(batch.slice(start, stop - start))
                if out is not None and out.num_rows:
                    yield out

    return run


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of an id's decimal text modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
