"""Time windows that hang on one reference time."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE_PARTITION = "txn_date"


@dataclass(frozen=True)
class Anchor:
    """The reference time: a one-row frame with column ``t``, read as a scalar subquery.

    Bounds are computed inside the subquery, so a filter compares a plain column with
    one value and can be pushed into the parquet scan. A ``fixed`` anchor folds to
    literals, which always are.
    """

    frame: DataFrame

    @property
    def now(self) -> Column:
        return self.frame.select("t").scalar()

    def minus(self, span: Column) -> Column:
        return self.frame.select(F.col("t") - span).scalar()

def reference_time(transactions: DataFrame) -> DataFrame:
    return transactions.agg(F.max("txn_ts").alias("t"))


def latest(transactions: DataFrame) -> Anchor:
    """The latest transaction of the whole table."""
    return Anchor(reference_time(transactions))


def fixed(spark: SparkSession, as_of: dt.datetime) -> Anchor:
    """A given reference time; the subquery over no table folds to a literal."""
    return Anchor(spark.sql(f"SELECT TIMESTAMP_NTZ'{as_of.isoformat(sep=' ')}' AS t"))


def since(transactions: DataFrame, t: Anchor, span: Column) -> DataFrame:
    """Rows not older than ``span`` before ``t``.

    The bound reaches the parquet scan as a pushed filter; where the table is
    partitioned by day, whole days are pruned as well.
    """
    recent = transactions.where(F.col("txn_ts") >= t.minus(span))
    if DATE_PARTITION in transactions.columns:
        recent = recent.where(F.col(DATE_PARTITION) >= t.minus(span).cast("date"))
    return recent
