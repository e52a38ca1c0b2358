"""Refresh of daily coverage and of loan warnings, by what a batch touches.

Coverage: positions land in folders by day and batch. The days of a batch are the days whose
coverage it changes; they are computed anew and replace their own folders by dynamic partition
overwrite. No other folder is opened or written.

Loans: the book and the warnings are dealt by loan into the same buckets. A batch holds new
editions of some loans; it reads and rewrites the buckets of these loans, and computes
warnings for them alone.

Running a batch again writes the same folders and changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.credit import loan_ews
from ledgerwatch.operators.liquidity import lcr_daily
from ledgerwatch.operators.state import BucketTable, merge_by_key
from ledgerwatch.sources.tables import SCHEMAS

DAY = "as_of_date"
POSITIONS = ("hqla_holdings", "cashflow_positions")


class CoverageRefresh:
    """``hqla_holdings`` and ``cashflow_positions`` in, ``lcr_daily`` out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def positions(self, name: str, days: list[dt.date] | None = None) -> DataFrame:
        """Landed positions, of some days or of all; only the folders of the days are listed."""
        root = f"{self.root}/{name}"
        path = root if days is None else f"{root}/{DAY}={{{','.join(d.isoformat() for d in days)}}}"
        schema = f"{SCHEMAS[name]}, batch_id bigint"
        try:
            return self.spark.read.schema(schema).option("basePath", root).parquet(path).drop("batch_id")
        except AnalysisException:  # nothing on these days
            return self.spark.createDataFrame([], SCHEMAS[name])

    def coverage(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lcr_daily")

    def update(self, batch_id: int, **rows: DataFrame) -> list[dt.date]:
        """Take in new positions (``hqla_holdings=``, ``cashflow_positions=``); gives the days they touch."""
        days: set[dt.date] = set()
        for name, new in rows.items():
            if name not in POSITIONS:
                raise ValueError(f"unknown positions: {name}")
            landed = new.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            self._replace(landed, name, DAY, "batch_id")
            mine = self.positions_of(name, batch_id).select(DAY).distinct()  # names of folders
            days |= {r[0] for r in mine.collect()}
        if days:
            held = {name: self.positions(name, sorted(days)) for name in POSITIONS}
            self._replace(lcr_daily(held["hqla_holdings"], held["cashflow_positions"]), "lcr_daily", DAY)
        return sorted(days)

    def positions_of(self, name: str, batch_id: int) -> DataFrame:
        """The landed positions of one batch."""
        try:
            return self.spark.read.schema(f"{SCHEMAS[name]}, batch_id bigint").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}/{DAY}=*/batch_id={batch_id}")
        except AnalysisException:  # an empty batch
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _replace(self, rows: DataFrame, name: str, *folders: str) -> None:
        rows.hint("rebalance", folders[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{self.root}/{name}")


class LoanRefresh:
    """New editions of loans in, the loan book and its warnings out."""

    def __init__(self, spark: SparkSession, root: str, customers: DataFrame, buckets: int = 32):
        self.root, self.customers, self.buckets = root.rstrip("/"), customers, buckets
        self.loans = BucketTable(spark, f"{self.root}/loans", SCHEMAS["loans"], ["loan_id"], buckets)
        warned = loan_ews(spark.createDataFrame([], SCHEMAS["loans"]), customers).schema
        self.warnings = BucketTable(spark, f"{self.root}/loan_ews", warned.toDDL(), ["loan_id"], buckets)

    def update(self, rows: DataFrame, batch_id: int) -> list[int]:
        """``rows``: the newest edition of some loans, one row each; gives the buckets that they touch."""
        rows = rows.select(*self.loans.read([]).columns)
        touched = self.loans.touched(rows)
        self.loans.replace(merge_by_key(self.loans.read(touched), rows, ["loan_id"]), touched, batch_id)
        mine = self.loans.read(touched).join(rows.select("loan_id"), "loan_id", "left_semi")
        self.warnings.replace(merge_by_key(self.warnings.read(touched), loan_ews(mine, self.customers), ["loan_id"]), touched, batch_id)
        return touched
