"""Curated tables written once per data folder and read by the questions.

Questions read refreshed tables (transactions by day, signals, alerts, loan
warnings, daily coverage, cases, findings, evidence) rather than recomputing
them; ``refresh`` recomputes them. The tables live in the shared folder the
cluster names, so an executor that is lost takes nothing with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwatch.session import shared_dir


class CuratedStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or shared_dir(spark, "curated")).rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._values: dict[str, object] = {}
        self._versions: dict[str, int] = {}

    def table(self, name: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
        """The stored table; written by ``build`` on first use, in folders per ``partition`` value."""
        if name not in self._tables:
            self._tables[name] = self._write(name, build(), partition)
        return self._tables[name]

    def value(self, name: str, build: Callable[[], DataFrame]):
        """A single value (one row, one column), computed once per refresh."""
        if name not in self._values:
            self._values[name] = build().first()[0]
        return self._values[name]

    def folder(self, name: str, build: Callable[[str], object]):
        """What ``build`` makes of a new folder, once per refresh."""
        if name not in self._values:
            self._versions[name] = self._versions.get(name, 0) + 1
            self._values[name] = build(f"{self.root}/{name}/v{self._versions[name]}")
        return self._values[name]

    def _write(self, name: str, df: DataFrame, partition: str | None) -> DataFrame:
        # a refresh writes a new folder: frames that still read the old one are not disturbed
        self._versions[name] = self._versions.get(name, 0) + 1
        path = f"{self.root}/{name}/v{self._versions[name]}"
        if partition:
            # rebalance, not repartition: a day with most of the rows is split over several files
            df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *names: str) -> None:
        """Have the named tables (all when none is named) recomputed by the next workspace."""
        for name in names or [*self._tables, *self._values]:
            self._tables.pop(name, None)
            self._values.pop(name, None)


_STORES: dict[tuple[str, str], CuratedStore] = {}


def session_store(spark: SparkSession, data_dir: str) -> CuratedStore:
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _STORES:
        _STORES[key] = CuratedStore(spark)
    return _STORES[key]
