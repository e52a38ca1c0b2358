"""Links kept in folders by a hash of what they are looked up by.

Four tables under ``path``, each in ``buckets`` folders: ``owners`` (account and its customer, by
account), ``ends`` (each flow link once per customer at its ends, by customer), ``use_by_owner`` and
``use_by_device`` (the members of devices, by customer and by device). A neighbourhood opens one
folder of the first three and those of the devices found. An account without an
owner is its own. A folder of many rows is written as several files.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.network import EDGE_COLUMNS, own_links

TABLES = ("owners", "ends", "use_by_owner", "use_by_device")


class LinkTables:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, key: Column) -> Column:
        return (F.crc32(key.cast("binary")) % self.buckets).cast("int")

    def _bucket_of(self, value: str) -> int:
        return zlib.crc32(value.encode()) % self.buckets

    def build(self, accounts: DataFrame, flows: DataFrame, use: DataFrame) -> None:
        ends = F.array_distinct(F.array(F.coalesce("source_cust_id", "source_node"), F.coalesce("target_cust_id", "target_node")))
        self._write("owners", accounts.select("account_id", "customer_id"), "account_id")
        self._write("ends", flows.select(*EDGE_COLUMNS, F.explode(ends).alias("owner")), "owner")
        self._write("use_by_owner", use, "customer_id")
        self._write("use_by_device", use, "device_id")

    def _write(self, name: str, rows: DataFrame, key: str) -> None:
        rows.withColumn("bucket", self.bucket(F.col(key))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def neighbourhood(self, *, customer_id: str | None = None, account_id: str | None = None) -> DataFrame:
        """Links that touch one customer or one account."""
        if (customer_id is None) == (account_id is None):
            raise ValueError("name either a customer or an account")
        owner = customer_id
        if account_id is not None:
            known = self.read("owners", [self._bucket_of(account_id)]).where(F.col("account_id") == account_id).first()
            owner = known.customer_id if known else account_id
        here = [self._bucket_of(owner)]
        ends = self.read("ends", here).where(F.col("owner") == owner)
        mine = self.read("use_by_owner", here).where(F.col("customer_id") == owner)
        if account_id is not None:
            ends = ends.where((F.col("source_node") == account_id) | (F.col("target_node") == account_id))
            mine = mine.where(F.col("account_id") == account_id)
        devices = sorted(r[0] for r in mine.select(self.bucket(F.col("device_id"))).distinct().collect())  # at most ``buckets`` numbers
        own = ("customer_id", owner) if account_id is None else ("account_id", account_id)
        return ends.select(EDGE_COLUMNS).unionByName(own_links(mine, self.read("use_by_device", devices), *own))
