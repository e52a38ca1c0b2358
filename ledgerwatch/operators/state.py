"""Writes to tables that change: insert-if-absent, joined update, merge, snapshots.

The built-in file formats have no MERGE, so each operator is a function from the
old state and a change set to the new state. ``SnapshotStore`` publishes a new
state as a version folder plus one line in a commit log; a reader sees the last
committed version, and committing a batch again is a no-op. ``BucketTable`` does the same per
bucket of a key, for tables of which a batch changes a small part.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target`` yet (append them)."""
    return new.join(target.select(keys), keys, "left_anti")


def merge_by_key(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``target`` whose key is not among them."""
    return target.join(new.select(keys), keys, "left_anti").select(target.columns).unionByName(new.select(target.columns))


def joined_update(target: DataFrame, source: DataFrame, on: list[str], set_: dict[str, Column]) -> DataFrame:
    """UPDATE target SET ... FROM source: rows with a match take the new values.

    ``set_`` may use literals and the columns of ``source`` as ``s_<name>``.
    ``source`` has to be unique on the key.
    """
    renamed = source.select(*on, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in on], F.lit(True).alias("s_match"))
    joined = target.join(renamed, on, "left")
    cols = [
        F.when(F.col("s_match"), set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in target.columns
    ]
    return joined.select(cols)


def merge_snapshot(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update: list[str],
    on_match: dict[str, Column],
    on_insert: dict[str, Column],
) -> DataFrame:
    """MERGE by ``key`` as one full outer join.

    Matched: the ``update`` columns come from ``source``, ``on_match`` columns are
    computed, the rest is kept. New: ``key`` and ``update`` come from ``source``,
    everything else from ``on_insert`` (NULL when not named). Rows only in
    ``target`` stay as they are. Expressions may use the source as ``s_<name>``.
    """
    t = target.withColumn("t_here", F.lit(True))
    s = source.select(F.col(key), *[F.col(c).alias(f"s_{c}") for c in source.columns if c != key], F.lit(True).alias("s_here"))
    joined = t.join(s, key, "full_outer")

    def value(name: str, dtype) -> Column:
        if name == key:
            return F.col(key)
        new = F.col(f"s_{name}") if name in update else on_insert.get(name, F.lit(None))
        kept = F.col(name)
        if name in update:
            kept = F.when(F.col("s_here"), F.col(f"s_{name}")).otherwise(F.col(name))
        elif name in on_match:
            kept = F.when(F.col("s_here"), on_match[name]).otherwise(F.col(name))
        return F.when(F.col("t_here"), kept).otherwise(new).cast(dtype)

    return joined.select(*[value(f.name, f.dataType).alias(f.name) for f in target.schema.fields])


INSERT, UPDATE, RETRACT = "INSERT", "UPDATE", "RETRACT"


def changes_between(before: DataFrame, after: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """What turns ``before`` into ``after``: op and the columns of ``after`` (of ``before`` where a row is taken back).

    A row whose columns other than ``ignore`` are the same is no change. Both have unique keys.
    """
    compared = [c for c in after.columns if c != key and c not in ignore]
    pack = lambda df, name: df.select(key, F.struct(*after.columns).alias(name), F.struct(*compared).alias(f"{name}_c"))
    both = pack(before, "b").join(pack(after, "a"), key, "full_outer")
    op = F.when(F.col("b").isNull(), INSERT).when(F.col("a").isNull(), RETRACT).when(~F.col("a_c").eqNullSafe(F.col("b_c")), UPDATE)
    return both.withColumn("op", op).where(F.col("op").isNotNull()).select("op", F.coalesce("a", "b").alias("row")).select("op", "row.*")


def replayed(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table that a log of changes amounts to: per key its last change, unless that takes it back."""
    columns = [c for c in changes.columns if c not in ("op", order)]
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *columns), order).alias("c"))
    return last.where(F.col("c.op") != RETRACT).select(*[F.col(f"c.{c}").alias(c) for c in columns])


class BatchLog:
    """Which batches are complete: one line per batch, written after all its folders.

    The numbers, one per batch, come to the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> list[int]:
        try:
            return sorted(r.batch_id for r in self.spark.read.schema("batch_id bigint").json(f"{self.path}/*").distinct().collect())
        except AnalysisException:  # nothing committed yet
            return []

    def commit(self, batch_id: int) -> None:
        self.spark.range(batch_id, batch_id + 1, 1, 1).toDF("batch_id").write.mode("overwrite").json(f"{self.path}/{batch_id}")


class SnapshotStore:
    """Versioned snapshots of one table under ``path``.

    The last ``keep`` versions are kept: a version is written to the slot of its batch,
    then one log line makes it current. A reader of the current version is not touched
    by the next ``keep - 1`` commits.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 8):
        if keep < 2:
            raise ValueError("at least two versions are needed")
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self._log_schema = "batch_id bigint, version string"

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._log_schema).json(f"{self.path}/_commits/*")
        except AnalysisException:  # nothing committed yet
            return self.spark.createDataFrame([], self._log_schema)

    def committed(self, batch_id: int) -> bool:
        return not self._log().where(F.col("batch_id") >= batch_id).isEmpty()

    def read(self) -> DataFrame:
        last = self._log().orderBy(F.desc("batch_id")).limit(1).collect()
        if not last:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{last[0].version}")

    def commit(self, state: DataFrame, batch_id: int) -> None:
        if self.committed(batch_id):
            return
        slot = f"slot-{batch_id % self.keep}"
        state.write.mode("overwrite").parquet(f"{self.path}/{slot}")
        line = self.spark.createDataFrame([(batch_id, slot)], self._log_schema)
        line.coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/{slot}")


class BucketTable:
    """A keyed table in folders by a hash of the key; a batch rewrites only the buckets it touches.

    A batch writes the new content of its buckets to a folder of its own. The commit line of a
    batch says for every bucket which batch wrote it last, so a reader opens just the buckets
    it asks for, and the table as of an earlier batch is one more lookup. Of the commit lines the
    last ``KEPT`` stay. The number of buckets is chosen so that one fits a task well; a
    bucket of many rows is written as several files.
    """

    KEPT = 64

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def places(self, as_of: int | None = None) -> dict[int, int]:
        """Bucket -> the batch that wrote it last, up to the batch ``as_of``; empty buckets are left out."""
        try:
            lines = self.spark.read.schema("batch_id bigint, places map<string,bigint>").json(f"{self.path}/_commits/*")
            lines = lines if as_of is None else lines.where(F.col("batch_id") <= as_of)
            last = lines.orderBy(F.desc("batch_id")).limit(1).collect()
        except AnalysisException:  # nothing committed yet
            last = []
        return {int(b): k for b, k in last[0].places.items()} if last else {}

    def committed(self, batch_id: int) -> bool:
        try:
            return not self.spark.read.schema("batch_id bigint").json(f"{self.path}/_commits/*").where(F.col("batch_id") >= batch_id).isEmpty()
        except AnalysisException:
            return False

    def read(self, buckets: list[int] | None = None, as_of: int | None = None) -> DataFrame:
        paths = [f"{self.path}/batch_id={k}/bucket={b}" for b, k in sorted(self.places(as_of).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, touched: list[int], batch_id: int) -> None:
        """``rows`` are from now on all rows of the ``touched`` buckets; a committed batch is left as it is."""
        if self.committed(batch_id):
            return
        places = self.places()
        folder = f"{self.path}/batch_id={batch_id}"
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        held = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select("bucket").distinct()  # names of folders
        here = {r[0] for r in held.collect()}
        places = {b: k for b, k in places.items() if b not in touched} | {b: batch_id for b in here}
        line = self.spark.createDataFrame([(batch_id, {str(b): k for b, k in places.items()})], "batch_id bigint, places map<string,bigint>")
        line.coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/{batch_id % self.KEPT}")
