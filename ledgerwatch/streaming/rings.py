"""Delta refresh of the fund-flow cycles.

Kept per run folder: the large transfers, dealt by the payer (``out``) and once more by the payee
(``into``), in folders by day, bucket and batch; and the rings in a ``BucketTable``.

A batch changes only rings on an edge that it touches: an edge with a new transfer, or with one that
has left the seven days since the batch before. Of such an edge u -> v the walks u -> v -> w -> u are
opened from the shorter of two lists, the payees of v and the payers to u, and checked against the
other. The buckets of the touched accounts are all that is read of the transfers. The walks found are
counted anew on their transfers within the seven days; every other ring stays as it is. A ring whose
transfers have all left is among the walks too, as the transfers that leave count as edges here, and
goes because nothing is found on it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.windows import fixed
from ledgerwatch.operators.cycles import DAYS, WALK, count_cycles, large_transfers, possible_walks
from ledgerwatch.operators.state import BucketTable
from ledgerwatch.session import stage_table

TRANSFER = "src string, dst string, ts timestamp_ntz, amt decimal(18,2), k bigint"
RING = "a1 string, a2 string, a3 string, cycles bigint, amt decimal(18,2), ring string"
SIDES = {"out": "src", "into": "dst"}


class RingState:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.rings = BucketTable(spark, f"{self.root}/rings", RING, ["a1"], buckets)

    def _bucket(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def _stage(self, rows: DataFrame, name: str) -> DataFrame:
        return stage_table(rows, name, f"{self.root}/stage")

    def transfers(self, side: str, first: dt.datetime, last: dt.datetime, buckets: list[int] | None = None) -> DataFrame:
        """Kept transfers of a span of time, of some buckets of one side: only their folders are read."""
        schema = f"{TRANSFER}, txn_date date, bucket int, batch_id bigint"
        days = [(first.date() + dt.timedelta(days=i)).isoformat() for i in range((last.date() - first.date()).days + 1)]
        try:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{side}").parquet(f"{self.root}/{side}/txn_date={{{','.join(days)}}}")
        except AnalysisException:  # no transfers on these days
            return self.spark.createDataFrame([], schema)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.where(F.col("ts").between(F.lit(first), F.lit(last)))

    def land(self, rows: DataFrame, batch_id: int, t: dt.datetime) -> DataFrame:
        """Keep the large transfers of a batch on both sides; a batch that is run again replaces itself."""
        new = self._stage(large_transfers(rows, fixed(self.spark, t)), "new")
        for side, node in SIDES.items():
            dealt = new.withColumns({"txn_date": F.col("ts").cast("date"), "bucket": self._bucket(node), "batch_id": F.lit(batch_id).cast("bigint")})
            dealt.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("txn_date", "bucket", "batch_id").parquet(
                f"{self.root}/{side}"
            )
        return new

    def around(self, edges: DataFrame, first: dt.datetime, last: dt.datetime) -> tuple[DataFrame, DataFrame]:
        """Transfers out of both ends of the edges, and into their payers."""
        ends = self._stage(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "ends")
        payers = edges.select(F.col("src").alias("node")).distinct()
        found = {}
        for side, nodes in (("out", ends), ("into", payers)):
            buckets = [r[0] for r in nodes.select(self._bucket("node")).distinct().collect()]  # at most self.buckets
            rows = self.transfers(side, first, last, buckets)
            found[side] = rows.join(nodes.withColumnRenamed("node", SIDES[side]).hint("merge"), SIDES[side], "left_semi").select("src", "dst", "ts", "amt", "k")
        return found["out"], found["into"]

    def touched_walks(self, touched: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
        """Closed walks through a touched edge, from each starting point."""
        after = self._stage(out.select(F.col("src").alias("v"), F.col("dst").alias("w")).distinct(), "after")
        before = self._stage(into.select(F.col("src").alias("w"), F.col("dst").alias("u")).distinct(), "before")
        edges = (
            touched.select(F.col("src").alias("u"), F.col("dst").alias("v"))
            .join(after.groupBy("v").agg(F.count(F.lit(1)).alias("n_after")).hint("merge"), "v")
            .join(before.groupBy("u").agg(F.count(F.lit(1)).alias("n_before")).hint("merge"), "u")
        )
        forward = edges.where("n_after <= n_before").join(after.hint("merge"), "v").join(before.hint("merge"), ["w", "u"], "left_semi")
        backward = edges.where("n_after > n_before").join(before.hint("merge"), "u").join(after.hint("merge"), ["v", "w"], "left_semi")
        closed = forward.select("u", "v", "w").unionByName(backward.select("u", "v", "w"))
        walk = lambda *names: F.struct(*[F.col(x).alias(a) for x, a in zip(names, WALK, strict=True)])
        rotations = F.array(walk("u", "v", "w"), walk("v", "w", "u"), walk("w", "u", "v"))
        return closed.select(F.explode(rotations).alias("walk")).select("walk.*").distinct()

    def update(self, rows: DataFrame, batch_id: int, t: dt.datetime, before: dt.datetime | None) -> DataFrame:
        """Take in a batch (reference time ``t``, that of the batch before ``before``); gives all rings.

        Late rows are rows like any other. A batch that has been committed is left as it is.
        """
        if self.rings.committed(batch_id):
            return self.rings.read()
        span = dt.timedelta(days=DAYS)
        start, was = t - span, (before or t) - span
        touched = self.land(rows, batch_id, t).select("src", "dst")
        if was < start:
            touched = touched.unionByName(self.transfers("out", was, start).where(F.col("ts") < F.lit(start)).select("src", "dst"))
        touched = self._stage(touched.distinct(), "touched")
        out, into = self.around(touched, was, t)
        walks = self._stage(self.touched_walks(touched, out, into), "touched-walks")
        # transfers out of a touched account are all in ``out``; of the others those into a payer count
        ends = self.spark.read.schema("node string").parquet(f"{self.root}/stage/ends").withColumnRenamed("node", "src")
        big = out.unionByName(into.join(ends.hint("merge"), "src", "left_anti")).where(F.col("ts") >= F.lit(start))
        legs = walks.select(F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("a1", "a2"), ("a2", "a3"), ("a3", "a1"))])).alias("e"))
        big = big.join(legs.select("e.*").distinct().hint("merge"), ["src", "dst"], "left_semi").groupBy("src", "dst", "ts", "amt").agg(F.sum("k").alias("k"))
        big = self._stage(big, "near-transfers")
        found = count_cycles(self._stage(possible_walks(walks, big), "possible-walks"), big, f"{self.root}/stage")
        buckets = self.rings.touched(walks)
        kept = self.rings.read(buckets).join(walks.hint("merge"), WALK, "left_anti")
        self.rings.replace(kept.unionByName(found.select(kept.columns)), buckets, batch_id)
        return self.rings.read()
