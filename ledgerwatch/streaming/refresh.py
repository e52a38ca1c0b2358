"""Micro-batch refresh of signals, alerts, findings and evidence.

State per run folder, all of it written tables (nothing lives in executors):

* ``transactions``: by day and batch; a batch replaces only its own folders;
* ``activity``: last transaction per account among days that left the ten-day span;
* ``rings``: large transfers and cycles, changed by what a batch touches (``streaming.rings``);
* ``alerts``: one folder per batch; ``changes``: per batch the alerts it added, changed or took back;
* ``findings`` and ``evidence``: dealt by alert into the same buckets, of which a batch reads and
  rewrites those of its alerts;
* ``times``: the reference time of every batch, for reads as of an earlier time;
* ``clock``: reference time and the first day still scanned; written last, so its
  entry marks a finished batch.

A batch reads the days of the last ten days, the small activity table and its buckets
of findings and evidence, whatever the length of the history. Running a batch again writes
the same folders and changes nothing. A late row counts if it falls in a window or
is older than it; nothing is dropped.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.windows import fixed
from ledgerwatch.operators.evidence import new_evidence, upsert_findings
from ledgerwatch.operators.rules import fraud_alerts
from ledgerwatch.operators.signals import WINDOW_HOURS, account_signals
from ledgerwatch.operators.state import BucketTable, SnapshotStore, changes_between
from ledgerwatch.sources.tables import SCHEMAS
from ledgerwatch.streaming.rings import RingState

SPAN_DAYS = 10


@dataclass(frozen=True)
class KeptState:
    """All kept tables as one batch left them."""

    batch_id: int
    t: dt.datetime
    alerts: DataFrame
    rings: DataFrame
    findings: DataFrame
    evidence: DataFrame


class AlertRefresh:
    """Use as ``stream.writeStream.foreachBatch(AlertRefresh(...))``."""

    def __init__(self, spark: SparkSession, root: str, accounts: DataFrame, customers: DataFrame, watchlist: DataFrame, buckets: int = 32):
        self.spark, self.root = spark, root.rstrip("/")
        self.accounts, self.customers, self.watchlist = accounts, customers, watchlist
        self.activity = SnapshotStore(spark, f"{self.root}/activity", "account_id string, last_ts timestamp_ntz")
        self.rings = RingState(spark, f"{self.root}/rings")
        self.findings = BucketTable(spark, f"{self.root}/findings", SCHEMAS["risk_findings"], ["alert_id"], buckets)
        self.evidence = BucketTable(spark, f"{self.root}/evidence", SCHEMAS["risk_evidence"], ["alert_id"], buckets)
        self.times = SnapshotStore(spark, f"{self.root}/times", "batch_id bigint, t timestamp_ntz")
        self.clock = SnapshotStore(spark, f"{self.root}/clock", "t timestamp_ntz, scanned_from date")

    def transactions(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """Landed transactions, of all days or of a span; only the folders of the span are listed."""
        schema = SCHEMAS["transactions"] + ", txn_date date, batch_id bigint"
        root = f"{self.root}/transactions"
        path = root
        if first is not None and last is not None:
            span = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
            path = f"{root}/txn_date={{{','.join(d.isoformat() for d in span)}}}"
        try:
            return self.spark.read.schema(schema).option("basePath", root).parquet(path)
        except AnalysisException:  # no rows on these days
            return self.spark.createDataFrame([], schema)

    def alerts(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/alerts/batch_id={batch_id}")

    def changes(self) -> DataFrame:
        """Corrections of the alerts, batch by batch: op, batch_id and the alert; ``replayed`` gives the last snapshot."""
        return self.spark.read.option("basePath", f"{self.root}/changes").parquet(f"{self.root}/changes/*").withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def as_of(self, when: dt.datetime) -> KeptState:
        """Every kept table as the last batch with a reference time up to ``when`` left it.

        One batch for all tables, so that they belong together; a later batch with late rows does not show.
        """
        last = self.times.read().where(F.col("t") <= F.lit(when)).orderBy(F.desc("batch_id")).first()
        if last is None:
            raise ValueError(f"nothing was refreshed up to {when}")
        k = last.batch_id
        return KeptState(k, last.t, self.alerts(k), self.rings.rings.read(as_of=k), self.findings.read(as_of=k), self.evidence.read(as_of=k))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.clock.committed(batch_id):
            return
        rows = batch.withColumns({"txn_date": F.col("txn_ts").cast("date"), "batch_id": F.lit(batch_id).cast("bigint")})
        rows.persist()  # landed, searched for its latest time and for late rows
        try:
            self._refresh(rows, batch_id)
        finally:
            rows.unpersist()

    def _refresh(self, rows: DataFrame, batch_id: int) -> None:
        (
            rows.hint("rebalance", "txn_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")  # replaces the folders of this batch only
            .partitionBy("txn_date", "batch_id")
            .parquet(f"{self.root}/transactions")
        )
        newest = rows.agg(F.max("txn_ts")).first()[0]
        before = self.clock.read().first()
        times = [x for x in (newest, before.t if before else None) if x is not None]
        if not times:
            return
        t = max(times)
        scanned_from = (t - dt.timedelta(days=SPAN_DAYS)).date()
        self._fold_activity(rows, batch_id, before.scanned_from if before else scanned_from, scanned_from)

        rings = self.rings.update(rows, batch_id, t, before.t if before else None)
        recent = self.transactions(scanned_from, t.date())
        signals = account_signals(
            self.accounts, self.customers, recent, self.watchlist, t=fixed(self.spark, t),
            last_activity=self._last_activity(recent, t), rings=rings,
        )
        fraud_alerts(signals).write.mode("overwrite").parquet(f"{self.root}/alerts/batch_id={batch_id}")
        alerts = self.alerts(batch_id)
        earlier = self.times.read().agg(F.max("batch_id")).first()[0]
        known = alerts.limit(0) if earlier is None else self.alerts(earlier)
        # the time of a refresh is no change of an alert
        changes_between(known, alerts, "alert_id", ignore=("signal_as_of",)).write.mode("overwrite").parquet(f"{self.root}/changes/batch_id={batch_id}")
        buckets = self.findings.touched(alerts)
        self.findings.replace(upsert_findings(self.findings.read(buckets), alerts), buckets, batch_id)
        seen = self.evidence.read(buckets)
        self.evidence.replace(seen.unionByName(new_evidence(seen, alerts, self.findings.read(buckets))), buckets, batch_id)
        self.times.commit(self.times.read().unionByName(self.spark.createDataFrame([(batch_id, t)], self.times.schema)), batch_id)
        self.clock.commit(self.spark.createDataFrame([(t, scanned_from)], self.clock.schema), batch_id)

    def _fold_activity(self, rows: DataFrame, batch_id: int, was_from: dt.date, scanned_from: dt.date) -> None:
        """Add the days that have left the span, and rows of this batch that are older than it was."""
        columns = ["account_id", F.col("txn_ts").alias("last_ts")]
        merged = self.activity.read().unionByName(rows.where(F.col("txn_date") < F.lit(was_from)).select(columns))
        if was_from < scanned_from:
            leaving = self.transactions(was_from, scanned_from - dt.timedelta(days=1))
            merged = merged.unionByName(leaving.select(columns))
        self.activity.commit(merged.groupBy("account_id").agg(F.max("last_ts").alias("last_ts")), batch_id)

    def _last_activity(self, recent: DataFrame, t: dt.datetime) -> DataFrame:
        start = fixed(self.spark, t).minus(F.expr(f"INTERVAL '{WINDOW_HOURS}' HOUR"))
        inside = recent.where(F.col("txn_ts") < start).select("account_id", F.col("txn_ts").alias("last_ts"))
        return (
            self.activity.read()
            .unionByName(inside)
            .groupBy("account_id")
            .agg(F.max("last_ts").alias("last_txn_before_window"))
        )
