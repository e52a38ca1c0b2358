"""Append-only file feeds and the jobs that run over them to the end."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ledgerwatch.operators.state import replayed
from ledgerwatch.plans.workspace import Workspace
from ledgerwatch.session import shared_dir
from ledgerwatch.sources import derived
from ledgerwatch.sources.tables import SCHEMAS
from ledgerwatch.streaming.arrivals import Arrivals
from ledgerwatch.streaming.books import CoverageRefresh, LoanRefresh
from ledgerwatch.streaming.refresh import AlertRefresh
from ledgerwatch.streaming.rings import RingState
from ledgerwatch.streaming.windows import pane_totals, window_totals

SLIDE_HOURS = 12
FIRST_DAY, ARRIVAL_DAYS, ARRIVAL_LATE = dt.date(2026, 7, 31), 20, "25 days"


def table_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New files of an append-only table as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def given_stream(w: Workspace, name: str) -> DataFrame:
    return table_stream(w.spark, f"{w.data_dir.rstrip('/')}/{name}.parquet*", w.given(name).schema)


def run_to_end(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop; a restart continues from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each_batch)
        .start()
    )
    query.awaitTermination()


def land(path: str) -> Callable[[DataFrame, int], None]:
    """A batch sink with one folder per batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def ingested_events(w: Workspace) -> DataFrame:
    """Events landed by a stream, counted per type."""
    root = shared_dir(w.spark, "ingest")
    stream = given_stream(w, "events")
    run_to_end(stream, land(f"{root}/events"), f"{root}/_checkpoint")
    landed = w.spark.read.schema(stream.schema.add("batch_id", LongType())).parquet(f"{root}/events")
    return landed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def transaction_stream(w: Workspace) -> DataFrame:
    """Ordinary and planted transactions as one stream."""
    n = derived.customer_count(w.given("customer"))
    return derived.ordinary_transactions(given_stream(w, "orders"), n).unionByName(
        derived.planted_transactions(given_stream(w, "customer"), n)
    )


def refreshed_findings(w: Workspace) -> DataFrame:
    """Findings after a streaming refresh over all transactions."""
    root = shared_dir(w.spark, "refresh")
    refresh = AlertRefresh(w.spark, root, w.accounts, w.customers, w.watchlist)
    run_to_end(transaction_stream(w), refresh, f"{root}/_checkpoint")
    return refresh.findings.read().select(
        "finding_id", "alert_id", "account_id", "customer_id", "finding_type", "severity", "risk_score", "finding_status",
        "summary", "evidence_count", "confidence",
    )


def refreshed_rings(w: Workspace, batches: int = 3) -> DataFrame:
    """Rings after a delta refresh in batches; a hash deals the transactions, so every batch has late rows."""
    rings = RingState(w.spark, shared_dir(w.spark, "ring-refresh"))
    part, before = F.pmod(F.xxhash64("txn_id"), F.lit(batches)), None
    for i in range(batches):
        rows = w.transactions.where(part == i)
        newest = rows.agg(F.max("txn_ts")).first()[0]
        t = max((x for x in (newest, before) if x is not None), default=None)
        if t is not None:
            rings.update(rows, i, t, before)
            before = t
    return rings.rings.read()


def two_batches(w: Workspace, early: dt.datetime, held_back: str) -> AlertRefresh:
    """A refresh in two batches; with a store it is run once.

    The second batch holds what happened from ``early`` on, and rows of before that come late: those whose id ends in ``held_back``.
    """

    def build(path: str) -> AlertRefresh:
        refresh = AlertRefresh(w.spark, path, w.accounts, w.customers, w.watchlist)
        rows, first = w.transactions.select(StructType.fromDDL(SCHEMAS["transactions"]).names), (F.col("txn_ts") < F.lit(early)) & ~F.col("txn_id").endswith(held_back)
        refresh(rows.where(first), 0)
        refresh(rows.where(~first), 1)
        return refresh

    name = f"two-batches-{early:%Y%m%d%H%M%S}-{held_back}"
    return w.store.folder(name, build) if w.store else build(shared_dir(w.spark, name))


def alert_corrections(w: Workspace, early: dt.datetime, held_back: str) -> DataFrame:
    """Alerts that the batches of ``two_batches`` added, changed or took back, and the state that these amount to."""
    log = two_batches(w, early, held_back).changes()
    shown = ["alert_id", "typology", "risk_score", "recommended_action", "flag_names", "inflow_amt_48h"]
    by_batch = log.select(F.col("batch_id").cast("string").alias("batch"), "op", *shown)
    return by_batch.unionByName(replayed(log, "alert_id", "batch_id").select(F.lit("ALL").alias("batch"), F.lit("STATE").alias("op"), *shown))


def arrivals(w: Workspace, first_day: dt.date = FIRST_DAY, span: int = ARRIVAL_DAYS, late: str = ARRIVAL_LATE) -> DataFrame:
    """Outcome of each transaction of a feed in three runs, by arrival and day.

    A run brings the transactions of ``span`` days. Ids that end in 5 come again with the next run, those in 3 come one run
    late, and those in 7 of the first days come with the last run, partly behind the watermark.
    """
    schema = SCHEMAS["transactions"].replace("timestamp_ntz", "timestamp") + ", arrival int"
    feed = Arrivals(w.spark, shared_dir(w.spark, "arrivals"), schema, "txn_id", "txn_ts", late)
    rows = w.transactions.select(StructType.fromDDL(SCHEMAS["transactions"]).names).withColumn("txn_ts", F.col("txn_ts").cast("timestamp"))
    own = F.greatest(F.lit(0), F.least(F.lit(2), F.floor(F.datediff(F.col("txn_ts"), F.lit(first_day)) / span))).cast("int")
    last = F.right("txn_id", F.lit(1))
    once = F.when(last == "3", F.least(F.lit(2), own + 1)).when((last == "7") & (own == 0), F.lit(2)).otherwise(own)
    dealt = rows.withColumn("arrival", F.explode(F.when((last == "5") & (own < 2), F.array(own, own + 1)).otherwise(F.array(once))))
    for run in range(3):
        feed.land(dealt.where(F.col("arrival") == run))
        feed.run()
    return feed.outcomes(["arrival"]).groupBy("outcome", "arrival", F.col("txn_ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_inr").alias("amount")
    )


def states_as_of(w: Workspace, early: dt.datetime, held_back: str) -> DataFrame:
    """Findings, with their evidence counted, as of two times of one refresh (``two_batches``)."""
    refresh = two_batches(w, early, held_back)

    def seen(name: str, when: dt.datetime) -> DataFrame:
        state = refresh.as_of(when)
        counted = state.evidence.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n_evidence"))
        rings = state.rings.agg(F.count(F.lit(1))).scalar()
        return state.findings.join(counted, "finding_id", "left").select(
            F.lit(name).alias("state"), "finding_id", "alert_id", "severity", "risk_score", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), rings.alias("rings")
        )

    return seen("EARLY", early).unionByName(seen("LATE", dt.datetime(9999, 1, 1)))


def refreshed_coverage(w: Workspace, batches: int = 3) -> DataFrame:
    """Daily coverage after a refresh in batches; a hash deals the positions of a day to the batches."""
    refresh = CoverageRefresh(w.spark, shared_dir(w.spark, "coverage-refresh"))
    for i in range(batches):
        mine = lambda rows: rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(batches)) == i)  # noqa: B023, E731
        refresh.update(i, hqla_holdings=mine(w.hqla_holdings), cashflow_positions=mine(w.cashflow_positions))
    return refresh.coverage()


def refreshed_loans(w: Workspace, batches: int = 3) -> DataFrame:
    """Loan warnings after a refresh in batches: the first holds earlier editions of some loans, the last all of these as they are."""
    refresh, part = LoanRefresh(w.spark, shared_dir(w.spark, "loan-refresh"), w.customers), F.pmod(F.xxhash64("loan_id"), F.lit(batches))
    for i in range(batches):
        rows = w.loans.where(part == i)
        if i == 0:
            rows = rows.withColumns({"dpd": F.col("dpd") + 45, "bureau_score": F.lit(500)})
        if i == batches - 1:
            rows = rows.unionByName(w.loans.where(part == 0))
        refresh.update(rows, i)
    return refresh.warnings.read()


def sliding_activity(w: Workspace, events: str | None = None, max_files: int = 100) -> DataFrame:
    """48-hour sliding activity over the event stream (user as account, value as amount).

    ``events``: another folder of event files; ``max_files`` of them make a batch.
    """
    root = shared_dir(w.spark, "sliding")
    schema = w.given("events").schema
    stream = table_stream(w.spark, events, schema, max_files) if events else given_stream(w, "events")
    stream = stream.select(
        F.expr("concat('ACC', lpad(CAST(user_id AS STRING), greatest(7, length(CAST(user_id AS STRING))), '0'))").alias("account_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,2)").alias("amount"), "event_type",
    )
    slide = f"{SLIDE_HOURS} hours"
    write = land(f"{root}/panes")
    run_to_end(stream, lambda batch, batch_id: write(pane_totals(batch, "account_id", "ts", "amount", "event_type", slide), batch_id), f"{root}/_checkpoint")
    panes = w.spark.read.schema("account_id string, pane timestamp, kind string, n bigint, amount decimal(28,2), batch_id bigint").parquet(f"{root}/panes")
    return window_totals(panes, "account_id", slide=slide)
