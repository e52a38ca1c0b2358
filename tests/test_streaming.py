"""Micro-batches over file slices with late rows end in the same state as one batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import small_bank as sb
from ledgerwatch.operators import rules, signals
from ledgerwatch.operators.evidence import evidence_rows, upsert_findings
from ledgerwatch.sources.tables import SCHEMAS, empty_table
from ledgerwatch.streaming import feeds
from ledgerwatch.streaming.refresh import AlertRefresh
from ledgerwatch.streaming.windows import pane_totals, window_totals


@pytest.fixture(scope="module")
def run(spark, workspace, tmp_path_factory):
    """Three slices by a hash of the id, so that every slice holds old and new rows."""
    root = tmp_path_factory.mktemp("stream")
    plain = workspace.transactions.drop("txn_date")
    src = str(root / "in")
    for i in range(3):
        plain.where(F.pmod(F.hash("txn_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(src)
    refresh = AlertRefresh(spark, str(root / "state"), workspace.accounts, workspace.customers, workspace.watchlist)
    stream = feeds.table_stream(spark, src, SCHEMAS["transactions"], max_files=1)
    feeds.run_to_end(stream, refresh, str(root / "ckpt"))
    return refresh, src, str(root / "ckpt")


COLS = ["alert_id", "finding_type", "severity", "risk_score", "summary", "evidence_count"]


def values(df, cols=COLS):
    return sorted(tuple(r) for r in df.select(cols).collect())


def test_final_state_equals_batch(spark, workspace, run):
    refresh, _, _ = run
    alerts = workspace.alerts
    want = upsert_findings(empty_table(spark, "risk_findings"), alerts)
    got = refresh.findings.read()
    current = got.join(want.select("alert_id"), "alert_id", "left_semi")
    assert values(current) == values(want)
    assert refresh.clock.read().first().t == sb.T0
    keys = ["finding_id", "evidence_type"]
    seen = {tuple(r) for r in refresh.evidence.read().select(keys).collect()}
    assert {tuple(r) for r in evidence_rows(alerts, want).select(keys).collect()} <= seen
    assert refresh.evidence.read().count() == len(seen)  # nothing twice


def test_last_activity_equals_full_history(workspace, run):
    refresh, _, _ = run
    recent = refresh.transactions(refresh.clock.read().first().scanned_from, sb.T0.date())
    got = {tuple(r) for r in refresh._last_activity(recent, sb.T0).collect()}
    want = {tuple(r) for r in signals.last_activity_before(workspace.transactions, workspace.t).collect()}
    assert got == want


def test_a_repeated_batch_changes_nothing(spark, run):
    refresh, src, _ = run
    before, n = values(refresh.findings.read()), refresh.evidence.read().count()
    refresh(spark.read.schema(SCHEMAS["transactions"]).parquet(src), 1)
    assert values(refresh.findings.read()) == before and refresh.evidence.read().count() == n


def test_feed_moves_the_windows_and_findings_stay(spark, run):
    """The four-row feed raises no alert of its own; earlier findings stay although their alerts are gone."""
    refresh, src, ckpt = run
    before = values(refresh.findings.read())
    sb.demo_feed(spark, "ACC0000001").coalesce(1).write.mode("append").parquet(src)
    feeds.run_to_end(feeds.table_stream(spark, src, SCHEMAS["transactions"], max_files=1), refresh, ckpt)
    assert refresh.clock.read().first().t == dt.datetime(2026, 10, 4, 10, 9)
    assert "MONEY_MULE" not in {r.typology for r in refresh.alerts(3).collect()}
    assert {b[0] for b in before} <= {b[0] for b in values(refresh.findings.read())}


def test_repeated_ids_can_be_dropped(spark, tmp_path):
    from ledgerwatch.streaming.windows import deduplicated

    rows = [dict(txn_id=i, account_id="A", txn_ts=sb.T0) for i in ("x", "y", "x", "x")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sb.transactions(spark, rows).write.parquet(src)
    stream = feeds.table_stream(spark, src, SCHEMAS["transactions"]).withColumn("txn_ts", F.col("txn_ts").cast("timestamp"))
    feeds.run_to_end(deduplicated(stream), feeds.land(out), str(tmp_path / "ckpt"))
    assert sorted(r.txn_id for r in spark.read.parquet(out).collect()) == ["x", "y"]


def test_sliding_windows_do_not_depend_on_the_batches(workspace, tmp_path):
    """The given file, and the same events in four files of early and late rows, one file per batch."""
    src = str(tmp_path / "in")
    workspace.given("events").repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(src)
    rows = [sorted(tuple(r) for r in feeds.sliding_activity(workspace, *how).collect()) for how in ((), (src, 1))]
    assert rows[0] and rows[0] == rows[1]


def test_panes_equal_brute_force(spark):
    """Windows of 4 panes; at most one pane row per event."""
    events = [("A", m, k, a) for m, k, a in ((0, "x", 5), (1, "x", 7), (16, "y", 1), (44, "x", 2), (200, "x", 9), (215, "y", 3), (1000, "x", 4))] + [("B", 59, "y", 6)]
    base = dt.datetime(2026, 9, 1)
    rows = spark.createDataFrame([(u, base + dt.timedelta(minutes=m), k, a) for u, m, k, a in events], "u string, ts timestamp, kind string, a bigint")
    panes = pane_totals(rows, "u", "ts", "a", "kind", "15 minutes")
    assert panes.count() == 7 <= len(events)
    got = {(r.u, r.window_start): (r.txn_count, r.amount, r.distinct_types) for r in window_totals(panes, "u", "60 minutes", "15 minutes").collect()}
    want = {}
    for u in "AB":
        for i in range(-4, 80):
            inside = [e for e in events if e[0] == u and 15 * i <= e[1] < 15 * i + 60]
            if inside:
                want[u, base + dt.timedelta(minutes=15 * i)] = (len(inside), sum(e[3] for e in inside), len({e[2] for e in inside}))
    assert got == want
