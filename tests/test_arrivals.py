"""State of a feed across restarts, and corrections between two snapshots."""

import datetime as dt

from ledgerwatch.operators.state import changes_between, replayed
from ledgerwatch.streaming.arrivals import Arrivals

DAY = dt.datetime(2026, 9, 1)
SCHEMA = "id string, at timestamp, run int"


def test_repeats_and_late_rows_over_restarts(spark, tmp_path):
    """Two days of grace; each run is a new query on the same checkpoint."""
    feed = Arrivals(spark, str(tmp_path / "feed"), SCHEMA, "id", "at", "2 days")
    assert feed.kept().count() == 0
    runs = [
        [("a", 0), ("b", 5), ("a", 0)],  # twice in one batch; the mark is then day 3
        [("a", 0), ("b", 5), ("c", 4), ("d", 2), ("e", 9)],  # repeats, late inside the mark (c), behind it (d)
        [("e", 9), ("f", 6), ("g", 8)],  # a repeat and a late row after another restart; f is behind day 7
    ]
    for i, rows in enumerate(runs):
        feed.land(spark.createDataFrame([(k, DAY + dt.timedelta(days=d), i) for k, d in rows], SCHEMA).coalesce(1))
        feed.run()
    assert sorted((r.id, r.run) for r in feed.kept().collect()) == [("a", 0), ("b", 0), ("c", 1), ("e", 1), ("g", 2)]
    feed.run()  # nothing new
    assert feed.kept().count() == 5
    got = sorted((r.id, r.run, r.outcome) for r in feed.outcomes(["run"]).where("run > 0").collect())
    assert got == [
        ("a", 1, "REPEAT"), ("b", 1, "REPEAT"), ("c", 1, "KEPT"), ("d", 1, "LATE"), ("e", 1, "KEPT"), ("e", 2, "REPEAT"), ("f", 2, "LATE"), ("g", 2, "KEPT"),
    ]


def test_changes_add_up_to_the_last_snapshot(spark):
    kind = "key string, a int, flags array<string>, seen int"
    snapshots = [
        [("x", 1, ["p"], 1), ("y", None, [], 1), ("z", 3, None, 1)],
        [("x", 1, ["p"], 2), ("y", 2, [], 2), ("w", 4, ["q"], 2)],
        [("z", 3, None, 3), ("y", 2, [], 3), ("w", 4, ["q", "r"], 3)],
    ]
    before, log, ops = spark.createDataFrame([], kind), None, []
    for i, rows in enumerate(snapshots):
        after = spark.createDataFrame(rows, kind)
        step = changes_between(before, after, "key", ignore=("seen",)).selectExpr("*", f"{i} AS batch")
        ops.append(sorted((r.op, r.key) for r in step.collect()))
        log, before = step if log is None else log.unionByName(step), after
    assert ops == [
        [("INSERT", "x"), ("INSERT", "y"), ("INSERT", "z")],
        [("INSERT", "w"), ("RETRACT", "z"), ("UPDATE", "y")],
        [("INSERT", "z"), ("RETRACT", "x"), ("UPDATE", "w")],
    ]
    got = replayed(log, "key", "batch").select("key", "a", "flags")
    assert sorted(map(str, got.collect())) == sorted(map(str, before.select("key", "a", "flags").collect()))
