"""State that batches change in part: bucket tables, delta rings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions.windows import fixed
from ledgerwatch.operators.cycles import cycles
from ledgerwatch.operators.state import BucketTable
from ledgerwatch.sources.tables import SCHEMAS
from ledgerwatch.streaming.rings import RingState
from test_cycles import T0, rows_of

COLUMNS = ["a1", "a2", "a3", "cycles", "amt", "ring"]


def test_bucket_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], buckets=8)
    assert table.read().count() == 0 and table.places() == {} and not table.committed(0)
    rows = spark.createDataFrame([(i, "a") for i in range(40)], "k int, v string")
    table.replace(rows, list(range(8)), 0)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    change = spark.createDataFrame([(3, "b")], "k int, v string")
    (bucket,) = table.touched(change)
    table.replace(table.read([bucket]).where("k <> 3").unionByName(change), [bucket], 1)
    assert {r.k: r.v for r in table.read().collect()} == {i: "b" if i == 3 else "a" for i in range(40)}
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert {p.parent.name for p in (tmp_path / "t").rglob("batch_id=1/*/*.parquet")} == {f"bucket={bucket}"}
    assert {b for b, k in table.places().items() if k == 1} == {bucket}
    # a committed batch is left as it is, a bucket can become empty, an earlier state can be read
    table.replace(table.read([bucket]).limit(0), [bucket], 1)
    assert table.read().count() == 40
    table.replace(table.read([bucket]).limit(0), [bucket], 2)
    assert table.read([bucket]).count() == 0 and bucket not in table.places()
    assert {r.k: r.v for r in table.read(as_of=0).collect()} == {i: "a" for i in range(40)} and table.read(as_of=1).count() == 40


def test_bucket_table_keeps_the_last_commit_lines(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k int", ["k"], buckets=2)
    table.KEPT = 2
    for i in range(4):
        table.replace(table.read().unionByName(spark.createDataFrame([(i,)], "k int")), [0, 1], i)
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 3] and len(list((tmp_path / "t" / "_commits").iterdir())) == 2


def frame(spark, transfers):
    return spark.createDataFrame(rows_of(transfers), SCHEMAS["transactions"])


def values(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("seed,nodes", [(1, 6), (2, 3)])
def test_batches_equal_the_full_run(spark, tmp_path, seed, nodes):
    """Over 14 days, so that transfers leave the window; a third of the rows come late."""
    rnd = random.Random(seed)
    names, state, past, before = [f"A{i}" for i in range(nodes)], RingState(spark, str(tmp_path / "r"), buckets=4), [], None
    for batch in range(3):
        low = 0 if batch == 0 else 5000 * batch - 1500
        rows = [
            (rnd.choice(names), rnd.choice(names), T0 + dt.timedelta(minutes=rnd.randrange(low, 5000 * (batch + 1))), rnd.choice(["1000000.00", "1100000.00", "2500000.00", "900.00"]))
            for _ in range(40 if batch else 60)
        ]
        past += rows
        t = max(r[2] for r in past)
        got = state.update(frame(spark, rows), batch, t, before)
        want = values(cycles(frame(spark, past), fixed(spark, t)))
        assert values(got) == want and (batch or want)
        before = t
    assert values(state.update(frame(spark, rows), batch, t, before)) == want  # again


def test_a_batch_opens_only_what_it_touches(spark, tmp_path):
    """200 rings stay; the batch closes one more, through an account that pays 300 others."""
    hour = dt.timedelta(hours=1)
    start = T0 - dt.timedelta(days=2)
    old = [x for i in range(200) for x in ((f"R{i}a", f"R{i}b", start, "2000000.00"), (f"R{i}b", f"R{i}c", start + hour, "2000000.00"), (f"R{i}c", f"R{i}a", start + 2 * hour, "2000000.00"))]
    hub = [("H", f"P{i}", start, "2000000.00") for i in range(300)] + [("P7", "Q", start + hour, "2000000.00")]
    state = RingState(spark, str(tmp_path / "r"), buckets=16)
    state.update(frame(spark, old + hub), 0, T0, None)
    assert state.rings.read().count() == 200
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "r" / "rings").rglob("*.parquet")}
    state.update(frame(spark, [("Q", "H", T0 + hour, "2000000.00")]), 1, T0 + hour, T0)
    assert state.rings.read().count() == 201 and state.rings.read().where("a1 = 'H'").first().ring == "H>P7>Q"
    out, into = state.around(spark.createDataFrame([("Q", "H")], "src string, dst string"), T0 - dt.timedelta(days=7), T0 + hour)
    assert out.count() == 301 and {r.src for r in out.collect()} == {"H", "Q"} and [r.src for r in into.collect()] == ["P7"]
    assert len({k for k in state.rings.places().values()}) == 2 and sum(k == 1 for k in state.rings.places().values()) <= 3
    assert {p: p.stat().st_mtime_ns for p in files} == files
    buckets = {r[0] for r in spark.createDataFrame([("H",), ("Q",)], "n string").select(state._bucket("n")).collect()}
    read = state.transfers("out", T0 - dt.timedelta(days=7), T0 + hour, sorted(buckets))
    assert read.count() < 450 < state.transfers("out", T0 - dt.timedelta(days=7), T0 + hour).count()
    assert set(r[0] for r in read.select(F.col("bucket")).distinct().collect()) <= buckets
