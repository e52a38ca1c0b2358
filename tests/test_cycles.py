"""Cycle counts against a brute-force triple loop, including busy rings and self payments."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest

from ledgerwatch.functions.windows import fixed
from ledgerwatch.operators.cycles import cycles, round_trips
from ledgerwatch.sources.tables import SCHEMAS

T0 = dt.datetime(2026, 9, 28, 23, 59)


def rows_of(transfers):
    return [
        (f"T{i}", a, b, ts, "NEFT", "DEBIT", Decimal(amt), "D", "10.0.0.1", "IN", "NORMAL")
        for i, (a, b, ts, amt) in enumerate(transfers)
    ]


def brute_force(transfers):
    out = {}
    for a, b, c in itertools.product(transfers, repeat=3):
        if a[1] != b[0] or b[1] != c[0] or c[1] != a[0]:
            continue
        if not (a[2] < b[2] < c[2] <= a[2] + dt.timedelta(hours=72)):
            continue
        if abs(Decimal(a[3]) - Decimal(c[3])) <= Decimal("0.1") * Decimal(a[3]):
            n, amt = out.get((a[0], b[0], c[0]), (0, Decimal(0)))
            out[(a[0], b[0], c[0])] = (n + 1, max(amt, Decimal(a[3])))
    return out


def found(spark, transfers):
    df = spark.createDataFrame(rows_of(transfers), SCHEMAS["transactions"])
    rows = cycles(df, fixed(spark, T0)).collect()
    return {(r.a1, r.a2, r.a3): (r.cycles, r.amt) for r in rows}


@pytest.mark.parametrize("seed,nodes,n", [(1, 3, 60), (2, 5, 70), (3, 2, 40), (4, 1, 12)])
def test_random_transfers_match_brute_force(spark, seed, nodes, n):
    rnd = random.Random(seed)
    names = [f"A{i}" for i in range(nodes)]
    transfers = [
        (
            rnd.choice(names),
            rnd.choice(names),
            T0 - dt.timedelta(minutes=rnd.choice([rnd.randrange(0, 9000), 30 * rnd.randrange(0, 200)])),
            rnd.choice(["1000000.00", "1100000.00", "1111111.11", "1210000.00", "2500000.00"]),
        )
        for _ in range(n)
    ]
    assert found(spark, transfers) == brute_force(transfers)


def test_edges_of_the_rectangle(spark):
    def ring(c_hours, c_amt):
        start = T0 - dt.timedelta(hours=100)
        return [
            ("A", "B", start, "2000000.00"),
            ("B", "C", start + dt.timedelta(hours=1), "2000000.00"),
            ("C", "A", start + dt.timedelta(hours=c_hours), c_amt),
        ]

    assert found(spark, ring(72, "1800000.00")) == {("A", "B", "C"): (1, Decimal("2000000.00"))}
    assert found(spark, ring(72, "2200000.00")) == {("A", "B", "C"): (1, Decimal("2000000.00"))}
    assert found(spark, ring(73, "2000000.00")) == {}
    assert found(spark, ring(72, "1799999.99")) == {}
    assert found(spark, ring(1, "2000000.00")) == {}


def test_round_trips_count_every_member(spark):
    start = T0 - dt.timedelta(hours=50)
    transfers = [
        ("A", "B", start, "2000000.00"),
        ("B", "C", start + dt.timedelta(hours=1), "1500000.00"),
        ("C", "A", start + dt.timedelta(hours=2), "2000000.00"),
        ("C", "A", start + dt.timedelta(hours=3), "2100000.00"),
    ]
    df = spark.createDataFrame(rows_of(transfers), SCHEMAS["transactions"])
    got = {r.account_id: r for r in round_trips(cycles(df, fixed(spark, T0))).collect()}
    assert set(got) == {"A", "B", "C"}
    assert all(r.round_trip_cycles_7d == 2 and r.round_trip_ring == ["A>B>C"] for r in got.values())


def test_old_and_small_transfers_do_not_count(spark):
    start = T0 - dt.timedelta(days=8)
    old = [("A", "B", start, "2000000.00"), ("B", "C", start + dt.timedelta(hours=1), "2000000.00"), ("C", "A", start + dt.timedelta(hours=2), "2000000.00")]
    start = T0 - dt.timedelta(days=1)
    small = [("A", "B", start, "999999.99"), ("B", "C", start + dt.timedelta(hours=1), "999999.99"), ("C", "A", start + dt.timedelta(hours=2), "999999.99")]
    assert found(spark, old + small) == {}


@pytest.mark.parametrize("few", [0, 20, 4000])
def test_walks_counted_in_pairs_and_in_blocks_agree(spark, few):
    """Equal transfers, equal times and self payments; ``few`` decides which way a walk is counted."""
    rnd = random.Random(7)
    transfers = [
        (rnd.choice("ABC"), rnd.choice("ABC"), T0 - dt.timedelta(hours=rnd.randrange(0, 100)), rnd.choice(["1000000.00", "1100000.00", "1111111.11"]))
        for _ in range(70)
    ]
    transfers += transfers[:10]
    df = spark.createDataFrame(rows_of(transfers), SCHEMAS["transactions"])
    got = {(r.a1, r.a2, r.a3): (r.cycles, r.amt) for r in cycles(df, fixed(spark, T0), few=few).collect()}
    assert got == brute_force(transfers)


def test_no_stored_table_is_sent_through_the_driver(spark):
    """Stored tables compress well: by the size of their files Spark would broadcast tables that grow with the transfers."""
    start = T0 - dt.timedelta(hours=50)
    ring = [("A", "B", start, "2000000.00"), ("B", "C", start + dt.timedelta(hours=1), "2000000.00"), ("C", "A", start + dt.timedelta(hours=2), "2000000.00")]
    df = spark.createDataFrame(rows_of(ring), SCHEMAS["transactions"])
    for few in (0, 4000):
        plan = cycles(df, fixed(spark, T0), few=few)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
