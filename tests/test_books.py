"""Loans and liquidity: every boundary, caps that bind, stress scenarios."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerwatch.operators import credit, liquidity
from ledgerwatch.sources.tables import SCHEMAS


def test_asset_class_and_stage(spark):
    rows = spark.createDataFrame([(d,) for d in (0, 1, 29, 30, 31, 60, 61, 90, 91)], "dpd int")
    got = rows.select(credit.asset_class(F.col("dpd")), credit.ifrs9_stage(F.col("dpd"))).collect()
    assert [r[0] for r in got] == ["STANDARD", "SMA-0", "SMA-0", "SMA-0", "SMA-1", "SMA-1", "SMA-2", "SMA-2", "NPA"]
    assert [r[1] for r in got] == ["STAGE_1", "STAGE_1", "STAGE_1", "STAGE_2", "STAGE_2", "STAGE_2", "STAGE_2", "STAGE_2", "STAGE_3"]


def test_triggers(spark):
    rows = spark.createDataFrame(
        [(Decimal("90.0"), 1, Decimal("-29.9"), 600), (Decimal("90.1"), 2, Decimal("-30.0"), 599), (Decimal("95.0"), 0, Decimal("0.0"), 700)],
        "utilization_pct decimal(5,1), nach_bounces_90d int, sales_velocity_chg_pct decimal(5,1), bureau_score int",
    )
    got = [r[0] for r in rows.select(credit.ews_triggers()).collect()]
    assert got[0] == []
    assert got[1] == ["HIGH_UTILISATION (90.1%)", "NACH_BOUNCES (2 in 90d)", "SALES_VELOCITY_DROP (-30%)", "LOW_BUREAU_SCORE (599)"]
    assert got[2] == ["HIGH_UTILISATION (95%)"]


def test_actions(spark):
    cases = [("NPA", 4), ("STANDARD", 3), ("SMA-2", 0), ("SMA-0", 2), ("STANDARD", 1), ("SMA-1", 0), ("STANDARD", 0)]
    rows = spark.createDataFrame(cases, "k string, n int")
    got = [r[0] for r in rows.select(credit.ews_action(F.col("k"), F.col("n"))).collect()]
    assert got == ["NPA_RECOVERY_AND_PROVISIONING", credit.COMMITTEE, credit.COMMITTEE, credit.LIMIT_FREEZE, "WATCHLIST", "WATCHLIST", "NO_ACTION"]


def positions(spark, hqla, flows):
    day = dt.date(2026, 9, 28)
    h = spark.createDataFrame([(day, f"i{n}", lvl, Decimal(cut), Decimal(mv)) for n, (lvl, cut, mv) in enumerate(hqla)], SCHEMAS["hqla_holdings"])
    f = spark.createDataFrame([(day, c, k, Decimal(r), b, Decimal(v)) for c, k, r, b, v in flows], SCHEMAS["cashflow_positions"])
    return h, f


FLOWS = [
    ("Retail deposits - stable", "OUTFLOW", "0.10", "1-7D", 1000), ("Unsecured wholesale - non-operational", "OUTFLOW", "0.40", "8-14D", 250),
    ("Interbank placements maturing", "INFLOW", "1.00", "15-30D", 1000),
]


def test_caps_and_inflow_limit_bind(spark):
    h, f = positions(spark, [("LEVEL_1", "0.00", 100), ("LEVEL_2A", "0.00", 90), ("LEVEL_2B", "0.50", 120)], FLOWS)
    caps = liquidity.with_caps(liquidity.hqla_by_level(h)).first()
    assert (caps.l1, caps.l2a, caps.l2b) == (100, 90, 60)
    assert abs(caps.l2b_adj - 15 / 85 * 190) < 1e-9  # on the uncapped 2A
    assert abs(caps.l2_adj - 200 / 3) < 1e-9
    day = liquidity.lcr_daily(h, f).first()
    # outflow 200, inflow 1000 capped at 150, net 50; stock 166.67
    assert (day.gross_outflows, day.capped_inflows, day.net_cash_outflows_30d) == (200, 150, 50)
    assert day.lcr_pct == 333.3 and day.lcr_status == "GREEN"
    assert (day.net_out_1_7d, day.net_out_8_14d, day.net_out_15_30d) == (100, 100, -1000)


def test_status_ladder(spark):
    rows = spark.createDataFrame([(x,) for x in (99.99, 100.0, 109.99, 110.0, 114.99, 115.0)], "r double")
    assert [r[0] for r in rows.select(liquidity.lcr_status(F.col("r"))).collect()] == [
        "REGULATORY_BREACH", "RED_CFP_TRIGGER", "RED_CFP_TRIGGER", "AMBER_ALCO", "AMBER_ALCO", "GREEN",
    ]


def test_stress(spark):
    flows = [f for f in FLOWS if f[1] == "OUTFLOW"]
    h, f = positions(spark, [("LEVEL_1", "0.00", 300), ("LEVEL_2A", "0.00", 50)], flows)
    scen = spark.createDataFrame(
        [("base", 0.0, 0.0, 0.0), ("run", 10.0, 0.0, 0.0), ("mark", 0.0, 100.0, 0.0), ("whole", 0.0, 0.0, 50.0), ("low", -1.0, 0.0, 0.0), ("high", 0.0, 0.0, 100.5)],
        "scenario_id string, retail_run_pct double, l2a_markdown_pct double, wholesale_run_pct double",
    )
    got = {r.scenario_id: r for r in liquidity.stress(scen, h, f).collect()}
    assert got["base"].baseline_lcr_pct == got["base"].stressed_lcr_pct == 175.0  # 350 / 200
    assert got["run"].stressed_lcr_pct == round(100 * 350 / 300, 1)
    assert got["mark"].stressed_lcr_pct == 150.0
    assert got["whole"].stressed_lcr_pct == round(100 * 350 / 275, 1)  # half of the 150 that was not run off
    assert got["low"].status == got["high"].status == "ERROR" and got["low"].stressed_lcr_pct is None


def test_least_skips_null_but_inputs_never_are(spark):
    """Spark's least ignores NULL; sums over an inner join of both sides are never NULL."""
    assert spark.sql("SELECT least(CAST(NULL AS INT), 1)").first()[0] == 1
    h, f = positions(spark, [("LEVEL_1", "0.00", 100)], FLOWS)
    row = liquidity.with_caps(liquidity.hqla_by_level(h)).first()
    assert (row.l2a, row.l2b, row.l2_adj) == (0, 0, 0)


def test_seven_row_change(spark):
    days = [(dt.date(2026, 9, d), float(100 + d), "GREEN", 1e9, 1e9) for d in range(1, 11)]
    lcr = spark.createDataFrame(days, "as_of_date date, lcr_pct double, lcr_status string, hqla_stock double, net_cash_outflows_30d double")
    row = liquidity.liquidity_kpis(lcr).first()
    assert (row.lcr_pct, row.lcr_change_7d, row.hqla_stock_cr) == (110.0, 7.0, 100.0)
