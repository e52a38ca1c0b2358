"""Daily liquidity coverage, its composition caps and stress scenarios.

Positions collapse to one row per date by partial aggregation, so everything after
the first aggregate is small whatever the number of lots or cash flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import first_match, latest_row

INFLOW_CAP = 0.75
CRORE = 1e7
# caps of level 2B (15/85 of level 1 + 2A) and of level 2 (2/3 of level 1)
L2B_CAP = 15.0 / 85.0
L2_CAP = 2.0 / 3.0
STRESS_POLICY_REFS = ["ALM-POL 5.1", "ALM-POL 6.2", "LCR Minimum and HQLA Composition"]


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(0)).cast("double")


def hqla_by_level(holdings: DataFrame) -> DataFrame:
    """Post-haircut value per level and date.

    Lots are first summed per (date, level, haircut): one decimal sum per row, and the
    haircut is applied to a handful of sums.
    """
    lots = holdings.groupBy("as_of_date", "hqla_level", "haircut").agg(F.sum("market_value_inr").alias("market_value"))
    value = F.col("market_value") * (1 - F.col("haircut"))
    level = F.col("hqla_level")
    return lots.groupBy("as_of_date").agg(
        _sum_if(level == "LEVEL_1", value).alias("l1"),
        _sum_if(level == "LEVEL_2A", value).alias("l2a"),
        _sum_if(level == "LEVEL_2B", value).alias("l2b"),
        _sum_if(level == "LEVEL_1", F.col("market_value")).alias("l1_market"),
    )


def l2b_capped(l1: Column, l2a: Column, l2b: Column) -> Column:
    return F.least(l2b, F.lit(L2B_CAP) * (l1 + l2a))


def l2_capped(l1: Column, l2a: Column, l2b_adj: Column) -> Column:
    return F.least(l2a + l2b_adj, F.lit(L2_CAP) * l1)


def with_caps(levels: DataFrame) -> DataFrame:
    """Composition caps; the 2B cap is taken on the uncapped 2A amount."""
    return levels.withColumn("l2b_adj", l2b_capped(F.col("l1"), F.col("l2a"), F.col("l2b"))).withColumn(
        "l2_adj", l2_capped(F.col("l1"), F.col("l2a"), F.col("l2b_adj"))
    )


def cash_flows(positions: DataFrame) -> DataFrame:
    """Out- and inflows per date; positions are first summed per (date, flow, category, rate, bucket)."""
    keys = ["as_of_date", "flow_type", "category", "rate", "bucket"]
    summed = positions.groupBy(*keys).agg(F.sum("balance_inr").alias("balance"))
    flow, category, bucket = F.col("flow_type"), F.col("category"), F.col("bucket")
    balance = F.col("balance")
    weighted = balance * F.col("rate")
    out, inn = flow == "OUTFLOW", flow == "INFLOW"

    def net(name: str) -> Column:
        return _sum_if(out & (bucket == name), weighted) - _sum_if(inn & (bucket == name), weighted)

    retail = category.startswith("Retail")
    return summed.groupBy("as_of_date").agg(
        _sum_if(out, weighted).alias("outflows"),
        _sum_if(inn, weighted).alias("inflows_raw"),
        _sum_if(out & retail, balance).alias("retail_deposits"),
        _sum_if(retail, balance).alias("retail_balance"),
        _sum_if(category.contains("non-operational"), balance * (1 - F.col("rate"))).alias("wholesale_residual"),
        net("1-7D").alias("net_1_7"),
        net("8-14D").alias("net_8_14"),
        net("15-30D").alias("net_15_30"),
    )


def capped_inflows(inflows: Column, outflows: Column) -> Column:
    return F.least(inflows, F.lit(INFLOW_CAP) * outflows)


def lcr_status(ratio: Column) -> Column:
    return first_match(
        [(ratio < 100, "REGULATORY_BREACH"), (ratio < 110, "RED_CFP_TRIGGER"), (ratio < 115, "AMBER_ALCO")], "GREEN"
    )


def lcr_daily(holdings: DataFrame, positions: DataFrame) -> DataFrame:
    joined = with_caps(hqla_by_level(holdings)).join(cash_flows(positions), "as_of_date")
    l1, l2a, l2b_adj = F.col("l1"), F.col("l2a"), F.col("l2b_adj")
    outflows, inflows = F.col("outflows"), F.col("inflows_raw")
    stressed_out = outflows + F.lit(0.15) * F.col("retail_deposits")
    stressed_hqla = l1 + F.least(l2a * 0.7 + l2b_adj, F.lit(L2_CAP) * l1)
    priced = (
        joined.withColumn("stock", l1 + F.col("l2_adj"))
        .withColumn("capped_in", capped_inflows(inflows, outflows))
        .withColumn("net_out", outflows - F.col("capped_in"))
        .withColumn("ratio", F.lit(100.0) * F.col("stock") / F.col("net_out"))
        .withColumn("stress_ratio", F.lit(100.0) * stressed_hqla / (stressed_out - capped_inflows(inflows, stressed_out)))
    )
    return priced.select(
        "as_of_date",
        F.round("l1").alias("l1_hqla"),
        F.round("l2a").alias("l2a_hqla_post_haircut"),
        F.round("l2b").alias("l2b_hqla_post_haircut"),
        F.round("stock").alias("hqla_stock"),
        F.round("outflows").alias("gross_outflows"),
        F.round("capped_in").alias("capped_inflows"),
        F.round("net_out").alias("net_cash_outflows_30d"),
        F.round("ratio", 1).alias("lcr_pct"),
        F.round("net_1_7").alias("net_out_1_7d"),
        F.round("net_8_14").alias("net_out_8_14d"),
        F.round("net_15_30").alias("net_out_15_30d"),
        F.round("stress_ratio", 1).alias("lcr_stress_s1_pct"),
        lcr_status(F.col("ratio")).alias("lcr_status"),
    )


def stress(scenarios: DataFrame, holdings: DataFrame, positions: DataFrame) -> DataFrame:
    """Any number of stress scenarios against the latest date in one pass.

    ``scenarios``: scenario_id, retail_run_pct, l2a_markdown_pct, wholesale_run_pct.
    The position side is one row and enters as a scalar subquery; scenarios out of
    0..100 come back with status ERROR.
    """
    latest = F.col("as_of_date") == holdings.agg(F.max("as_of_date")).scalar()
    stock = with_caps(hqla_by_level(holdings.where(latest)).withColumn("l1", F.col("l1_market")))
    # a plain filter on the other table would need its own date: use the same one
    flows = cash_flows(positions.where(latest))
    base = stock.join(flows, "as_of_date").select(
        F.struct(
            "as_of_date", "l1", "l2a", "l2b_adj", "l2_adj", "outflows", "inflows_raw", "retail_balance", "wholesale_residual"
        ).alias("p")
    )
    pct = ["retail_run_pct", "l2a_markdown_pct", "wholesale_run_pct"]
    valid = F.lit(True)
    for name in pct:
        valid = valid & F.col(name).between(0, 100)
    p = F.col("p")
    retail, markdown, wholesale = (F.col(c) / F.lit(100.0) for c in pct)
    work = (
        scenarios.withColumn("valid", valid)
        .withColumn("p", base.scalar())
        .withColumn("base_hqla", p["l1"] + p["l2_adj"])
        .withColumn("base_net", p["outflows"] - capped_inflows(p["inflows_raw"], p["outflows"]))
        .withColumn("st_hqla", p["l1"] + F.least(p["l2a"] * (1 - markdown) + p["l2b_adj"], F.lit(L2_CAP) * p["l1"]))
        .withColumn("st_out", p["outflows"] + retail * p["retail_balance"] + wholesale * p["wholesale_residual"])
        .withColumn("st_net", F.col("st_out") - capped_inflows(p["inflows_raw"], F.col("st_out")))
    )

    def if_valid(value: Column, name: str) -> Column:
        return F.when(F.col("valid"), value).alias(name)

    def shortfall(level: float) -> Column:
        return F.greatest(F.lit(0.0), F.round((F.lit(level) * F.col("st_net") - F.col("st_hqla")) / CRORE))

    return work.select(
        "scenario_id", *pct,
        F.when(F.col("valid"), "OK").otherwise("ERROR").alias("status"),
        F.when(~F.col("valid"), "Percentages must be between 0 and 100").alias("message"),
        if_valid(p["as_of_date"], "as_of_date"),
        if_valid(F.round(100.0 * F.col("base_hqla") / F.col("base_net"), 1), "baseline_lcr_pct"),
        if_valid(F.round(100.0 * F.col("st_hqla") / F.col("st_net"), 1), "stressed_lcr_pct"),
        if_valid(F.round(F.col("st_hqla") / CRORE), "stressed_hqla_inr_cr"),
        if_valid(F.round(F.col("st_net") / CRORE), "stressed_net_outflows_inr_cr"),
        if_valid(shortfall(1.10), "hqla_shortfall_to_110pct_inr_cr"),
        if_valid(shortfall(1.00), "hqla_shortfall_to_100pct_inr_cr"),
        if_valid(F.array(*[F.lit(r) for r in STRESS_POLICY_REFS]), "policy_refs"),
    )


def maturity_gap(lcr: DataFrame) -> DataFrame:
    """Net outflow of the three buckets on the latest date, in crore."""
    gaps = F.array(
        *[
            F.struct(F.lit(label).alias("maturity_bucket"), (F.col(col) / CRORE).alias("net_cash_outflow_cr"))
            for label, col in [
                ("1-7 Days", "net_out_1_7d"), ("8-14 Days", "net_out_8_14d"), ("15-30 Days", "net_out_15_30d"),
            ]
        ]
    )
    return latest_row(lcr, "as_of_date").select("as_of_date", F.inline(gaps))


def threshold_event(lcr: DataFrame) -> DataFrame:
    """The latest day as an event when it is not GREEN; empty otherwise."""
    return (
        latest_row(lcr, "as_of_date")
        .where(F.col("lcr_status") != "GREEN")
        .select("as_of_date", "lcr_pct", F.col("lcr_status").alias("status"), F.col("lcr_stress_s1_pct").alias("stress_s1"))
    )


def liquidity_kpis(lcr: DataFrame, lookback: int = 7) -> DataFrame:
    """Latest ratio, its change over ``lookback`` rows, stock and outflow in crore.

    ``lcr`` has one row per date, so ordering it by date is a small window.
    """
    by_date = Window.orderBy("as_of_date")
    moved = lcr.withColumn("lcr_change_7d", F.round(F.col("lcr_pct") - F.lag("lcr_pct", lookback).over(by_date), 1))
    return latest_row(moved, "as_of_date").select(
        "as_of_date", "lcr_pct", "lcr_change_7d", "lcr_status",
        F.round(F.col("hqla_stock") / CRORE, 0).alias("hqla_stock_cr"),
        F.round(F.col("net_cash_outflows_30d") / CRORE, 0).alias("net_outflows_cr"),
    )


def lcr_trend(lcr: DataFrame) -> DataFrame:
    return lcr.select(
        "as_of_date", "lcr_pct", F.lit(110.0).alias("internal_floor_110"), F.lit(100.0).alias("regulatory_min_100")
    )


def instruments_on_latest_date(holdings: DataFrame) -> DataFrame:
    latest = holdings.agg(F.max("as_of_date")).scalar()
    return (
        holdings.where(F.col("as_of_date") == latest)
        .groupBy("instrument", "hqla_level", "haircut")
        .agg(F.sum("market_value_inr").alias("total_market_val_inr"))
    )
