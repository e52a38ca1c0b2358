"""Loan book and liquidity book."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import Registry
from ledgerwatch.operators import credit, liquidity

LCR_COLUMNS = (
    "as_of_date:y; l1_hqla:d; l2a_hqla_post_haircut:d; l2b_hqla_post_haircut:d; hqla_stock:d; gross_outflows:d; capped_inflows:d; "
    "net_cash_outflows_30d:d; lcr_pct:d; net_out_1_7d:d; net_out_8_14d:d; net_out_15_30d:d; lcr_stress_s1_pct:d; lcr_status"
)


def register(reg: Registry) -> None:
    ews = lambda *cols: (lambda w: w.compute_loan_ews().select(*cols))
    reg.add("c1", ews("loan_id", "dpd", "asset_class"), "loan_id; dpd:i; asset_class", "FROM loan_ews")
    reg.add("c2", ews("loan_id", "dpd", "ifrs9_stage"), "loan_id; dpd:i; ifrs9_stage", "FROM loan_ews")
    reg.add("c3", ews("loan_id", "ews_triggers", "ews_trigger_count"), "loan_id; ews_triggers:a; ews_trigger_count:i", "FROM loan_ews")
    reg.add("c4", ews("loan_id", "asset_class", "ews_trigger_count", "ews_action"), "loan_id; asset_class; ews_trigger_count:i; ews_action", "FROM loan_ews")
    reg.add(
        "c5",
        ews("loan_id", "customer_id", "full_name", "segment", "product", "industry", "sanctioned_limit", "disbursal_date", "collateral_type",
            "bureau_score", "outstanding", "utilization_pct", "dpd", "nach_bounces_90d", "sales_velocity_chg_pct", "asset_class", "ifrs9_stage",
            "ews_triggers", "ews_trigger_count", "ews_action", "policy_ref"),
        "loan_id; customer_id; full_name; segment; product; industry; sanctioned_limit:d; disbursal_date:y; collateral_type; bureau_score:i; "
        "outstanding:d; utilization_pct:d; dpd:i; nach_bounces_90d:i; sales_velocity_chg_pct:d; asset_class; ifrs9_stage; ews_triggers:a; "
        "ews_trigger_count:i; ews_action; policy_ref",
        "FROM loan_ews",
    )
    reg.add(
        "c6", lambda w: w.concentration, "industry; loans:i; outstanding_inr:d; share_pct:d; limit_pct:i; status; policy_ref", "FROM concentration"
    )
    reg.add(
        "c7", lambda w: w.loans.select("loan_id", "sanctioned_limit", "utilization_pct", "outstanding"),
        "loan_id; sanctioned_limit:d; utilization_pct:d; outstanding:d", "FROM loans",
    )
    reg.add("k5", lambda w: credit.credit_kpis(w.loan_ews),
            "round(100 * CAST(sum(CASE WHEN dpd > 90 THEN outstanding ELSE 0 END) AS DOUBLE) / CAST(sum(outstanding) AS DOUBLE), 2) AS gross_npa_pct:d; "
            "round(CAST(sum(CASE WHEN dpd BETWEEN 1 AND 90 THEN outstanding ELSE 0 END) AS DOUBLE) / 1e7) AS sma_exposure_cr:d; "
            "count(*) FILTER (ews_action = 'RESTRUCTURING_DISCUSSION_CREDIT_COMMITTEE') AS committee_referrals:i",
            "FROM loan_ews")

    reg.add("q1", lambda w: liquidity.hqla_by_level(w.hqla_holdings), "as_of_date:y; l1:d; l2a:d; l2b:d; l1_market:d", "FROM hq")
    reg.add(
        "q2", lambda w: liquidity.with_caps(liquidity.hqla_by_level(w.hqla_holdings)).select(
            "as_of_date", F.round("l2b_adj", 2).alias("l2b_adj"), F.round("l2_adj", 2).alias("l2_adj")),
        "as_of_date:y; round(l2b_adj, 2) AS l2b_adj:d; round(l2_adj, 2) AS l2_adj:d", "FROM hc",
    )
    reg.add(
        "q3", lambda w: liquidity.cash_flows(w.cashflow_positions),
        "as_of_date:y; outflows:d; inflows_raw:d; retail_deposits:d; retail_balance:d; wholesale_residual:d; net_1_7:d; net_8_14:d; net_15_30:d",
        "FROM cf",
    )
    reg.add("q4", lambda w: w.compute_lcr(), LCR_COLUMNS, "FROM lcr_daily")
    reg.add("q5", lambda w: w.lcr_daily.select("as_of_date", "lcr_pct", "lcr_stress_s1_pct"), "as_of_date:y; lcr_pct:d; lcr_stress_s1_pct:d", "FROM lcr_daily")
    reg.add(
        "q6", lambda w: liquidity.stress(w.stress_scenarios, w.hqla_holdings, w.cashflow_positions),
        "scenario_id; retail_run_pct:d; l2a_markdown_pct:d; wholesale_run_pct:d; status; message; as_of_date:y; baseline_lcr_pct:d; stressed_lcr_pct:d; "
        "stressed_hqla_inr_cr:d; stressed_net_outflows_inr_cr:d; hqla_shortfall_to_110pct_inr_cr:d; hqla_shortfall_to_100pct_inr_cr:d; "
        "CASE WHEN status = 'OK' THEN 'ALM-POL 5.1; ALM-POL 6.2; LCR Minimum and HQLA Composition' END AS policy_refs",
        "FROM stress_runs",
    )
    reg.add(
        "q7", lambda w: liquidity.maturity_gap(w.lcr_daily), "as_of_date:y; maturity_bucket; net_cash_outflow_cr:d",
        "FROM (SELECT as_of_date, unnest(['1-7 Days', '8-14 Days', '15-30 Days']) AS maturity_bucket, "
        "unnest([net_out_1_7d / 1e7, net_out_8_14d / 1e7, net_out_15_30d / 1e7]) AS net_cash_outflow_cr FROM latest_lcr)",
    )
    reg.add(
        "q8", lambda w: liquidity.threshold_event(w.lcr_daily),
        "as_of_date:y; lcr_pct:d; lcr_status AS status; lcr_stress_s1_pct AS stress_s1:d", "FROM latest_lcr WHERE lcr_status <> 'GREEN'",
    )
    reg.add(
        "k3", lambda w: liquidity.liquidity_kpis(w.lcr_daily),
        "as_of_date:y; lcr_pct:d; lcr_change_7d:d; lcr_status; round(hqla_stock / 1e7) AS hqla_stock_cr:d; round(net_cash_outflows_30d / 1e7) AS net_outflows_cr:d",
        "FROM (SELECT *, round(lcr_pct - lag(lcr_pct, 7) OVER (ORDER BY as_of_date), 1) AS lcr_change_7d FROM lcr_daily) z ORDER BY z.as_of_date DESC LIMIT 1",
    )
    reg.add("k4", lambda w: liquidity.lcr_trend(w.lcr_daily),
            "as_of_date:y; lcr_pct:d; 110.0 AS internal_floor_110:d; 100.0 AS regulatory_min_100:d", "FROM lcr_daily")
    reg.add(
        "w7", lambda w: w.lcr_daily.select(
            "as_of_date", F.round(F.col("lcr_pct") - F.lag("lcr_pct", 7).over(Window.orderBy("as_of_date")), 1).alias("lcr_change_7d")),
        "as_of_date:y; round(lcr_pct - lag(lcr_pct, 7) OVER (ORDER BY lcr_daily.as_of_date), 1) AS lcr_change_7d:d", "FROM lcr_daily",
    )
