"""Questions b00..b45 and the detail views, with their checking SQL."""

from __future__ import annotations

from functools import partial

from ledgerwatch.catalog.registry import TS_FORMAT, Registry
from ledgerwatch.plans.questions import DEFAULT_ACCOUNT, DEFAULT_ALERT, DEFAULT_CUSTOMER, QUESTIONS

_LINK = "source_node; source_name; target_node; target_name; link_type; txn_count:i; total_volume_inr:d"

SQL: dict[str, tuple[str, str]] = {
    "b00": (
        "a.alert_id; a.account_id; a.customer_id; a.full_name; a.typology; a.risk_score:i; a.recommended_action; "
        "s.cash_near_ctr_10d AS cash_deposits_count:i; s.cash_near_ctr_amt_10d AS total_structuring_inr:d; a.flag_names:a",
        f"FROM fraud_alerts a JOIN account_signals s ON s.account_id = a.account_id WHERE a.customer_id = '{DEFAULT_CUSTOMER}'",
    ),
    "b01": (
        "txn_id; txn_ts:t; account_id; customer_name; amount_inr:d; channel; typology; risk_score:i; recommended_action",
        "FROM recent_high_risk ORDER BY risk_score DESC, recent_high_risk.txn_ts DESC, txn_id LIMIT 15",
    ),
    "b02": (
        "alert_id; account_id; full_name; occupation; cash_near_ctr_amt_10d AS structuring_amt_inr:d; risk_score:i; recommended_action",
        "FROM fraud_alerts WHERE typology = 'AML_LAYERING' AND cash_near_ctr_amt_10d > 0",
    ),
    "b03": (
        "account_id; customer_id; full_name; occupation; inflow_cnt_48h:i; dormant_days_before_window:i; inflow_amt_48h:d; outflow_amt_48h:d",
        "FROM account_signals WHERE (dormant_days_before_window >= 30 OR account_age_days <= 180) AND inflow_cnt_48h >= 10",
    ),
    "b04": (
        "alert_id; account_id; full_name; occupation; inflow_amt_48h:d; risk_score:i; flag_names:a",
        "FROM fraud_alerts WHERE list_contains(flag_names, 'PROFILE_MISMATCH')",
    ),
    "b05": (
        "account_id; customer_id; full_name; open_date:y; account_age_days:i; inflow_amt_48h:d; outflow_amt_48h:d; pass_through_ratio_48h:d",
        "FROM account_signals WHERE account_age_days <= 180 AND inflow_amt_48h >= 200000",
    ),
    "b06": (
        "x.txn_id; x.txn_ts:t; x.account_id; x.amount_inr:d; x.channel; x.device_id; x.ip_address; x.geo_country; a.typology",
        "FROM transactions x JOIN fraud_alerts a ON a.account_id = x.account_id WHERE x.geo_country <> 'IN' OR x.ip_address LIKE '185.%' "
        "ORDER BY x.txn_ts DESC, x.txn_id LIMIT 20",
    ),
    "b07": (_LINK, "FROM network_graph g ORDER BY g.total_volume_inr DESC, source_node, target_node, link_type LIMIT 15"),
    "b08": (
        "alert_id; account_id; full_name; typology; red_flag_count:i; risk_score:i; flag_names:a; recommended_action",
        "FROM fraud_alerts WHERE red_flag_count >= 3",
    ),
    "b09": (
        "alert_id; account_id; full_name; typology; risk_score:i; recommended_action; inflow_amt_48h:d; outflow_amt_48h:d",
        "FROM fraud_alerts WHERE risk_score >= 60 OR recommended_action IN ('FREEZE_ACCOUNT', 'PLACE_HOLD')",
    ),
    "b10": (
        "alert_id; account_id; full_name; occupation; list_transform(red_flags, lambda f: f.evidence) AS evidence:a; risk_score:i; recommended_action",
        "FROM fraud_alerts WHERE typology = 'AML_LAYERING' ORDER BY alert_id LIMIT 5",
    ),
    "b11": (
        "alert_id; account_id; full_name; typology; round_trip_amt:d; pass_through_ratio_48h:d; risk_score:i",
        "FROM fraud_alerts WHERE list_contains(flag_names, 'ROUND_TRIPPING') OR list_contains(flag_names, 'RAPID_PASS_THROUGH')",
    ),
    "b12": (
        "x.txn_id; x.account_id; a.full_name; x.channel; x.direction; x.amount_inr:d; x.counterparty_account_id; x.txn_ts:t",
        "FROM transactions x JOIN fraud_alerts a ON a.account_id = x.account_id WHERE a.typology = 'MONEY_MULE' "
        "AND x.channel IN ('RTGS', 'UPI', 'IMPS') ORDER BY x.txn_ts DESC, x.txn_id LIMIT 20",
    ),
    "b13": (
        "a.alert_id; a.account_id; a.customer_id; a.full_name; s.watchlist_hit; s.watchlist_score:d; a.recommended_action",
        "FROM fraud_alerts a JOIN account_signals s ON s.account_id = a.account_id WHERE s.watchlist_score >= 0.85",
    ),
    "b14": (
        "alert_id; account_id; full_name; typology; risk_score:i; red_flag_count:i; recommended_action",
        "FROM fraud_alerts WHERE risk_score >= 90 AND red_flag_count >= 4",
    ),
    "b15": ("alert_id; account_id; full_name; typology; risk_score:i; flag_names:a", f"FROM fraud_alerts WHERE alert_id = '{DEFAULT_ALERT}'"),
    "b16": (
        "a.alert_id; a.account_id; a.full_name; a.occupation; s.declared_annual_income:i; a.inflow_amt_48h:d; a.outflow_amt_48h:d; a.flag_names:a",
        f"FROM fraud_alerts a JOIN account_signals s ON s.account_id = a.account_id WHERE a.alert_id = '{DEFAULT_ALERT}'",
    ),
    "b17": ("doc_id; doc_title; section; domain; chunk_text", "FROM policy_docs WHERE domain IN ('AML', 'FRAUD')"),
    "b18": (
        "f.flag AS violation_flag; f.policy AS policy_clause; f.weight AS severity_weight:i; f.evidence AS evidence_fact",
        f"FROM (SELECT unnest(red_flags) AS f FROM fraud_alerts WHERE alert_id = '{DEFAULT_ALERT}')",
    ),
    "b19": (
        "alert_id; full_name; typology; inflow_amt_48h:d; outflow_amt_48h:d; pass_through_ratio_48h:d; flag_names:a",
        "FROM fraud_alerts WHERE typology = 'MONEY_MULE' ORDER BY alert_id LIMIT 1",
    ),
    "b20": (_LINK, f"FROM network_graph WHERE source_cust_id = '{DEFAULT_CUSTOMER}' OR target_cust_id = '{DEFAULT_CUSTOMER}'"),
    "b21": ("link_type; count(*) AS connected_pairs:i; sum(total_volume_inr) AS total_ring_volume_inr:d", "FROM network_graph GROUP BY link_type"),
    "b22": (
        "source_name; target_name; link_type; total_volume_inr:d; last_activity:t",
        "FROM network_graph WHERE link_type LIKE 'SHARED_DEVICE%'",
    ),
    "b23": (
        "source_node; target_node; link_type; txn_count:i; total_volume_inr:d; last_activity:t",
        f"FROM network_graph WHERE source_node = '{DEFAULT_ACCOUNT}' OR target_node = '{DEFAULT_ACCOUNT}'",
    ),
    "b24": (
        "counterparty_account_id; count(DISTINCT account_id) AS linked_accounts:i; count(*) AS txn_count:i; sum(amount_inr) AS total_volume_inr:d",
        "FROM transactions WHERE counterparty_account_id LIKE 'EXT-BENF-%' GROUP BY counterparty_account_id",
    ),
    "b25": (
        "loan_id; full_name; segment; industry; outstanding:d; dpd:i; asset_class; ews_triggers:a; ews_action",
        "FROM loan_ews e WHERE ews_trigger_count >= 2 ORDER BY e.outstanding DESC, loan_id LIMIT 15",
    ),
    "b26": (
        "loan_id; full_name; product; industry; outstanding:d; nach_bounces_90d:i; dpd:i; asset_class", "FROM loan_ews WHERE nach_bounces_90d >= 2",
    ),
    "b27": (
        "loan_id; full_name; industry; outstanding:d; utilization_pct:d; bureau_score:i; dpd:i; asset_class",
        "FROM loan_ews WHERE dpd BETWEEN 61 AND 90 AND (utilization_pct > 90 OR bureau_score < 600)",
    ),
    "b28": (
        "loan_id; full_name; product; industry; sanctioned_limit:d; outstanding:d; utilization_pct:d; dpd:i; asset_class; ifrs9_stage; "
        "ews_triggers:a; ews_action; policy_ref",
        "FROM loan_ews WHERE asset_class IN ('SMA-2', 'NPA') ORDER BY loan_id LIMIT 5",
    ),
    "b29": (
        "loan_id; full_name; industry; outstanding:d; dpd:i; asset_class; ews_action; ews_triggers:a",
        "FROM loan_ews WHERE ews_action IN ('RESTRUCTURING_DISCUSSION_CREDIT_COMMITTEE', 'LIMIT_FREEZE_AND_COLLATERAL_REVALUATION')",
    ),
    "b30": ("as_of_date:y; lcr_pct:d; lcr_status; hqla_stock:d; net_cash_outflows_30d:d; lcr_stress_s1_pct:d", "FROM latest_lcr"),
    "b31": (
        "as_of_date:y; lcr_pct:d; hqla_stock:d; gross_outflows:d; capped_inflows:d; net_cash_outflows_30d:d; lcr_status",
        "FROM lcr_daily l ORDER BY l.as_of_date DESC LIMIT 10",
    ),
    "b32": (
        "instrument; hqla_level; haircut:d; sum(market_value_inr) AS total_market_val_inr:d",
        "FROM hqla_holdings WHERE as_of_date = (SELECT max(as_of_date) FROM hqla_holdings) GROUP BY instrument, hqla_level, hqla_holdings.haircut",
    ),
    "b33": (
        "as_of_date:y; l1_hqla:d; l2a_hqla_post_haircut:d; l2b_hqla_post_haircut:d; hqla_stock:d; net_cash_outflows_30d:d; lcr_pct:d; lcr_status",
        "FROM latest_lcr",
    ),
    "b34": ("as_of_date:y; net_out_1_7d:d; net_out_8_14d:d; net_out_15_30d:d; net_cash_outflows_30d:d", "FROM latest_lcr"),
    "b35": (
        "case_id; alert_id; typology; risk_score:i; status; passed AS guardrail_passed; bad AS unverified:a; sar_draft; created_at:t",
        "FROM cases WHERE alert_id = 'ALR-ACC0000029'",
    ),
    "b36": (
        "alert_id; account_id; customer_id; full_name; typology; risk_score:i; flag_names:a",
        f"FROM fraud_alerts WHERE customer_id = '{DEFAULT_CUSTOMER}'",
    ),
    "b37": (
        "event_ts:t; event_user; event_role; event_type; object_id; details",
        "FROM audit_log g ORDER BY g.event_ts DESC, object_id, event_type LIMIT 20",
    ),
    "b38": ("doc_id; doc_title; doc_type; section; domain; chunk_text", "FROM policy_docs"),
    "b39": (
        "case_id; alert_id; account_id; typology; risk_score:i; status; action_taken; passed AS guardrail_passed; created_by; created_at:t",
        "FROM cases WHERE status = 'PENDING_REVIEW'",
    ),
    "b40": (
        "case_id; alert_id; typology; risk_score:i; sar_draft; missing_docs:a; passed AS guardrail_passed",
        "FROM cases ORDER BY created_at DESC, case_id LIMIT 1",
    ),
    "b41": (
        "typology; count(*) AS alert_count:i; sum(inflow_amt_48h) AS total_inflow_inr:d; sum(outflow_amt_48h) AS total_outflow_inr:d; "
        "round(avg(risk_score)) AS avg_risk_score:d",
        "FROM fraud_alerts GROUP BY typology",
    ),
    "b42": (
        "segment; count(*) AS alerts:i; sum(inflow_amt_48h) AS inflow_exposure_inr:d; sum(outflow_amt_48h) AS outflow_exposure_inr:d",
        "FROM fraud_alerts GROUP BY segment",
    ),
    "b43": (
        "typology; recommended_action; count(*) AS alerts:i; sum(outflow_amt_48h) AS total_outflow_inr:d",
        "FROM fraud_alerts GROUP BY typology, recommended_action",
    ),
    "b44": (
        "(SELECT count(*) FROM fraud_alerts) AS total_open_alerts:i; "
        "(SELECT count(*) FROM fraud_alerts WHERE recommended_action = 'FREEZE_ACCOUNT') AS critical_freeze_alerts:i; "
        "(SELECT sum(outflow_amt_48h) FROM fraud_alerts) AS total_48h_outflow_exposure_inr:d; "
        "(SELECT count(*) FROM cases WHERE status = 'PENDING_REVIEW') AS pending_sar_cases:i; "
        "(SELECT count(*) FROM cases WHERE status = 'APPROVED_FOR_FILING') AS filed_sar_cases:i; "
        "(SELECT lcr_pct FROM latest_lcr) AS latest_lcr_pct:d; (SELECT lcr_status FROM latest_lcr) AS latest_lcr_status; "
        "(SELECT round(100 * CAST(sum(CASE WHEN dpd > 90 THEN outstanding ELSE 0 END) AS DOUBLE) / CAST(sum(outstanding) AS DOUBLE), 2) FROM loan_ews) AS gross_npa_pct:d; "
        "(SELECT sum(CASE WHEN dpd BETWEEN 1 AND 90 THEN outstanding ELSE 0 END) FROM loan_ews) AS sma_exposure_inr:d",
        "FROM (SELECT 1)",
    ),
    "b45": (
        "recommended_action; count(*) AS count:i; sum(outflow_amt_48h) AS total_outflow_inr:d", "FROM fraud_alerts GROUP BY recommended_action",
    ),
    "d_txn": (
        "txn_id; txn_ts:t; direction; channel; amount_inr:d; counterparty_account_id; device_id; ip_address; geo_country",
        f"FROM transactions WHERE account_id = '{DEFAULT_ACCOUNT}' AND transactions.txn_ts >= (SELECT t FROM ref_ts) - INTERVAL 10 DAY",
    ),
    "d_flag": (
        "f.flag AS flag; f.policy AS policy; f.weight AS weight:i; f.evidence AS evidence",
        f"FROM (SELECT unnest(red_flags) AS f FROM fraud_alerts WHERE alert_id = '{DEFAULT_ALERT}')",
    ),
    "d_cases": (
        "case_id; alert_id; typology; risk_score:i; status; action_taken; passed AS guardrail_passed; created_by; created_at:t; reviewed_by; review_decision",
        "FROM cases",
    ),
}


def register(reg: Registry) -> None:
    for name, q in QUESTIONS.items():
        columns, rest = SQL[name]
        # b22 lists every pair: its times are formatted per member, not per link
        reg.add(name, partial(q.build, text=TS_FORMAT) if name == "b22" else q.build, columns, rest)
