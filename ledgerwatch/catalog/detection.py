"""Signals, rules, alerts and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.catalog.registry import TS_FORMAT, Registry
from ledgerwatch.operators import cycles, network, rules, signals
from ledgerwatch.functions.windows import reference_time
from ledgerwatch.plans.workspace import Workspace

_W48 = (
    "account_id; inflow_cnt_48h:i; distinct_remitters_48h:i; inflow_amt_48h:d; outflow_amt_48h:d; rtgs_neft_out_48h:d; "
    "distinct_devices_48h:i; foreign_or_risky_ip_txns_48h:i"
)
_SIGNALS = (
    "account_id; customer_id; account_type; open_date:y; full_name; segment; kyc_risk_rating; occupation; declared_annual_income:i; is_pep; "
    "city; account_age_days:i; dormant_days_before_window:i; inflow_cnt_48h:i; distinct_remitters_48h:i; inflow_amt_48h:d; outflow_amt_48h:d; "
    "rtgs_neft_out_48h:d; pass_through_ratio_48h:d; distinct_devices_48h:i; foreign_or_risky_ip_txns_48h:i; cash_near_ctr_10d:i; "
    "cash_near_ctr_amt_10d:d; round_trip_cycles_7d:i; round_trip_amt:d; round_trip_ring:a; watchlist_hit; watchlist_score:d; signal_as_of:t"
)
_ALERTS = (
    "alert_id; account_id; customer_id; full_name; segment; kyc_risk_rating; occupation; flag_names:a; red_flag_count:i; risk_score:i; typology; "
    "recommended_action; inflow_amt_48h:d; outflow_amt_48h:d; pass_through_ratio_48h:d; cash_near_ctr_amt_10d:d; round_trip_amt:d; signal_as_of:t"
)
_EDGE = (
    "source_node; source_cust_id; source_name; target_node; target_cust_id; target_name; link_type; txn_count:i; total_volume_inr:d; last_activity:t"
)


def _firing(flag: str):
    def build(w: Workspace) -> DataFrame:
        rule_set = rules.RuleSet()
        rule = next(r for r in rule_set.rules if r.flag == flag)
        return rule_set.evaluate(w.signals).where(rule_set.hit(flag)).select(
            "account_id", F.lit(rule.flag).alias("flag"), F.lit(rule.policy).alias("policy"),
            F.lit(rule.weight).alias("weight"), rule.evidence().alias("evidence"),
        )

    return build


def _alerts(*cols: str):
    return lambda w: rules.fraud_alerts(w.signals).select(*cols)

LINKS_PER_PAGE = 10


def register(reg: Registry) -> None:
    reg.add("s1", lambda w: reference_time(w.transactions), "t:t", "FROM ref_ts")
    reg.add("s2", lambda w: signals.activity_48h(w.transactions, w.t), _W48, "FROM w48")
    reg.add(
        "s3", lambda w: signals.last_activity_before(w.transactions, w.t), "account_id; last_txn_before_window:t", "FROM prior_activity"
    )
    reg.add(
        "s4", lambda w: signals.near_threshold_cash(w.transactions, w.t), "account_id; cash_near_ctr_10d:i; cash_near_ctr_amt_10d:d",
        "FROM near_cash",
    )
    reg.add(
        "s5", lambda w: cycles.round_trips(w.rings), "account_id; round_trip_cycles_7d:i; round_trip_amt:d; round_trip_ring:a", "FROM rt"
    )
    reg.add(
        "s6", lambda w: signals.best_watchlist_hit(w.watchlist),
        "matched_customer_id AS customer_id; list_name AS watchlist_hit; match_score AS watchlist_score:d", "FROM best_hit",
    )
    reg.add("s7", lambda w: w.compute_signals(), _SIGNALS, "FROM account_signals")

    for i, rule in enumerate(rules.default_rules(), start=1):
        reg.add(
            f"r{i}", _firing(rule.flag),
            "account_id; f.flag AS flag; f.policy AS policy; f.weight AS weight:i; f.evidence AS evidence",
            f"FROM (SELECT account_id, unnest(red_flags) AS f FROM flagged) WHERE f.flag = '{rule.flag}'",
        )
    reg.add("r10", _alerts("alert_id", "flag_names", "red_flag_count"), "alert_id; flag_names:a; red_flag_count:i", "FROM fraud_alerts")
    reg.add("r11", _alerts("alert_id", "kyc_risk_rating", "risk_score"), "alert_id; kyc_risk_rating; risk_score:i", "FROM fraud_alerts")
    reg.add("r12", _alerts("alert_id", "typology"), "alert_id; typology", "FROM fraud_alerts")
    reg.add("r13", _alerts("alert_id", "recommended_action"), "alert_id; recommended_action", "FROM fraud_alerts")
    reg.add("r14", lambda w: rules.fraud_alerts(w.compute_signals()).drop("red_flags"), _ALERTS, "FROM fraud_alerts")
    reg.add(
        "r15", lambda w: rules.by_score_and_time(w.recent_high_risk.drop("evidence_flags")),
        "account_id; txn_id; txn_ts:t; counterparty_account_id; channel; direction; amount_inr:d; customer_id; customer_name; risk_score:i; "
        "typology; recommended_action",
        "FROM recent_high_risk",
    )

    reg.add(
        "n1", lambda w: w.rings, "a1; a2; a3; n AS cycles:i; amt:d; concat_ws('>', a1, a2, a3) AS ring", "FROM loops",
    )
    reg.add("n2", lambda w: w.flows, _EDGE, "FROM network_graph WHERE link_type = 'TRANSACTION_FLOW'")
    reg.add("n3", lambda w: network.device_edges(w.device_use, text=TS_FORMAT), _EDGE, "FROM network_graph WHERE link_type <> 'TRANSACTION_FLOW'")
    reg.add("n4", lambda w: network.network_graph(w.flows, w.device_use, TS_FORMAT), _EDGE, "FROM network_graph")
    reg.add(
        "n5", lambda w: w.links.neighbourhood(account_id="ACC0000030"), _EDGE,
        "FROM network_graph WHERE source_node = 'ACC0000030' OR target_node = 'ACC0000030'",
    )
    ordered = "FROM (FROM network_graph n ORDER BY n.total_volume_inr DESC, n.source_node, n.target_node, n.link_type LIMIT {size} OFFSET {skip})"
    for page in (1, 50):
        reg.add(
            f"n4_page{page}", lambda w, page=page: network.links_page(w.flows, w.device_use, page, LINKS_PER_PAGE), _EDGE,
            ordered.format(size=LINKS_PER_PAGE, skip=(page - 1) * LINKS_PER_PAGE),
        )
    reg.add(
        "n6", lambda w: network.ring_summary(w.flows, w.device_use),
        "link_type; count(*) AS connected_pairs:i; sum(total_volume_inr) AS total_ring_volume_inr:d", "FROM network_graph GROUP BY link_type",
    )
    reg.add(
        "n7", lambda w: network.external_beneficiaries(w.transactions),
        "counterparty_account_id; count(DISTINCT account_id) AS linked_accounts:i; count(*) AS txn_count:i; sum(amount_inr) AS total_volume_inr:d",
        "FROM transactions WHERE counterparty_account_id LIKE 'EXT-BENF-%' GROUP BY counterparty_account_id",
    )
    reg.add(
        "k2", lambda w: network.network_kpis(w.flows, w.device_use),
        "count(*) AS network_links:i; sum(total_volume_inr) AS total_exposure_inr:d; "
        "(SELECT count(DISTINCT node) FROM (SELECT unnest([source_node, target_node]) AS node FROM network_graph)) AS unique_nodes:i",
        "FROM network_graph",
    )
