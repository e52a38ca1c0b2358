"""The bank of analyst questions b00..b45 and the three detail views.

Each question is a function of a workspace and its parameters. They read refreshed
tables; every ORDER BY ends in a key so that limits and ties are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import days, latest_row
from ledgerwatch.functions.windows import since
from ledgerwatch.operators import governance, liquidity, network
from ledgerwatch.operators.credit import COMMITTEE, LIMIT_FREEZE
from ledgerwatch.operators.rules import by_score_and_time
from ledgerwatch.plans.workspace import Workspace

DEFAULT_CUSTOMER = "CUST000007"
DEFAULT_ACCOUNT = "ACC0000007"
DEFAULT_ALERT = "ALR-ACC0000007"


@dataclass(frozen=True)
class Question:
    name: str
    title: str
    build: Callable[..., DataFrame]

    def __call__(self, w: Workspace, **params) -> DataFrame:
        return self.build(w, **params)


QUESTIONS: dict[str, Question] = {}


def question(name: str, title: str):
    def register(fn: Callable[..., DataFrame]) -> Question:
        QUESTIONS[name] = Question(name, title, fn)
        return QUESTIONS[name]

    return register


def _by_score(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("risk_score"), "alert_id")


def _signals_of(w: Workspace, *cols: str) -> DataFrame:
    return w.signals.select("account_id", *cols)


# --- detection ---------------------------------------------------------------
@question("b00", "Why file a report for this customer?")
def b00(w: Workspace, customer_id: str = DEFAULT_CUSTOMER) -> DataFrame:
    facts = _signals_of(
        w, F.col("cash_near_ctr_10d").alias("cash_deposits_count"), F.col("cash_near_ctr_amt_10d").alias("total_structuring_inr")
    )
    return w.alerts.where(F.col("customer_id") == customer_id).join(facts, "account_id").select(
        "alert_id", "account_id", "customer_id", "full_name", "typology", "risk_score", "recommended_action",
        "cash_deposits_count", "total_structuring_inr", "flag_names",
    )


@question("b01", "Highest-risk recent transactions")
def b01(w: Workspace, limit: int = 15) -> DataFrame:
    return by_score_and_time(w.recent_high_risk).select(
        "txn_id", "txn_ts", "account_id", "customer_name", "amount_inr", "channel", "typology", "risk_score", "recommended_action"
    ).limit(limit)


@question("b02", "Structuring customers")
def b02(w: Workspace) -> DataFrame:
    hit = (F.col("typology") == "AML_LAYERING") & (F.col("cash_near_ctr_amt_10d") > 0)
    return _by_score(w.alerts.where(hit)).select(
        "alert_id", "account_id", "full_name", "occupation", F.col("cash_near_ctr_amt_10d").alias("structuring_amt_inr"),
        "risk_score", "recommended_action",
    )


@question("b03", "Sudden bursts on new or dormant accounts")
def b03(w: Workspace, dormant: int = 30, new: int = 180, credits: int = 10) -> DataFrame:
    burst = ((F.col("dormant_days_before_window") >= dormant) | (F.col("account_age_days") <= new)) & (F.col("inflow_cnt_48h") >= credits)
    return w.signals.where(burst).orderBy(F.desc("inflow_cnt_48h"), "account_id").select(
        "account_id", "customer_id", "full_name", "occupation", "inflow_cnt_48h", "dormant_days_before_window",
        "inflow_amt_48h", "outflow_amt_48h",
    )


@question("b04", "Inflow out of line with income")
def b04(w: Workspace) -> DataFrame:
    return w.alerts.where(F.array_contains("flag_names", "PROFILE_MISMATCH")).orderBy(F.desc("inflow_amt_48h"), "alert_id").select(
        "alert_id", "account_id", "full_name", "occupation", "inflow_amt_48h", "risk_score", "flag_names"
    )


@question("b05", "New accounts with large transfers")
def b05(w: Workspace, new: int = 180, inflow: int = 200_000) -> DataFrame:
    return (
        w.signals.where((F.col("account_age_days") <= new) & (F.col("inflow_amt_48h") >= inflow))
        .orderBy(F.desc("inflow_amt_48h"), "account_id")
        .select(
            "account_id", "customer_id", "full_name", "open_date", "account_age_days", "inflow_amt_48h", "outflow_amt_48h",
            "pass_through_ratio_48h",
        )
    )


@question("b06", "Transactions from unusual places or addresses")
def b06(w: Workspace, limit: int = 20) -> DataFrame:
    odd = (F.col("geo_country") != "IN") | F.col("ip_address").startswith("185.")
    return (
        w.transactions.where(odd)
        .join(w.alerts.select("account_id", "typology"), "account_id")
        .orderBy(F.desc("txn_ts"), "txn_id")
        .select("txn_id", "txn_ts", "account_id", "amount_inr", "channel", "device_id", "ip_address", "geo_country", "typology")
        .limit(limit)
    )


_LINK = ["source_node", "source_name", "target_node", "target_name", "link_type", "txn_count", "total_volume_inr"]


@question("b07", "Largest links")
def b07(w: Workspace, limit: int = 15) -> DataFrame:
    return network.largest_links(w.flows, w.device_use, limit).select(_LINK)


@question("b08", "Several rules at once")
def b08(w: Workspace, flags: int = 3) -> DataFrame:
    return w.alerts.where(F.col("red_flag_count") >= flags).orderBy(F.desc("red_flag_count"), F.desc("risk_score"), "alert_id").select(
        "alert_id", "account_id", "full_name", "typology", "red_flag_count", "risk_score", "flag_names", "recommended_action"
    )


@question("b09", "Review list for reports")
def b09(w: Workspace) -> DataFrame:
    due = (F.col("risk_score") >= 60) | F.col("recommended_action").isin("FREEZE_ACCOUNT", "PLACE_HOLD")
    return _by_score(w.alerts.where(due)).select(
        "alert_id", "account_id", "full_name", "typology", "risk_score", "recommended_action", "inflow_amt_48h", "outflow_amt_48h"
    )


@question("b10", "Layering alerts, itemised")
def b10(w: Workspace, limit: int = 5) -> DataFrame:
    return w.alerts.where("typology = 'AML_LAYERING'").orderBy("alert_id").limit(limit).select(
        "alert_id", "account_id", "full_name", "occupation", F.transform("red_flags", lambda f: f["evidence"]).alias("evidence"),
        "risk_score", "recommended_action",
    )


@question("b11", "Round trips and rapid pass-through")
def b11(w: Workspace) -> DataFrame:
    hit = F.arrays_overlap("flag_names", F.array(F.lit("ROUND_TRIPPING"), F.lit("RAPID_PASS_THROUGH")))
    return _by_score(w.alerts.where(hit)).select(
        "alert_id", "account_id", "full_name", "typology", "round_trip_amt", "pass_through_ratio_48h", "risk_score"
    )


@question("b12", "Mule transactions")
def b12(w: Workspace, limit: int = 20) -> DataFrame:
    mules = w.alerts.where("typology = 'MONEY_MULE'").select("account_id", "full_name")
    return (
        w.transactions.where(F.col("channel").isin("RTGS", "UPI", "IMPS"))
        .join(mules, "account_id")
        .orderBy(F.desc("txn_ts"), "txn_id")
        .select("txn_id", "account_id", "full_name", "channel", "direction", "amount_inr", "counterparty_account_id", "txn_ts")
        .limit(limit)
    )


@question("b13", "Accounts tied to listed entities")
def b13(w: Workspace, score: float = 0.85) -> DataFrame:
    hits = _signals_of(w, "watchlist_hit", "watchlist_score").where(F.col("watchlist_score") >= F.lit(str(score)).cast("decimal(4,2)"))
    return w.alerts.join(hits, "account_id").orderBy(F.desc("watchlist_score"), "alert_id").select(
        "alert_id", "account_id", "customer_id", "full_name", "watchlist_hit", "watchlist_score", "recommended_action"
    )


@question("b14", "Alerts with enough evidence")
def b14(w: Workspace) -> DataFrame:
    return _by_score(w.alerts.where("risk_score >= 90 AND red_flag_count >= 4")).select(
        "alert_id", "account_id", "full_name", "typology", "risk_score", "red_flag_count", "recommended_action"
    )


# --- explanation -------------------------------------------------------------
@question("b15", "Flags of one alert")
def b15(w: Workspace, alert_id: str = DEFAULT_ALERT) -> DataFrame:
    return w.alerts.where(F.col("alert_id") == alert_id).select(
        "alert_id", "account_id", "full_name", "typology", "risk_score", "flag_names"
    )


@question("b16", "Evidence behind one alert")
def b16(w: Workspace, alert_id: str = DEFAULT_ALERT) -> DataFrame:
    return w.alerts.where(F.col("alert_id") == alert_id).join(_signals_of(w, "declared_annual_income"), "account_id").select(
        "alert_id", "account_id", "full_name", "occupation", "declared_annual_income", "inflow_amt_48h", "outflow_amt_48h", "flag_names"
    )


@question("b17", "Policies of the financial-crime domains")
def b17(w: Workspace) -> DataFrame:
    return w.policy_docs.where(F.col("domain").isin("AML", "FRAUD")).select("doc_id", "doc_title", "section", "domain", "chunk_text")


@question("b18", "Policy violations of one alert")
def b18(w: Workspace, alert_id: str = DEFAULT_ALERT) -> DataFrame:
    return w.alerts.where(F.col("alert_id") == alert_id).select(F.inline("red_flags")).select(
        F.col("flag").alias("violation_flag"), F.col("policy").alias("policy_clause"),
        F.col("weight").alias("severity_weight"), F.col("evidence").alias("evidence_fact"),
    )


@question("b19", "One mule alert")
def b19(w: Workspace) -> DataFrame:
    return w.alerts.where("typology = 'MONEY_MULE'").orderBy("alert_id").limit(1).select(
        "alert_id", "full_name", "typology", "inflow_amt_48h", "outflow_amt_48h", "pass_through_ratio_48h", "flag_names"
    )


# --- network -----------------------------------------------------------------
@question("b20", "Links of one customer")
def b20(w: Workspace, customer_id: str = DEFAULT_CUSTOMER) -> DataFrame:
    return w.links.neighbourhood(customer_id=customer_id).select(_LINK)


@question("b21", "Rings by link type")
def b21(w: Workspace) -> DataFrame:
    return network.ring_summary(w.flows, w.device_use).orderBy(F.desc("total_ring_volume_inr"), "link_type")


@question("b22", "Customers on the same device")
def b22(w: Workspace, text: str | None = None) -> DataFrame:
    """Largest volume first, as it is shown; ``text`` as in ``network.device_edges``."""
    return network.device_edges(w.device_use, text=text).orderBy(F.desc("total_volume_inr"), "source_node", "target_node", "link_type").select(
        "source_name", "target_name", "link_type", "total_volume_inr", "last_activity"
    )


@question("b23", "Links of one account")
def b23(w: Workspace, account_id: str = DEFAULT_ACCOUNT) -> DataFrame:
    return w.links.neighbourhood(account_id=account_id).select(
        "source_node", "target_node", "link_type", "txn_count", "total_volume_inr", "last_activity"
    )


@question("b24", "Shared external beneficiaries")
def b24(w: Workspace) -> DataFrame:
    return network.external_beneficiaries(w.transactions).orderBy(F.desc("linked_accounts"), "counterparty_account_id")


# --- credit ------------------------------------------------------------------
@question("b25", "Rapid deterioration")
def b25(w: Workspace, limit: int = 15) -> DataFrame:
    return w.loan_ews.where("ews_trigger_count >= 2").orderBy(F.desc("outstanding"), "loan_id").limit(limit).select(
        "loan_id", "full_name", "segment", "industry", "outstanding", "dpd", "asset_class", "ews_triggers", "ews_action"
    )


@question("b26", "Bounced mandates")
def b26(w: Workspace) -> DataFrame:
    return w.loan_ews.where("nach_bounces_90d >= 2").orderBy(F.desc("nach_bounces_90d"), F.desc("outstanding"), "loan_id").select(
        "loan_id", "full_name", "product", "industry", "outstanding", "nach_bounces_90d", "dpd", "asset_class"
    )


@question("b27", "Likely defaults")
def b27(w: Workspace) -> DataFrame:
    near = F.col("dpd").between(61, 90) & ((F.col("utilization_pct") > 90) | (F.col("bureau_score") < 600))
    return w.loan_ews.where(near).orderBy(F.desc("outstanding"), "loan_id").select(
        "loan_id", "full_name", "industry", "outstanding", "utilization_pct", "bureau_score", "dpd", "asset_class"
    )


@question("b28", "High-risk loans explained")
def b28(w: Workspace, limit: int = 5) -> DataFrame:
    return w.loan_ews.where(F.col("asset_class").isin("SMA-2", "NPA")).orderBy("loan_id").limit(limit).select(
        "loan_id", "full_name", "product", "industry", "sanctioned_limit", "outstanding", "utilization_pct", "dpd",
        "asset_class", "ifrs9_stage", "ews_triggers", "ews_action", "policy_ref",
    )


@question("b29", "Loans for immediate review")
def b29(w: Workspace) -> DataFrame:
    return w.loan_ews.where(F.col("ews_action").isin(COMMITTEE, LIMIT_FREEZE)).orderBy(F.desc("outstanding"), "loan_id").select(
        "loan_id", "full_name", "industry", "outstanding", "dpd", "asset_class", "ews_action", "ews_triggers"
    )


# --- liquidity ---------------------------------------------------------------
@question("b30", "Coverage ratio today")
def b30(w: Workspace) -> DataFrame:
    return latest_row(w.lcr_daily, "as_of_date").select(
        "as_of_date", "lcr_pct", "lcr_status", "hqla_stock", "net_cash_outflows_30d", "lcr_stress_s1_pct"
    )


@question("b31", "Last ten days of coverage")
def b31(w: Workspace, limit: int = 10) -> DataFrame:
    return w.lcr_daily.orderBy(F.desc("as_of_date")).limit(limit).select(
        "as_of_date", "lcr_pct", "hqla_stock", "gross_outflows", "capped_inflows", "net_cash_outflows_30d", "lcr_status"
    )


@question("b32", "Liquid assets by instrument")
def b32(w: Workspace) -> DataFrame:
    return liquidity.instruments_on_latest_date(w.hqla_holdings).orderBy("hqla_level", F.desc("total_market_val_inr"), "instrument")


@question("b33", "Compliance summary today")
def b33(w: Workspace) -> DataFrame:
    return latest_row(w.lcr_daily, "as_of_date").select(
        "as_of_date", "l1_hqla", "l2a_hqla_post_haircut", "l2b_hqla_post_haircut", "hqla_stock", "net_cash_outflows_30d",
        "lcr_pct", "lcr_status",
    )


@question("b34", "Maturity gaps today")
def b34(w: Workspace) -> DataFrame:
    return latest_row(w.lcr_daily, "as_of_date").select(
        "as_of_date", "net_out_1_7d", "net_out_8_14d", "net_out_15_30d", "net_cash_outflows_30d"
    )


# --- audit -------------------------------------------------------------------
@question("b35", "Cases of one alert")
def b35(w: Workspace, alert_id: str = "ALR-ACC0000029") -> DataFrame:
    return w.cases.where(F.col("alert_id") == alert_id).select(
        "case_id", "alert_id", "typology", "risk_score", "status", F.col("guardrail_result.passed").alias("guardrail_passed"),
        F.col("guardrail_result.unverified_citations").alias("unverified"), "sar_draft", "created_at",
    )


@question("b36", "Alerts of one customer")
def b36(w: Workspace, customer_id: str = DEFAULT_CUSTOMER) -> DataFrame:
    return w.alerts.where(F.col("customer_id") == customer_id).select(
        "alert_id", "account_id", "customer_id", "full_name", "typology", "risk_score", "flag_names"
    )


@question("b37", "Latest audit events")
def b37(w: Workspace, limit: int = 20) -> DataFrame:
    return governance.latest_events(w.audit_log, limit)


@question("b38", "All policy sections")
def b38(w: Workspace) -> DataFrame:
    return w.policy_docs.orderBy("doc_id", "section").select("doc_id", "doc_title", "doc_type", "section", "domain", "chunk_text")


@question("b39", "Cases waiting for review")
def b39(w: Workspace) -> DataFrame:
    return w.cases.where("status = 'PENDING_REVIEW'").orderBy(F.desc("created_at"), "case_id").select(
        "case_id", "alert_id", "account_id", "typology", "risk_score", "status", "action_taken",
        F.col("guardrail_result.passed").alias("guardrail_passed"), "created_by", "created_at",
    )


@question("b40", "Latest draft")
def b40(w: Workspace) -> DataFrame:
    return w.cases.orderBy(F.desc("created_at"), "case_id").limit(1).select(
        "case_id", "alert_id", "typology", "risk_score", "sar_draft", "missing_docs",
        F.col("guardrail_result.passed").alias("guardrail_passed"),
    )


# --- executive ---------------------------------------------------------------
@question("b41", "Alerts by typology")
def b41(w: Workspace) -> DataFrame:
    return (
        w.alerts.groupBy("typology")
        .agg(
            F.count(F.lit(1)).alias("alert_count"), F.sum("inflow_amt_48h").alias("total_inflow_inr"),
            F.sum("outflow_amt_48h").alias("total_outflow_inr"), F.round(F.avg("risk_score")).alias("avg_risk_score"),
        )
        .orderBy(F.desc("alert_count"), "typology")
    )


@question("b42", "Alerts by segment")
def b42(w: Workspace) -> DataFrame:
    return (
        w.alerts.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("alerts"), F.sum("inflow_amt_48h").alias("inflow_exposure_inr"),
            F.sum("outflow_amt_48h").alias("outflow_exposure_inr"),
        )
        .orderBy(F.desc("alerts"), "segment")
    )


@question("b43", "Alerts by typology and action")
def b43(w: Workspace) -> DataFrame:
    return (
        w.alerts.groupBy("typology", "recommended_action")
        .agg(F.count(F.lit(1)).alias("alerts"), F.sum("outflow_amt_48h").alias("total_outflow_inr"))
        .orderBy(F.desc("alerts"), "typology", "recommended_action")
    )


@question("b44", "Executive summary")
def b44(w: Workspace) -> DataFrame:
    return governance.executive_summary(w.alerts, w.cases, w.lcr_daily, w.loan_ews)


@question("b45", "Alerts by action")
def b45(w: Workspace) -> DataFrame:
    return (
        w.alerts.groupBy("recommended_action")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("outflow_amt_48h").alias("total_outflow_inr"))
        .orderBy(F.desc("count"), "recommended_action")
    )


# --- detail views ------------------------------------------------------------
@question("d_txn", "Ten-day transaction trail of an account")
def d_txn(w: Workspace, account_id: str = DEFAULT_ACCOUNT) -> DataFrame:
    return (
        since(w.transactions, w.t, days(10))
        .where(F.col("account_id") == account_id)
        .orderBy(F.desc("txn_ts"), "txn_id")
        .select(
            "txn_id", "txn_ts", "direction", "channel", "amount_inr", "counterparty_account_id", "device_id", "ip_address", "geo_country"
        )
    )


@question("d_flag", "Flag to policy table of an alert")
def d_flag(w: Workspace, alert_id: str = DEFAULT_ALERT) -> DataFrame:
    return w.alerts.where(F.col("alert_id") == alert_id).select(F.inline("red_flags"))


@question("d_cases", "Case list")
def d_cases(w: Workspace) -> DataFrame:
    return w.cases.orderBy(F.desc("created_at"), "case_id").select(
        "case_id", "alert_id", "typology", "risk_score", "status", "action_taken",
        F.col("guardrail_result.passed").alias("guardrail_passed"), "created_by", "created_at", "reviewed_by", "review_decision",
    )
