"""Schemas of the business tables, and the loader used when they exist as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "customers": (
        "customer_id string, full_name string, segment string, kyc_risk_rating string, city string, "
        "is_pep boolean, onboarded_date date, occupation string, declared_annual_income bigint"
    ),
    "accounts": (
        "account_id string, customer_id string, account_type string, open_date date, status string, "
        "current_balance decimal(18,2)"
    ),
    "scenarios": "account_id string, customer_id string, scenario string",
    "transactions": (
        "txn_id string, account_id string, counterparty_account_id string, txn_ts timestamp_ntz, "
        "channel string, direction string, amount_inr decimal(18,2), device_id string, "
        "ip_address string, geo_country string, synth_label string"
    ),
    "loans": (
        "loan_id string, customer_id string, segment string, product string, industry string, "
        "sanctioned_limit decimal(18,0), disbursal_date date, interest_rate decimal(5,2), "
        "collateral_type string, bureau_score int, outstanding decimal(18,0), "
        "utilization_pct decimal(5,1), dpd int, nach_bounces_90d int, "
        "sales_velocity_chg_pct decimal(5,1)"
    ),
    "watchlist": (
        "list_name string, entity_name string, matched_customer_id string, "
        "match_score decimal(4,2), listed_date date, remarks string"
    ),
    "hqla_holdings": (
        "as_of_date date, instrument string, hqla_level string, haircut decimal(4,2), "
        "market_value_inr decimal(22,0)"
    ),
    "cashflow_positions": (
        "as_of_date date, category string, flow_type string, rate decimal(4,2), bucket string, "
        "balance_inr decimal(22,0)"
    ),
    "policy_docs": (
        "doc_id string, doc_title string, doc_type string, section string, domain string, "
        "effective_date date, chunk_text string"
    ),
    "cases": (
        "case_id string, alert_id string, account_id string, customer_id string, typology string, "
        "risk_score int, status string, assigned_to string, action_taken string, evidence string, "
        "policy_citations array<string>, sar_draft string, "
        "guardrail_result struct<passed:boolean,unverified_citations:array<string>,"
        "retrieved_sections:array<string>,cited_sections:array<string>,confidence:string,"
        "model:string,human_review_required:boolean>, missing_docs array<string>, "
        "created_by string, created_at timestamp_ntz, reviewed_by string, reviewed_at timestamp_ntz, "
        "review_decision string, review_notes string"
    ),
    "audit_log": (
        "event_ts timestamp_ntz, event_user string, event_role string, event_type string, "
        "object_id string, details string"
    ),
    "risk_findings": (
        "finding_id string, alert_id string, account_id string, customer_id string, "
        "finding_type string, severity string, risk_score decimal(5,2), finding_status string, "
        "summary string, primary_policy_id string, primary_regulation_id string, "
        "evidence_count bigint, confidence decimal(5,2), model_version string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "risk_evidence": (
        "evidence_id string, finding_id string, alert_id string, account_id string, "
        "customer_id string, evidence_type string, source_object string, source_record_id string, "
        "observed_value string, expected_value string, evidence_text string, policy_id string, "
        "regulation_id string, rule_id string, confidence decimal(5,2), event_ts timestamp_ntz, "
        "created_at timestamp_ntz, created_by string"
    ),
    "investigation_cases": (
        "case_id string, finding_id string, alert_id string, account_id string, customer_id string, "
        "case_type string, priority string, status string, summary string, evidence_count bigint, "
        "created_by string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "audit_actions": (
        "action_id string, case_id string, finding_id string, action_type string, "
        "target_system string, requested_by string, requested_at timestamp_ntz, status string, "
        "result string, error_message string"
    ),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one business table stored as ``<root>/<name>`` with its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
