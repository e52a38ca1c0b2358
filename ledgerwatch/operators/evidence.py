"""Findings kept in step with the alerts, and the evidence behind each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import days, first_match
from ledgerwatch.functions.windows import Anchor, since
from ledgerwatch.operators.state import insert_if_absent, merge_snapshot

MIN_SCORE = 35
MODEL_VERSION = "RULE_ENGINE_V1"
SOURCE_OBJECT = "CURATED.FRAUD_ALERTS"
FINDING_UPDATES = [
    "account_id", "customer_id", "finding_type", "severity", "risk_score", "summary", "evidence_count", "confidence",
]
BUNDLE_SIZE = 40
BUNDLE_DAYS = 10


def stable_id(prefix: str, *parts: str) -> Column:
    """A reproducible id from the natural key (the same row always gets the same id)."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def severity(score: Column) -> Column:
    return first_match([(score >= 80, "CRITICAL"), (score >= 60, "HIGH"), (score >= 35, "MEDIUM")], "LOW")


def finding_changes(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("risk_score") >= MIN_SCORE).select(
        "alert_id", "account_id", "customer_id",
        F.col("typology").alias("finding_type"),
        severity(F.col("risk_score")).alias("severity"),
        F.col("risk_score").cast("decimal(5,2)").alias("risk_score"),
        F.concat(
            F.lit("Potential "), "typology", F.lit(" risk detected for account "), "account_id",
            F.lit(". Red flags: "), F.concat_ws(", ", "flag_names"),
        ).alias("summary"),
        F.col("red_flag_count").cast("bigint").alias("evidence_count"),
        F.least(F.lit(99), 70 + F.col("red_flag_count") * 5).cast("decimal(5,2)").alias("confidence"),
        F.col("signal_as_of").alias("event_ts"),
    )


def upsert_findings(findings: DataFrame, alerts: DataFrame, now: Column | None = None) -> DataFrame:
    """Merge the alerts into the findings; id, status and creation time of known ones stay.

    ``now`` defaults to the reference time of the signals, so a rerun gives the same rows.
    """
    now = F.col("s_event_ts") if now is None else now
    return merge_snapshot(
        findings,
        finding_changes(alerts),
        "alert_id",
        FINDING_UPDATES,
        on_match={"updated_at": now},
        on_insert={
            "finding_id": stable_id("FND", "alert_id"),
            "finding_status": F.lit("OPEN"),
            "model_version": F.lit(MODEL_VERSION),
            "created_at": now,
            "updated_at": now,
        },
    )


def evidence_rows(alerts: DataFrame, findings: DataFrame, actor: str = "risk_engine") -> DataFrame:
    """One row per finding and red flag."""
    known = findings.select("alert_id", "finding_id", "confidence")
    flags = alerts.select("alert_id", "account_id", "customer_id", "signal_as_of", F.explode("red_flags").alias("f"))
    return flags.join(known, "alert_id").select(
        stable_id("EVD", "finding_id", "f.flag").alias("evidence_id"),
        "finding_id", "alert_id", "account_id", "customer_id",
        F.col("f.flag").alias("evidence_type"),
        F.lit(SOURCE_OBJECT).alias("source_object"),
        F.col("alert_id").alias("source_record_id"),
        F.to_json("f").alias("observed_value"),
        F.lit(None).cast("string").alias("expected_value"),
        F.col("f.evidence").alias("evidence_text"),
        F.col("f.policy").alias("policy_id"),
        F.lit(None).cast("string").alias("regulation_id"),
        F.col("f.flag").alias("rule_id"),
        "confidence",
        F.col("signal_as_of").alias("event_ts"),
        F.col("signal_as_of").alias("created_at"),
        F.lit(actor).alias("created_by"),
    )


def new_evidence(evidence: DataFrame, alerts: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence not recorded yet; what was first seen is never overwritten."""
    return insert_if_absent(evidence, evidence_rows(alerts, findings), ["finding_id", "evidence_type"])


def case_summary(investigations: DataFrame, findings: DataFrame) -> DataFrame:
    cols = [
        "case_id", "finding_id", "alert_id", "account_id", "customer_id", "case_type", "priority", "status",
        "summary", "evidence_count", "created_by", "created_at",
    ]
    return investigations.select(cols).join(
        findings.select("finding_id", "risk_score", "severity", "finding_type"), "finding_id", "left"
    )


def alert_transactions(alerts: DataFrame, transactions: DataFrame, t: Anchor, limit: int = BUNDLE_SIZE) -> DataFrame:
    """Up to ``limit`` transactions of the last ten days per alert, most telling first.

    The rank filter sits right above the window, so Spark keeps only ``limit`` rows
    per alert and task before the shuffle, also for a very busy account.
    """
    recent = since(transactions, t, days(BUNDLE_DAYS))
    joined = recent.join(alerts.select("alert_id", "account_id"), "account_id")
    priority = F.when(F.col("channel").isin("RTGS", "NEFT", "CASH"), 0).otherwise(1)
    order = Window.partitionBy("alert_id").orderBy(priority, F.desc("amount_inr"), "txn_id")
    return joined.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")


def evidence_bundles(alerts: DataFrame, signals: DataFrame, transactions: DataFrame, t: Anchor) -> DataFrame:
    """Alert, profile and its (at most 40) transactions in time order, one row per alert."""
    packed = (
        alert_transactions(alerts, transactions, t)
        .groupBy("alert_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("txn_ts").alias("ts"), "txn_id", F.col("direction").alias("dir"), "channel", "amount_inr",
                        F.col("counterparty_account_id").alias("counterparty"), F.col("device_id").alias("device"),
                        F.col("ip_address").alias("ip"), F.col("geo_country").alias("geo"),
                    )
                )
            ).alias("transactions")
        )
    )
    profile = signals.select(
        "account_id", "declared_annual_income", "open_date", "city", "is_pep", "watchlist_hit", "watchlist_score"
    )
    return alerts.join(profile, "account_id").join(packed, "alert_id", "left")
