"""Queues, triage, maker-checker review, investigations, audit packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import latest_row
from ledgerwatch.operators.credit import gross_npa_pct, sma_exposure
from ledgerwatch.operators.evidence import stable_id

DECISION_STATUS = {
    "APPROVE_FOR_FILING": "APPROVED_FOR_FILING",
    "REJECT": "CLOSED_NO_STR",
    "REQUEST_INFO": "INFO_REQUESTED",
}
OPEN_STATUS = ("PENDING_REVIEW", "INFO_REQUESTED")
ADMIN_ROLE = "ACCOUNTADMIN"
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
TRIAGE_SCORE = 60
TRIAGE_CANDIDATES = 50
HIGH_RISK = 60


def alert_queue(alerts: DataFrame, typologies: list[str] | None = None) -> DataFrame:
    """Alerts to work on, highest score first; of some typologies, or of all."""
    chosen = alerts if typologies is None else alerts.where(F.col("typology").isin(typologies))
    return chosen.select(
        "alert_id", "account_id", "full_name", "typology", "risk_score", "recommended_action", "red_flag_count",
        "inflow_amt_48h", "outflow_amt_48h", "kyc_risk_rating", "occupation",
    ).orderBy(F.desc("risk_score"), "alert_id")


def queue_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("open_alerts"),
        F.count_if(F.col("recommended_action") == "FREEZE_ACCOUNT").alias("critical_freeze"),
        F.round(F.sum("outflow_amt_48h").cast("double") / 1e5, 1).alias("outflow_at_risk_lakh"),
        F.round(F.avg("risk_score"), 0).alias("avg_risk_score"),
    )


# --- triage ------------------------------------------------------------------
def triage_selection(alerts: DataFrame, cases: DataFrame, max_drafts: int) -> DataFrame:
    """The alerts an unattended run drafts next: high score, no case yet, best first."""
    without_case = alerts.where(F.col("risk_score") >= TRIAGE_SCORE).join(cases.select("alert_id"), "alert_id", "left_anti")
    return (
        without_case.select("alert_id", "account_id", "risk_score")
        .orderBy(F.desc("risk_score"), "alert_id")
        .limit(min(int(max_drafts), TRIAGE_CANDIDATES))
    )


def triage_summary(selected: DataFrame, drafted: DataFrame, lcr: DataFrame) -> DataFrame:
    """One row for the run: drafted, failed (no case came back), the liquidity line."""
    outcome = selected.join(drafted.select("alert_id", "case_id"), "alert_id", "left").agg(
        F.count_if(F.col("case_id").isNotNull()).alias("drafted"),
        F.count_if(F.col("case_id").isNull()).alias("failed"),
    )
    line = latest_row(lcr, "as_of_date")
    return (
        outcome.withColumn("as_of", line.select("as_of_date").scalar())
        .withColumn("lcr_pct", line.select("lcr_pct").scalar())
        .withColumn("lcr_status", line.select("lcr_status").scalar())
        .withColumn("stress_s1", line.select("lcr_stress_s1_pct").scalar())
    )


def triage_event(selected: DataFrame, drafted: DataFrame, lcr: DataFrame, now: Column) -> DataFrame:
    """The audit row of a run: its drafts with their citation check, what failed and why, the liquidity line.

    Both lists hold at most ``TRIAGE_CANDIDATES`` entries, in the order of the run.
    """
    cases = drafted.select("alert_id", "case_id", F.col("guardrail_result.passed").alias("passed"))
    outcome = selected.join(cases, "alert_id", "left")
    place = [(-F.col("risk_score")).alias("place"), "alert_id"]

    def listed(condition: Column, entry: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(*place, entry.alias("entry"))))), lambda x: x["entry"])

    made = F.struct(F.col("alert_id").alias("alert"), F.col("case_id").alias("case"), F.col("passed").alias("guardrail_passed"))
    failed = F.struct(F.col("alert_id").alias("alert"), F.lit("no case was drafted").alias("error"))
    lists = outcome.agg(listed(F.col("case_id").isNotNull(), made).alias("drafted"), listed(F.col("case_id").isNull(), failed).alias("failed"))
    line = latest_row(lcr, "as_of_date").select(
        F.struct(F.col("as_of_date").cast("string").alias("as_of"), "lcr_pct", F.col("lcr_status").alias("status"), F.col("lcr_stress_s1_pct").alias("stress_s1"))
    )
    return lists.withColumn("lcr", line.scalar()).select(
        now.alias("event_ts"), F.lit("task").alias("event_user"), F.lit("SYSTEM").alias("event_role"), F.lit("AUTO_TRIAGE_RUN").alias("event_type"),
        F.lit("TASK").alias("object_id"), F.to_json(F.struct("drafted", "failed", "lcr")).alias("details"),
    )


# --- maker-checker -----------------------------------------------------------
def review(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Check every decision against its case; one outcome row per decision.

    ``decisions``: decision_id, case_id, decision, notes, reviewer, reviewer_role,
    decided_at. Several decisions on one case act in time order: the first one that
    closes the case makes the later ones fail, as if they had been run in turn.
    """
    book = cases.groupBy("case_id").agg(F.max("created_by").alias("maker"), F.max("status").alias("case_status"))
    joined = decisions.join(book, "case_id", "left")
    valid = F.col("decision").isin(*DECISION_STATUS)
    was_open = F.coalesce(F.col("case_status").isin(*OPEN_STATUS), F.lit(False))
    own_case = (
        (F.col("decision") == "APPROVE_FOR_FILING") & (F.col("maker") == F.col("reviewer")) & (F.col("reviewer_role") != ADMIN_ROLE)
    )
    closes = valid & was_open & ~own_case & F.col("decision").isin("APPROVE_FOR_FILING", "REJECT")
    seq = F.struct("decided_at", "decision_id")
    ordered = joined.withColumn("seq", seq).withColumn(
        "closed_by", F.min(F.when(closes, F.struct("seq", "decision"))).over(Window.partitionBy("case_id"))
    )
    closed_before = F.coalesce(F.col("closed_by.seq") < F.col("seq"), F.lit(False))
    status_now = F.when(closed_before, _new_status(F.col("closed_by.decision"))).otherwise(F.col("case_status"))
    message = (
        F.when(~valid, "Decision must be APPROVE_FOR_FILING, REJECT or REQUEST_INFO")
        .when(F.col("case_status").isNull(), "Case not found")
        .when(closed_before | ~was_open, F.concat(F.lit("Case already "), status_now))
        .when(own_case, "Maker-checker violation: the case creator cannot approve it")
    )
    return (
        ordered.withColumn("message", message)
        .withColumn("status", F.when(F.col("message").isNull(), "OK").otherwise("ERROR"))
        .withColumn("new_status", F.when(F.col("message").isNull(), _new_status(F.col("decision"))))
        .withColumn("missing_notes", F.coalesce(F.trim("notes"), F.lit("")) == "")
        .select(
            "decision_id", "case_id", "decision", "reviewer", "reviewer_role", "decided_at", "notes", "maker",
            "status", "message", "new_status", "missing_notes",
        )
    )


def _new_status(decision: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, status in DECISION_STATUS.items():
        out = F.when(decision == name, F.lit(status)).otherwise(out)
    return out


def apply_reviews(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cases after the accepted decisions; the last accepted one is what stays on the case."""
    last = (
        outcomes.where(F.col("status") == "OK")
        .groupBy("case_id")
        .agg(
            F.max_by(
                F.struct("new_status", "decision", "notes", "reviewer", "decided_at"), F.struct("decided_at", "decision_id")
            ).alias("r")
        )
    )
    joined = cases.join(last, "case_id", "left")
    values = {
        "status": F.coalesce("r.new_status", "status"),
        "review_decision": F.coalesce("r.decision", "review_decision"),
        "review_notes": F.coalesce("r.notes", "review_notes"),
        "reviewed_by": F.coalesce("r.reviewer", "reviewed_by"),
        "reviewed_at": F.coalesce("r.decided_at", "reviewed_at"),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in cases.columns])


def review_audit(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == "OK").select(
        F.col("decided_at").alias("event_ts"), F.col("reviewer").alias("event_user"), F.col("reviewer_role").alias("event_role"),
        F.lit("CASE_REVIEWED").alias("event_type"), F.col("case_id").alias("object_id"),
        F.to_json(F.struct("decision", "notes", "maker")).alias("details"),
    )


def latest_events(audit: DataFrame, n: int) -> DataFrame:
    return audit.orderBy(F.desc("event_ts"), "object_id", "event_type").limit(n)


# --- investigations ----------------------------------------------------------
def open_investigations(requests: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome per request (request_id, finding_id, priority, summary, requested_by, requested_at)."""
    counts = evidence.groupBy("finding_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    known = findings.select("finding_id", "alert_id", "account_id", "customer_id")
    joined = requests.join(known, "finding_id", "left").join(counts, "finding_id", "left")
    priority = F.upper("priority")
    message = F.when(~F.coalesce(priority.isin(*PRIORITIES), F.lit(False)), "INVALID_PRIORITY").when(
        F.col("alert_id").isNull(), "FINDING_NOT_FOUND"
    )
    ok = F.col("status") == "SUCCESS"
    return (
        joined.withColumn("message", message)
        .withColumn("status", F.when(F.col("message").isNull(), "SUCCESS").otherwise("ERROR"))
        .withColumn("case_id", F.when(ok, stable_id("CASE", "finding_id", "request_id")))
        .withColumn("priority", F.when(ok, priority))
        .withColumn("evidence_count", F.when(ok, F.coalesce("evidence_count", F.lit(0))))
        .withColumn("case_type", F.when(ok, F.lit("FRAUD_RISK_INVESTIGATION")))
        .select(
            "request_id", "finding_id", "status", "message", "case_id", "alert_id", "account_id", "customer_id",
            "case_type", "priority", "summary", "evidence_count", "requested_by", "requested_at",
        )
    )


def investigation_rows(outcomes: DataFrame) -> DataFrame:
    """The accepted requests as rows of the investigation table."""
    return outcomes.where(F.col("status") == "SUCCESS").select(
        "case_id", "finding_id", "alert_id", "account_id", "customer_id", "case_type", "priority",
        F.lit("OPEN").alias("status"), "summary", "evidence_count", F.col("requested_by").alias("created_by"),
        F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"),
    )


def investigation_actions(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == "SUCCESS").select(
        stable_id("ACT", "case_id", "request_id").alias("action_id"), "case_id", "finding_id",
        F.lit("CREATE_INVESTIGATION").alias("action_type"), F.lit("WAREHOUSE").alias("target_system"),
        "requested_by", "requested_at", F.lit("SUCCESS").alias("status"),
        F.to_json(F.struct("case_id", "evidence_count")).alias("result"), F.lit(None).cast("string").alias("error_message"),
    )


def notification_requests(cases: DataFrame, message: Column, actor: str) -> DataFrame:
    """Pending notification rows; nothing is sent."""
    return cases.select(
        stable_id("ACT", "case_id").alias("action_id"), "case_id", F.lit(None).cast("string").alias("finding_id"),
        F.lit("NOTIFY_FRAUD_TEAM").alias("action_type"), F.lit("CHAT").alias("target_system"),
        F.lit(actor).alias("requested_by"), F.col("created_at").alias("requested_at"), F.lit("PENDING").alias("status"),
        F.to_json(F.struct(message.alias("message"))).alias("result"), F.lit(None).cast("string").alias("error_message"),
    )


# --- findings ----------------------------------------------------------------
def clamp(n: int, low: int = 1, high: int = 50) -> int:
    return max(low, min(int(n), high))


def high_risk_findings(findings: DataFrame, limit: int = 10) -> DataFrame:
    return (
        findings.where(F.col("risk_score") >= HIGH_RISK)
        .select(
            "finding_id", "alert_id", "account_id", "customer_id", "finding_type", "severity", "risk_score", "summary",
            "evidence_count", "confidence", "created_at",
        )
        .orderBy(F.desc("risk_score"), F.desc("created_at"), "finding_id")
        .limit(clamp(limit))
    )


def evidence_chain(evidence: DataFrame, finding_id: str | Column | None = None) -> DataFrame:
    chain = evidence if finding_id is None else evidence.where(F.col("finding_id") == finding_id)
    return chain.select(
        "finding_id", "alert_id", "account_id", "customer_id", "evidence_id", "evidence_type", "source_object",
        "source_record_id", "evidence_text", "policy_id", "regulation_id", "rule_id", "confidence", "event_ts",
    ).orderBy("event_ts", "evidence_id")


def validate_findings(requested: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """VALID / INSUFFICIENT_EVIDENCE / FINDING_NOT_FOUND for every requested finding."""
    counts = evidence.groupBy("finding_id").agg(F.count("evidence_id").alias("evidence_count"))
    joined = (
        requested.select("finding_id")
        .join(findings.select("finding_id", "risk_score", "severity"), "finding_id", "left")
        .join(counts, "finding_id", "left")
    )
    found = F.col("risk_score").isNotNull()
    n = F.coalesce(F.col("evidence_count"), F.lit(0))
    status = F.when(~found, "ERROR").when((F.col("risk_score") < HIGH_RISK) | (n > 0), "VALID").otherwise("INSUFFICIENT_EVIDENCE")
    return joined.select(
        "finding_id", status.alias("status"), F.when(~found, "FINDING_NOT_FOUND").alias("message"),
        "risk_score", F.when(found, n).alias("evidence_count"), F.when(found, F.lit(True)).alias("human_review_required"),
    )


def audit_packages(findings: DataFrame, evidence: DataFrame, generated_at: Column) -> DataFrame:
    """One package per finding: its fields and its evidence, at most one entry per rule."""
    packed = evidence.groupBy("finding_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "evidence_id", F.col("evidence_type").alias("type"), F.col("evidence_text").alias("text"), "policy_id",
                    "regulation_id", "rule_id", "source_record_id", "event_ts",
                )
            )
        ).alias("evidence")
    )
    empty = F.array().cast(packed.schema["evidence"].dataType)
    head = F.struct(
        "finding_id", "alert_id", "account_id", "customer_id", "finding_type", "severity", "risk_score",
        F.col("finding_status").alias("status"), "summary", "confidence", "model_version",
    )
    return findings.join(packed, "finding_id", "left").select(
        "finding_id", F.lit("AUDIT_READY_RISK_FINDING").alias("package_type"), generated_at.alias("generated_at"),
        head.alias("finding"), F.coalesce("evidence", empty).alias("evidence"),
    )


def executive_summary(alerts: DataFrame, cases: DataFrame, lcr: DataFrame, ews: DataFrame) -> DataFrame:
    """Nine headline numbers in one row."""
    latest = latest_row(lcr, "as_of_date")
    by_status = cases.agg(
        F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending"),
        F.count_if(F.col("status") == "APPROVED_FOR_FILING").alias("filed"),
    )
    loans = ews.agg(gross_npa_pct().alias("npa"), sma_exposure().alias("sma"))
    return (
        alerts.agg(
            F.count(F.lit(1)).alias("total_open_alerts"),
            F.count_if(F.col("recommended_action") == "FREEZE_ACCOUNT").alias("critical_freeze_alerts"),
            F.sum("outflow_amt_48h").alias("total_48h_outflow_exposure_inr"),
        )
        .withColumn("pending_sar_cases", by_status.select("pending").scalar())
        .withColumn("filed_sar_cases", by_status.select("filed").scalar())
        .withColumn("latest_lcr_pct", latest.select("lcr_pct").scalar())
        .withColumn("latest_lcr_status", latest.select("lcr_status").scalar())
        .withColumn("gross_npa_pct", loans.select("npa").scalar())
        .withColumn("sma_exposure_inr", loans.select("sma").scalar())
    )
