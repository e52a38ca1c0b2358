"""Requests, decisions and earlier state derived from the alerts and customers.

They give the governance operators something to work on: every kind of request
(valid, unknown, malformed), decision and earlier state occurs, in a number that
grows with the alerts and customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwatch.operators.evidence import MIN_SCORE, MODEL_VERSION, stable_id
from ledgerwatch.sources.tables import SCHEMAS

FABRICATED_BRACKET = "[AML-POL 9.9]"
FABRICATED_CLAUSE = "Section 45-IA"
GROUNDED_REF = "[AML-POL 6.2]"


def _with_number(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("c", F.expr("CAST(substring(account_id, 4) AS BIGINT)"))


def draft_requests(alerts: DataFrame, customer: DataFrame) -> DataFrame:
    """Requests for most alerts, with a note that cites well, badly, or badly in words."""
    known = _with_number(alerts).where("c % 7 NOT IN (0, 5)").selectExpr(
        "alert_id",
        "concat('analyst_', c % 3) AS requested_by",
        "signal_as_of + make_dt_interval(0, 0, CAST(c % 600 AS INT), 0) AS requested_at",
        f"CASE c % 3 WHEN 0 THEN 'See {GROUNDED_REF}' WHEN 1 THEN 'See {FABRICATED_BRACKET}' ELSE 'See {FABRICATED_CLAUSE}' END AS note",
    )
    unknown = customer.where("c_custkey % 100 = 9").selectExpr(
        "concat('ALR-UNKNOWN-', c_custkey) AS alert_id",
        "'analyst_9' AS requested_by",
        "TIMESTAMP_NTZ'2026-09-28 12:00:00' AS requested_at",
        "CAST(NULL AS STRING) AS note",
    )
    return known.unionByName(unknown)


def first_decisions(cases: DataFrame) -> DataFrame:
    """Decisions that give the book its closed and waiting cases."""
    return (
        _with_number(cases)
        .where("c % 7 IN (2, 3, 4)")
        .selectExpr(
            "concat('DEC1-', case_id) AS decision_id",
            "case_id",
            "CASE c % 7 WHEN 2 THEN 'REQUEST_INFO' WHEN 3 THEN 'APPROVE_FOR_FILING' ELSE 'REJECT' END AS decision",
            "'first look' AS notes",
            "'checker_1' AS reviewer",
            "'CHECKER' AS reviewer_role",
            "created_at + INTERVAL '60' MINUTE AS decided_at",
        )
    )


def second_decisions(cases: DataFrame, customer: DataFrame) -> DataFrame:
    """Every mix of decision, case state, own or other reviewer and role; some cases twice."""
    base = _with_number(cases)
    first = base.selectExpr(
        "concat('DEC2-', case_id) AS decision_id",
        "case_id",
        "CASE c % 4 WHEN 0 THEN 'APPROVE_FOR_FILING' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'REQUEST_INFO' ELSE 'ESCALATE' END AS decision",
        "CASE WHEN c % 3 = 0 THEN '' ELSE 'second look' END AS notes",
        "CASE WHEN c % 8 = 0 THEN created_by ELSE 'checker_2' END AS reviewer",
        "CASE WHEN c % 5 = 0 THEN 'ACCOUNTADMIN' ELSE 'CHECKER' END AS reviewer_role",
        "created_at + INTERVAL '120' MINUTE AS decided_at",
    )
    again = base.where("c % 4 IN (1, 2)").selectExpr(
        "concat('DEC3-', case_id) AS decision_id",
        "case_id",
        "'APPROVE_FOR_FILING' AS decision",
        "'third look' AS notes",
        "CASE WHEN c % 3 = 1 THEN created_by ELSE 'checker_3' END AS reviewer",
        "'CHECKER' AS reviewer_role",
        "created_at + INTERVAL '180' MINUTE AS decided_at",
    )
    unknown = customer.where("c_custkey % 100 = 9").selectExpr(
        "concat('DEC2-', c_custkey) AS decision_id",
        "concat('CASE-UNKNOWN-', c_custkey) AS case_id",
        "'REJECT' AS decision",
        "CAST(NULL AS STRING) AS notes",
        "'checker_2' AS reviewer",
        "'CHECKER' AS reviewer_role",
        "TIMESTAMP_NTZ'2026-09-28 12:00:00' AS decided_at",
    )
    return first.unionByName(again).unionByName(unknown)


def earlier_findings(alerts: DataFrame, customer: DataFrame) -> DataFrame:
    """Findings of an earlier run: half of today's with old values, and some whose alert is gone."""
    kept = _with_number(alerts).where(f"c % 2 = 0 AND risk_score >= {MIN_SCORE}").select(
        stable_id("FND", "alert_id").alias("finding_id"), "alert_id", "account_id", "customer_id",
        F.col("typology").alias("finding_type"), F.lit("LOW").alias("severity"),
        (F.col("risk_score") - 5).alias("risk_score"),
        F.when(F.expr("c % 3 = 0"), "CLOSED").otherwise("OPEN").alias("finding_status"),
        F.lit("earlier run").alias("summary"), F.lit(1).alias("evidence_count"), F.lit(60).alias("confidence"),
        (F.col("signal_as_of") - F.expr("INTERVAL '1' DAY")).alias("created_at"),
    )
    gone = customer.where("c_custkey % 200 = 11").select(
        F.expr("concat('ALR-OLD-', c_custkey)").alias("alert_id"), F.lit("OTHER").alias("finding_type"),
        F.lit("HIGH").alias("severity"), F.lit(65).alias("risk_score"), F.lit("OPEN").alias("finding_status"),
        F.lit("earlier run").alias("summary"), F.lit(2).alias("evidence_count"), F.lit(80).alias("confidence"),
        F.expr("TIMESTAMP_NTZ'2026-09-20 12:00:00'").alias("created_at"),
    ).withColumn("finding_id", stable_id("FND", "alert_id"))
    both = kept.unionByName(gone, allowMissingColumns=True)
    both = both.withColumn("model_version", F.lit(MODEL_VERSION)).withColumn("updated_at", F.col("created_at"))
    return conform(both, "risk_findings")


def earlier_evidence(alerts: DataFrame) -> DataFrame:
    """The first red flag of those findings, as it was seen first."""
    rows = (
        _with_number(alerts)
        .where(f"c % 2 = 0 AND risk_score >= {MIN_SCORE}")
        .withColumn("finding_id", stable_id("FND", "alert_id"))
        .withColumn("f", F.element_at("red_flags", 1))
        .select(
            stable_id("EVD", "finding_id", "f.flag").alias("evidence_id"), "finding_id", "alert_id", "account_id",
            "customer_id", F.col("f.flag").alias("evidence_type"), F.lit("EARLIER").alias("source_object"),
            F.col("alert_id").alias("source_record_id"), F.lit("first seen").alias("evidence_text"),
            F.col("f.policy").alias("policy_id"), F.col("f.flag").alias("rule_id"), F.lit(60).alias("confidence"),
            (F.col("signal_as_of") - F.expr("INTERVAL '1' DAY")).alias("event_ts"),
        )
    )
    return conform(rows, "risk_evidence")


def investigation_requests(findings: DataFrame, customer: DataFrame) -> DataFrame:
    """Requests with every priority (also in lower case and invalid), and unknown findings."""
    number = "pmod(CAST(conv(substring(finding_id, 5, 6), 16, 10) AS BIGINT), 5)"
    known = findings.selectExpr(
        "concat('REQ-', finding_id) AS request_id",
        "finding_id",
        f"CASE {number} WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'Critical' ELSE 'URGENT' END AS priority",
        "concat('Look at ', account_id) AS summary",
        "'investigator_1' AS requested_by",
        "updated_at AS requested_at",
    )
    unknown = customer.where("c_custkey % 100 = 9").selectExpr(
        "concat('REQ-', c_custkey) AS request_id",
        "concat('FND-UNKNOWN-', c_custkey) AS finding_id",
        "'HIGH' AS priority",
        "'nothing' AS summary",
        "'investigator_1' AS requested_by",
        "TIMESTAMP_NTZ'2026-09-28 12:00:00' AS requested_at",
    )
    return known.unionByName(unknown)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a business table in order and type; missing ones become NULL."""
    fields = StructType.fromDDL(SCHEMAS[table]).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
