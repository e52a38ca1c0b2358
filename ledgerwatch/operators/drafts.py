"""Suspicious-transaction report drafts for a whole table of requests at once.

A request names an alert. Evidence, retrieved policy and a template give the
narrative; the citation check masks whatever is not grounded; the result is a case
for human review plus audit rows. Requests for unknown alerts become audit rows
with an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwatch.functions.columns import whole_number
from ledgerwatch.functions.windows import Anchor
from ledgerwatch.functions.text import masked, ungrounded
from ledgerwatch.operators.evidence import evidence_bundles
from ledgerwatch.operators.retrieval import alert_query, policy_hits
from ledgerwatch.operators.search_index import SearchIndex
from ledgerwatch.sources.tables import SCHEMAS

GENERATOR = "TEMPLATE_V1"
DRAFT_ROLE = "RISK_ANALYST"
MISSING_DOCUMENTS = {
    "PROFILE_MISMATCH": "Proof of income",
    "STRUCTURING": "Cash deposit slips",
    "ROUND_TRIPPING": "Contracts behind the transfers",
    "SANCTIONS_WATCHLIST_HIT": "Identity documents for list disposition",
}


@dataclass(frozen=True)
class DraftResult:
    cases: DataFrame
    rejected: DataFrame
    audit: DataFrame


def narrative() -> Column:
    """The six headed paragraphs, the action, and the analyst's own note."""
    reasons = F.concat_ws(
        "\n",
        F.transform(
            "red_flags",
            lambda f: F.concat(F.lit("- "), f["flag"], F.lit(" ["), f["policy"], F.lit("]: "), f["evidence"]),
        ),
    )
    return F.concat(
        F.lit("## WHO\n"), "full_name", F.lit(" ("), "customer_id", F.lit("), account "), "account_id",
        F.lit(", KYC risk "), "kyc_risk_rating", F.lit(", "), "occupation",
        F.lit("\n## WHAT\nINR "), whole_number(F.col("inflow_amt_48h")), F.lit(" in and INR "),
        whole_number(F.col("outflow_amt_48h")), F.lit(" out within 48 hours"),
        F.lit("\n## WHEN\nUp to "), F.date_format("signal_as_of", "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n## WHERE\n"), "city",
        F.lit("\n## WHY\n"), reasons,
        F.lit("\n## HOW\n"), F.coalesce(F.size("transactions"), F.lit(0)).cast("string"), F.lit(" transactions listed as evidence"),
        F.lit("\n## RECOMMENDED ACTION\n"), "recommended_action",
        F.lit("\n"), F.coalesce(F.col("note"), F.lit("")),
    )


def missing_documents() -> Column:
    return F.array_compact(
        F.array(*[F.when(F.array_contains("flag_names", flag), F.lit(doc)) for flag, doc in MISSING_DOCUMENTS.items()])
    )


def case_id() -> Column:
    return F.concat(F.lit("CASE-"), "account_id", F.lit("-"), F.date_format("requested_at", "yyyyMMddHHmmss"))


def generate_drafts(
    requests: DataFrame, alerts: DataFrame, signals: DataFrame, transactions: DataFrame, index: SearchIndex, t: Anchor,
    doc_types: list[str] | None = None,
) -> DraftResult:
    """``requests``: alert_id, requested_by, requested_at, note.

    ``index`` holds the whole library; ``doc_types`` is the attribute filter of the search
    (None: every document may be cited).
    """
    wanted = alerts.join(requests.select("alert_id").distinct(), "alert_id", "left_semi")
    bundles = evidence_bundles(wanted, signals, transactions, t).withColumn("query_text", alert_query())
    grounded = bundles.join(policy_hits(wanted, index, doc_type=doc_types), "query_text", "left").join(requests, "alert_id")
    cited = F.array_distinct(F.transform("red_flags", lambda f: F.concat(F.lit("["), f["policy"], F.lit("]"))))
    checked = (
        grounded.withColumn("text", narrative())
        .withColumn("cited", cited)
        .withColumn("bad", ungrounded(F.col("text"), F.col("cited"), F.col("allowed"), F.col("context")))
        .withColumn("case_id", case_id())
    )
    guard = F.struct(
        (F.size("bad") == 0).alias("passed"),
        F.col("bad").alias("unverified_citations"),
        F.col("allowed").alias("retrieved_sections"),
        F.col("cited").alias("cited_sections"),
        F.when(F.col("red_flag_count") >= 3, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.lit(GENERATOR).alias("model"),
        F.lit(True).alias("human_review_required"),
    )
    bundle = F.to_json(
        F.struct(
            "alert_id", "account_id", "customer_id", "full_name", "segment", "kyc_risk_rating", "occupation",
            "declared_annual_income", "open_date", "city", "is_pep", "watchlist_hit", "watchlist_score", "typology",
            "risk_score", "recommended_action", "red_flags", "inflow_amt_48h", "outflow_amt_48h", "signal_as_of", "transactions",
        )
    )
    values = {
        "case_id": F.col("case_id"), "alert_id": F.col("alert_id"), "account_id": F.col("account_id"),
        "customer_id": F.col("customer_id"), "typology": F.col("typology"), "risk_score": F.col("risk_score"),
        "status": F.lit("PENDING_REVIEW"), "action_taken": F.col("recommended_action"), "evidence": bundle,
        "policy_citations": F.col("allowed"), "sar_draft": masked(F.col("text"), F.col("bad")),
        "guardrail_result": guard, "missing_docs": missing_documents(), "created_by": F.col("requested_by"),
        "created_at": F.col("requested_at"),
    }
    fields = StructType.fromDDL(SCHEMAS["cases"]).fields
    cases = checked.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    drafted = cases.select(
        F.col("created_at").alias("event_ts"), F.col("created_by").alias("event_user"), F.lit(DRAFT_ROLE).alias("event_role"),
        F.lit("SAR_DRAFT_GENERATED").alias("event_type"), F.col("case_id").alias("object_id"),
        F.to_json(F.struct("alert_id", F.col("guardrail_result.passed").alias("passed"))).alias("details"),
    )
    rejected = rejected_requests(requests, alerts)
    return DraftResult(cases, rejected, drafted.unionByName(rejection_audit(rejected)))


def rejected_requests(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Requests whose alert does not exist."""
    return requests.join(alerts.select("alert_id"), "alert_id", "left_anti").select(
        "alert_id", "requested_by", "requested_at", F.lit("ERROR").alias("status"),
        F.concat(F.lit("Alert "), "alert_id", F.lit(" not found. No report generated.")).alias("message"),
    )


def rejection_audit(rejected: DataFrame) -> DataFrame:
    return rejected.select(
        F.col("requested_at").alias("event_ts"), F.col("requested_by").alias("event_user"), F.lit(DRAFT_ROLE).alias("event_role"),
        F.lit("SAR_REJECTED_UNKNOWN_ALERT").alias("event_type"), F.col("alert_id").alias("object_id"),
        F.to_json(F.struct(F.lit("alert not found").alias("reason"))).alias("details"),
    )
