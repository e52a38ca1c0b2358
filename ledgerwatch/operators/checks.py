"""Data-quality and detection checks, one row (test, expected, actual, result) each."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.text import ungrounded
from ledgerwatch.operators.liquidity import lcr_status
from ledgerwatch.operators.rules import RuleSet

DETECTED_AS = {"MULE": "MONEY_MULE", "STRUCTURING": "AML_LAYERING", "ROUND_TRIP": "AML_LAYERING"}


def same_json_array(a: Column, b: Column) -> Column:
    """Equal as JSON arrays of strings whatever their order (NULL when not arrays)."""
    return F.array_sort(F.from_json(a, "array<string>")) == F.array_sort(F.from_json(b, "array<string>"))


def with_result(checks: DataFrame) -> DataFrame:
    """PASS when equal as text, or as JSON arrays in any order."""
    looks_json = F.col("expected").startswith("[") & F.col("actual").startswith("[")
    equal = (F.col("expected") == F.col("actual")) | (looks_json & same_json_array(F.col("expected"), F.col("actual")))
    return checks.withColumn("result", F.when(equal, "PASS").otherwise("FAIL"))


def _check(df: DataFrame, test: str, expected: Column | str, actual: Column) -> DataFrame:
    want = F.lit(expected) if isinstance(expected, str) else expected
    return with_result(df.agg(F.lit(test).alias("test"), want.alias("expected"), actual.alias("actual")))


def recall(scenarios: DataFrame, alerts: DataFrame, scenario: str) -> DataFrame:
    truth = scenarios.where(F.col("scenario") == scenario).join(alerts.select("account_id", "typology"), "account_id", "left")
    total = F.count(F.lit(1)).cast("string")
    hits = F.count_if(F.col("typology") == DETECTED_AS[scenario]).cast("string")
    return _check(
        truth, f"DETECTION: {scenario.lower()} recall", F.concat(total, F.lit("/"), total), F.concat(hits, F.lit("/"), total)
    )


def alerts_outside_truth(scenarios: DataFrame, alerts: DataFrame) -> DataFrame:
    clean = alerts.join(scenarios.select("account_id"), "account_id", "left_anti")
    return _check(clean, "DETECTION: alerts on clean accounts", "0", F.count(F.lit(1)).cast("string"))


def unmapped_policy_refs(alerts: DataFrame, policies: DataFrame) -> DataFrame:
    """Red flags whose policy has no section.

    The references that can occur are those of the rule set, so the library is searched for
    these literals (no join of flags with sections); the flags then join by equality.
    """
    flags = alerts.select(F.explode("red_flags.policy").alias("policy")).withColumn(
        "ref", F.regexp_replace("policy", r"\([a-z]\)$", "")
    )
    references = sorted({re.sub(r"\([a-z]\)$", "", rule.policy) for rule in RuleSet().rules})
    met = F.array(*[F.when(F.col("section").startswith(ref), F.lit(ref)) for ref in references])
    mapped = policies.select(F.explode(F.array_compact(met)).alias("ref")).distinct()
    unmapped = flags.join(mapped, "ref", "left_anti")
    return _check(
        unmapped, "EXPLAINABILITY: every red flag maps to a policy section", "0 unmapped",
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" unmapped")),
    )


def orphan_transactions(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Aggregated per account before the anti join, so the history itself is not joined."""
    per_account = transactions.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    orphans = per_account.join(accounts.select("account_id"), "account_id", "left_anti")
    return _check(
        orphans, "DATA: transactions reference valid accounts", "0 orphans",
        F.concat(F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" orphans")),
    )


def duplicate_transactions(transactions: DataFrame) -> DataFrame:
    extra = F.count(F.lit(1)) - F.count_distinct("txn_id")
    return _check(transactions, "DATA: no duplicate transaction ids", "0", extra.cast("string"))


def misclassified_loans(ews: DataFrame) -> DataFrame:
    dpd, klass = F.col("dpd"), F.col("asset_class")
    wrong = (
        ((klass == "SMA-0") & ~dpd.between(1, 30)) | ((klass == "SMA-1") & ~dpd.between(31, 60))
        | ((klass == "SMA-2") & ~dpd.between(61, 90)) | ((klass == "NPA") & (dpd <= 90)) | ((klass == "STANDARD") & (dpd != 0))
    )
    return _check(
        ews, "CREDIT: SMA class consistent with DPD", "0 mismatches",
        F.concat(F.count_if(wrong).cast("string"), F.lit(" mismatches")),
    )


def level2_share(lcr: DataFrame) -> DataFrame:
    over = (F.col("hqla_stock") - F.col("l1_hqla")) > 0.4 * F.col("hqla_stock") + 1
    return _check(
        lcr, "LIQUIDITY: level 2 share <= 40% of HQLA", "0 breaches", F.concat(F.count_if(over).cast("string"), F.lit(" breaches"))
    )


def status_consistency(lcr: DataFrame) -> DataFrame:
    """Status (from the unrounded ratio) against the rounded ratio; may differ at a boundary."""
    wrong = F.col("lcr_status") != lcr_status(F.col("lcr_pct"))
    return _check(
        lcr, "LIQUIDITY: status consistent with LCR thresholds", "0 mismatches",
        F.concat(F.count_if(wrong).cast("string"), F.lit(" mismatches")),
    )


def fabricated_refs_caught(drafts: DataFrame) -> DataFrame:
    """``drafts``: planted (a fabricated reference or NULL) and the references found ungrounded."""
    seeded = drafts.where(F.col("planted").isNotNull())
    total = F.count(F.lit(1)).cast("string")
    hit = F.count_if(F.array_contains("unverified", F.col("planted"))).cast("string")
    return _check(seeded, "GUARDRAIL: fabricated clauses are caught", F.concat(total, F.lit("/"), total), F.concat(hit, F.lit("/"), total))


def grounded_refs_pass(drafts: DataFrame) -> DataFrame:
    """A reference copied from a retrieved section must never be flagged."""
    total = F.count(F.lit(1)).cast("string")
    good = F.count_if(~F.array_contains("unverified", F.col("grounded_ref"))).cast("string")
    return _check(
        drafts.where(F.col("grounded_ref").isNotNull()), "GUARDRAIL: grounded clauses pass",
        F.concat(total, F.lit("/"), total), F.concat(good, F.lit("/"), total),
    )


def cases_without_review_flag(cases: DataFrame) -> DataFrame:
    missing = F.count_if(~F.col("guardrail_result.human_review_required").eqNullSafe(F.lit(True)))
    return _check(
        cases, "GOVERNANCE: every case requires human review", "0 without", F.concat(missing.cast("string"), F.lit(" without"))
    )


def high_risk_without_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with score >= 60 and no evidence row; empty when all is well."""
    counts = evidence.groupBy("finding_id").agg(F.count("evidence_id").alias("n"))
    return (
        findings.where(F.col("risk_score") >= 60)
        .join(counts, "finding_id", "left")
        .where(F.coalesce("n", F.lit(0)) == 0)
        .select(F.lit("HIGH_RISK_WITHOUT_EVIDENCE").alias("check_name"), "finding_id", F.lit(1).alias("value"))
    )


def duplicate_evidence(evidence: DataFrame) -> DataFrame:
    return (
        evidence.groupBy("finding_id", "evidence_type")
        .count()
        .where("count > 1")
        .agg(F.lit("DUPLICATE_EVIDENCE").alias("check_name"), F.count(F.lit(1)).alias("value"))
    )


def row_counts(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("value"))

    return n(findings, "RISK_FINDINGS").unionByName(n(evidence, "RISK_EVIDENCE"))


def guardrails(policies: DataFrame, drafts: list[tuple[str, str, list[str], list[str]]]) -> DataFrame:
    """The citation check on known drafts: (test, text, references it may cite, references to be caught).

    Allowed are the sections of the whole library that one of the references names. Expected and
    actual are JSON arrays, compared in any order.
    """
    rows = []
    for test, text, cited, caught in drafts:
        named = reduce(or_, [F.startswith("section", F.lit(c)) for c in cited])
        allowed = F.collect_set(F.when(named, F.col("section")))  # one or a few labels per reference
        actual = F.to_json(ungrounded(F.lit(text), F.array().cast("array<string>"), allowed, F.lit("")))
        rows.append(policies.agg(F.lit(test).alias("test"), F.lit(json.dumps(caught, separators=(",", ":"))).alias("expected"), actual.alias("actual")))
    return with_result(reduce(DataFrame.unionByName, rows))
