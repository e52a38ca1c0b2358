"""Loan classification, early warning and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import first_match, plain_number
from ledgerwatch.sources.fixed_values import LOAN_LIMITS

UTILISATION, BOUNCES, SALES_DROP, BUREAU = (LOAN_LIMITS[k] for k in ("utilisation", "bounces", "sales_drop", "bureau_score"))
POLICY_REF = "CR-POL 4.1 / CR-POL 5.3"
CAPPED_INDUSTRIES = ("Real Estate", "NBFC Lending")
COMMITTEE = "RESTRUCTURING_DISCUSSION_CREDIT_COMMITTEE"
LIMIT_FREEZE = "LIMIT_FREEZE_AND_COLLATERAL_REVALUATION"


def with_outstanding(loans: DataFrame) -> DataFrame:
    """Outstanding = limit x utilisation, rounded to whole rupees."""
    used = F.col("sanctioned_limit") * F.col("utilization_pct") * F.lit("0.01").cast("decimal(3,2)")
    return loans.withColumn("outstanding", F.round(used, 0).cast("decimal(18,0)"))


def asset_class(dpd: Column) -> Column:
    return first_match(
        [(dpd == 0, "STANDARD"), (dpd <= 30, "SMA-0"), (dpd <= 60, "SMA-1"), (dpd <= 90, "SMA-2")], "NPA"
    )


def ifrs9_stage(dpd: Column) -> Column:
    return first_match([(dpd > 90, "STAGE_3"), (dpd >= 30, "STAGE_2")], "STAGE_1")


def ews_triggers() -> Column:
    util, bounces = F.col("utilization_pct"), F.col("nach_bounces_90d")
    sales, bureau = F.col("sales_velocity_chg_pct"), F.col("bureau_score")
    return F.array_compact(
        F.array(
            F.when(util > UTILISATION, F.concat(F.lit("HIGH_UTILISATION ("), plain_number(util), F.lit("%)"))),
            F.when(bounces >= BOUNCES, F.concat(F.lit("NACH_BOUNCES ("), bounces.cast("string"), F.lit(" in 90d)"))),
            F.when(sales <= SALES_DROP, F.concat(F.lit("SALES_VELOCITY_DROP ("), plain_number(sales), F.lit("%)"))),
            F.when(bureau < BUREAU, F.concat(F.lit("LOW_BUREAU_SCORE ("), bureau.cast("string"), F.lit(")"))),
        )
    )


def ews_action(klass: Column, triggers: Column) -> Column:
    return first_match(
        [
            (klass == "NPA", "NPA_RECOVERY_AND_PROVISIONING"),
            ((triggers >= 3) | (klass == "SMA-2"), COMMITTEE),
            (triggers == 2, LIMIT_FREEZE),
            ((triggers == 1) | klass.isin("SMA-0", "SMA-1"), "WATCHLIST"),
        ],
        "NO_ACTION",
    )


def loan_ews(loans: DataFrame, customers: DataFrame) -> DataFrame:
    named = loans.join(customers.select("customer_id", "full_name"), "customer_id")
    return (
        named.withColumn("asset_class", asset_class(F.col("dpd")))
        .withColumn("ifrs9_stage", ifrs9_stage(F.col("dpd")))
        .withColumn("ews_triggers", ews_triggers())
        .withColumn("ews_trigger_count", F.size("ews_triggers"))
        .withColumn("ews_action", ews_action(F.col("asset_class"), F.col("ews_trigger_count")))
        .withColumn("policy_ref", F.lit(POLICY_REF))
    )


def industry_concentration(loans: DataFrame) -> DataFrame:
    """Share of each industry in the book.

    The book total is its own one-row aggregate, so the share needs no global
    window (which would bring every industry row into one task).
    """
    total = loans.agg(F.sum("outstanding")).scalar()
    limit = F.when(F.col("industry").isin(*CAPPED_INDUSTRIES), 10).otherwise(15)
    return (
        loans.groupBy("industry")
        .agg(F.count(F.lit(1)).alias("loans"), F.sum("outstanding").alias("outstanding_inr"))
        .withColumn("share", 100 * F.col("outstanding_inr").cast("double") / total.cast("double"))
        .withColumn("limit_pct", limit)
        .withColumn("share_pct", F.round("share", 2))
        .withColumn("status", F.when(F.col("share") > F.col("limit_pct"), "BREACH").otherwise("WITHIN_LIMIT"))
        .withColumn("policy_ref", F.lit("CR-POL 7.1"))
        .select("industry", "loans", "outstanding_inr", "share_pct", "limit_pct", "status", "policy_ref")
    )


def exposure(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("outstanding")).otherwise(0))


def gross_npa_pct() -> Column:
    npa = exposure(F.col("dpd") > 90).cast("double")
    return F.round(100 * npa / F.nullif(F.sum("outstanding"), F.lit(0)).cast("double"), 2)


def sma_exposure() -> Column:
    return exposure(F.col("dpd").between(1, 90))


def credit_kpis(ews: DataFrame) -> DataFrame:
    return ews.agg(
        gross_npa_pct().alias("gross_npa_pct"),
        F.round(sma_exposure().cast("double") / 1e7, 0).alias("sma_exposure_cr"),
        F.count_if(F.col("ews_action") == COMMITTEE).alias("committee_referrals"),
    )
