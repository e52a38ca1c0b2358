"""Behavioural signals per deposit account.

All windows hang on one reference time, the latest transaction of the whole
table unless one is given. The time bound enters each branch as a scalar
subquery (or a literal), so it reaches the parquet scan as a pushed filter and
row groups outside the window are skipped. Each branch aggregates before any
join; all aggregates are keyed by account, so they join without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import days, hours
from ledgerwatch.functions.windows import Anchor, latest, since
from ledgerwatch.operators.cycles import cycles, round_trips
from ledgerwatch.sources.fixed_values import CASH_DAYS, CASH_HIGH, CASH_LOW

WINDOW_HOURS = 48
RISKY_IP_PREFIX = "185."


def activity_48h(transactions: DataFrame, t: Anchor) -> DataFrame:
    """Credits, debits, devices and risky origins of the trailing window.

    The two distinct counts are planned by Spark as a two-level aggregate that
    shuffles on (account, value) first, so an account with a third of all rows is
    spread over many tasks and only its distinct values meet in the last step.
    """
    credit, debit = F.col("direction") == "CREDIT", F.col("direction") == "DEBIT"
    amount = F.col("amount_inr")
    return (
        since(transactions, t, hours(WINDOW_HOURS))
        .groupBy("account_id")
        .agg(
            F.count_if(credit).alias("inflow_cnt_48h"),
            F.count_distinct(F.when(credit, F.col("counterparty_account_id"))).alias("distinct_remitters_48h"),
            F.sum(F.when(credit, amount).otherwise(0)).alias("inflow_amt_48h"),
            F.sum(F.when(debit, amount).otherwise(0)).alias("outflow_amt_48h"),
            F.sum(F.when(debit & F.col("channel").isin("RTGS", "NEFT"), amount).otherwise(0)).alias("rtgs_neft_out_48h"),
            F.count_distinct("device_id").alias("distinct_devices_48h"),
            F.count_if((F.col("geo_country") != "IN") | F.col("ip_address").startswith(RISKY_IP_PREFIX)).alias(
                "foreign_or_risky_ip_txns_48h"
            ),
        )
    )


def last_activity_before(transactions: DataFrame, t: Anchor) -> DataFrame:
    """Latest transaction before the window; reads two columns of the history."""
    return (
        transactions.where(F.col("txn_ts") < t.minus(hours(WINDOW_HOURS)))
        .groupBy("account_id")
        .agg(F.max("txn_ts").alias("last_txn_before_window"))
    )


def near_threshold_cash(transactions: DataFrame, t: Anchor) -> DataFrame:
    return (
        since(transactions, t, days(CASH_DAYS))
        .where((F.col("channel") == "CASH") & (F.col("direction") == "CREDIT"))
        .where(F.col("amount_inr").between(CASH_LOW, CASH_HIGH))
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("cash_near_ctr_10d"), F.sum("amount_inr").alias("cash_near_ctr_amt_10d"))
    )


def best_watchlist_hit(watchlist: DataFrame) -> DataFrame:
    """Highest-scoring sanctions hit per customer; a plain max, so it combines map-side."""
    return (
        watchlist.where(~F.col("list_name").startswith("PEP"))
        .groupBy(F.col("matched_customer_id").alias("customer_id"))
        .agg(F.max(F.struct("match_score", "list_name")).alias("hit"))
        .select("customer_id", F.col("hit.list_name").alias("watchlist_hit"), F.col("hit.match_score").alias("watchlist_score"))
    )


def account_signals(
    accounts: DataFrame,
    customers: DataFrame,
    transactions: DataFrame,
    watchlist: DataFrame,
    t: Anchor | None = None,
    last_activity: DataFrame | None = None,
    rings: DataFrame | None = None,
) -> DataFrame:
    """One row of signals per deposit account.

    ``t`` is the reference time (default: the latest transaction);
    ``last_activity`` replaces the scan of the whole history by a maintained
    per-account summary (see ``streaming.refresh``), ``rings`` the search for cycles by a
    kept table of them.
    """
    t = t or latest(transactions)
    window = activity_48h(transactions, t)
    prior = last_activity if last_activity is not None else last_activity_before(transactions, t)
    cash = near_threshold_cash(transactions, t)
    trips = round_trips(cycles(transactions, t) if rings is None else rings)

    profile = (
        accounts.where(F.col("account_type") != "LOAN")
        .select("account_id", "customer_id", "account_type", "open_date")
        .join(
            customers.select(
                "customer_id", "full_name", "segment", "kyc_risk_rating", "occupation",
                "declared_annual_income", "is_pep", "city",
            ),
            "customer_id",
        )
        .join(best_watchlist_hit(watchlist), "customer_id", "left")
    )
    joined = (
        profile.join(prior, "account_id", "left")
        .join(window, "account_id", "left")
        .join(cash, "account_id", "left")
        .join(trips, "account_id", "left")
        .withColumn("signal_as_of", t.now)
    )

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    window_start = F.col("signal_as_of") - hours(WINDOW_HOURS)
    inflow = F.coalesce(F.col("inflow_amt_48h"), F.lit(0))
    ratio = F.round(F.try_divide(F.col("outflow_amt_48h"), F.col("inflow_amt_48h")), 3).cast("decimal(38,3)")
    return joined.select(
        "account_id", "customer_id", "account_type", "open_date", "full_name", "segment", "kyc_risk_rating",
        "occupation", "declared_annual_income", "is_pep", "city",
        F.datediff(F.col("signal_as_of").cast("date"), "open_date").alias("account_age_days"),
        F.datediff(window_start.cast("date"), F.col("last_txn_before_window").cast("date")).alias("dormant_days_before_window"),
        zero("inflow_cnt_48h"), zero("distinct_remitters_48h"), zero("inflow_amt_48h"),
        zero("outflow_amt_48h"), zero("rtgs_neft_out_48h"),
        F.when(inflow > 0, ratio).alias("pass_through_ratio_48h"),
        zero("distinct_devices_48h"), zero("foreign_or_risky_ip_txns_48h"),
        zero("cash_near_ctr_10d"), zero("cash_near_ctr_amt_10d"),
        zero("round_trip_cycles_7d"), "round_trip_amt", "round_trip_ring",
        "watchlist_hit", "watchlist_score", "signal_as_of",
    )
