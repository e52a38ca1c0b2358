"""Nine explainable red-flag rules and the alerts built from them.

Rules are data: thresholds are parameters, predicates and evidence are column
expressions. The predicates are evaluated once as plain booleans inside codegen
and decide which accounts become alerts; the arrays of structs with their text
are built only for those rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import first_match, hours, plain_number, whole_number
from ledgerwatch.functions.windows import Anchor, since
from ledgerwatch.sources.fixed_values import FLAGS_FOR_ALERT, KYC_BONUS, MAX_SCORE, RULE_BOOK, RULE_LIMITS



def _text(name: str) -> Column:
    return F.col(name).cast("string")


@dataclass(frozen=True)
class Rule:
    flag: str
    policy: str
    weight: int
    predicate: Callable[[], Column]
    evidence: Callable[[], Column]


@dataclass(frozen=True)
class Thresholds:
    new_account_days: int = RULE_LIMITS["new_account_days"]
    dormant_days: int = RULE_LIMITS["dormant_days"]
    burst_credits: int = RULE_LIMITS["burst_credits"]
    remitters: int = RULE_LIMITS["remitters"]
    pass_through: float = RULE_LIMITS["pass_through"]
    pass_through_inflow: int = RULE_LIMITS["pass_through_inflow"]
    devices: int = RULE_LIMITS["devices"]
    risky_origins: int = RULE_LIMITS["risky_origins"]
    income_share: float = RULE_LIMITS["income_share"]
    near_threshold_deposits: int = RULE_LIMITS["near_threshold_deposits"]
    cycles: int = RULE_LIMITS["cycles"]
    watchlist_score: float = RULE_LIMITS["watchlist_score"]


def default_rules(th: Thresholds = Thresholds()) -> list[Rule]:
    c = F.col

    def dec(x: float) -> Column:
        return F.lit(str(x)).cast("decimal(6,3)")

    book = {flag: (policy, weight) for flag, policy, weight in RULE_BOOK}

    def rule(flag: str, predicate: Callable[[], Column], evidence: Callable[[], Column]) -> Rule:
        return Rule(flag, *book[flag], predicate, evidence)

    return [
        rule("NEW_OR_DORMANT_BURST",
             lambda: ((c("account_age_days") <= th.new_account_days) | (c("dormant_days_before_window") >= th.dormant_days))
             & (c("inflow_cnt_48h") >= th.burst_credits),
             lambda: F.concat(F.lit("age "), _text("account_age_days"), F.lit("d, dormant "),
                              F.coalesce(_text("dormant_days_before_window"), F.lit("n/a")), F.lit("d, "),
                              _text("inflow_cnt_48h"), F.lit(" credits/48h"))),
        rule("MANY_REMITTERS",
             lambda: c("distinct_remitters_48h") >= th.remitters,
             lambda: F.concat(_text("distinct_remitters_48h"), F.lit(" distinct remitters in 48h"))),
        rule("RAPID_PASS_THROUGH",
             lambda: (c("pass_through_ratio_48h") >= dec(th.pass_through)) & (c("inflow_amt_48h") >= th.pass_through_inflow),
             lambda: F.concat(whole_number(c("pass_through_ratio_48h") * 100), F.lit("% of INR "),
                              whole_number(c("inflow_amt_48h")), F.lit(" moved out"))),
        rule("DEVICE_IP_ANOMALY",
             lambda: (c("distinct_devices_48h") >= th.devices) | (c("foreign_or_risky_ip_txns_48h") >= th.risky_origins),
             lambda: F.concat(_text("distinct_devices_48h"), F.lit(" devices, "),
                              _text("foreign_or_risky_ip_txns_48h"), F.lit(" foreign/risky-IP txns"))),
        rule("PROFILE_MISMATCH",
             lambda: c("inflow_amt_48h") > c("declared_annual_income") * dec(th.income_share),
             lambda: F.concat(F.lit("INR "), whole_number(c("inflow_amt_48h")), F.lit(" in 48h vs declared income INR "),
                              _text("declared_annual_income"), F.lit(" ("), c("occupation"), F.lit(")"))),
        rule("STRUCTURING",
             lambda: c("cash_near_ctr_10d") >= th.near_threshold_deposits,
             lambda: F.concat(_text("cash_near_ctr_10d"), F.lit(" cash deposits of INR 9-10 lakh in 10 days, total INR "),
                              whole_number(c("cash_near_ctr_amt_10d")))),
        rule("ROUND_TRIPPING",
             lambda: c("round_trip_cycles_7d") >= th.cycles,
             lambda: F.concat(F.lit("Circular flow of ~INR "), whole_number(c("round_trip_amt")),
                              F.lit(" completed within 72h: "), F.concat_ws("; ", c("round_trip_ring")))),
        rule("SANCTIONS_WATCHLIST_HIT",
             lambda: c("watchlist_score") >= dec(th.watchlist_score),
             lambda: F.concat(c("watchlist_hit"), F.lit(" match score "), plain_number(c("watchlist_score")))),
        rule("PEP_ACTIVITY",
             lambda: c("is_pep") & (c("inflow_amt_48h") > 0),
             lambda: F.lit("Customer is a PEP")),
    ]


@dataclass(frozen=True)
class RuleSet:
    rules: list[Rule] = field(default_factory=default_rules)

    def hit(self, flag: str) -> Column:
        return F.col(f"hit_{flag}")

    def evaluate(self, signals: DataFrame) -> DataFrame:
        """Add one boolean per rule, their number and the summed weight."""
        hits = {f"hit_{r.flag}": F.coalesce(r.predicate(), F.lit(False)) for r in self.rules}
        out = signals.withColumns(hits)
        count = sum((self.hit(r.flag).cast("int") for r in self.rules), F.lit(0))
        weight = sum((F.when(self.hit(r.flag), r.weight).otherwise(0) for r in self.rules), F.lit(0))
        return out.withColumns({"red_flag_count": count, "weight_sum": weight})

    def red_flags(self) -> Column:
        """The firing rules as an array of structs, in rule order."""
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        self.hit(r.flag),
                        F.struct(
                            F.lit(r.flag).alias("flag"), F.lit(r.policy).alias("policy"),
                            F.lit(r.weight).alias("weight"), r.evidence().alias("evidence"),
                        ),
                    )
                    for r in self.rules
                ]
            )
        )


def risk_score(weight_sum: Column, kyc: Column) -> Column:
    return F.least(F.lit(MAX_SCORE), weight_sum + F.when(kyc == "HIGH", KYC_BONUS).otherwise(0))


def typology(rules: RuleSet, flag_count: Column) -> Column:
    return first_match(
        [
            (rules.hit("STRUCTURING") | rules.hit("ROUND_TRIPPING"), "AML_LAYERING"),
            ((flag_count >= 2) & rules.hit("RAPID_PASS_THROUGH"), "MONEY_MULE"),
            (rules.hit("SANCTIONS_WATCHLIST_HIT"), "SANCTIONS"),
        ],
        "OTHER",
    )


def recommended_action(sanctioned: Column, weight_sum: Column) -> Column:
    return first_match(
        [
            (sanctioned | (weight_sum >= 60), "FREEZE_ACCOUNT"),
            (weight_sum >= 35, "PLACE_HOLD"),
            (weight_sum >= 20, "STEP_UP_AUTH"),
        ],
        "REVIEW_AND_CLEAR",
    )


def fraud_alerts(signals: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    rules = rules or RuleSet()
    sanctioned = rules.hit("SANCTIONS_WATCHLIST_HIT")
    included = (
        (F.col("red_flag_count") >= FLAGS_FOR_ALERT) | sanctioned | rules.hit("STRUCTURING") | rules.hit("ROUND_TRIPPING")
    )
    flagged = rules.evaluate(signals).where(included)
    return flagged.select(
        F.concat(F.lit("ALR-"), "account_id").alias("alert_id"),
        "account_id", "customer_id", "full_name", "segment", "kyc_risk_rating", "occupation",
        rules.red_flags().alias("red_flags"),
        F.array_compact(F.array(*[F.when(rules.hit(r.flag), F.lit(r.flag)) for r in rules.rules])).alias("flag_names"),
        "red_flag_count",
        risk_score(F.col("weight_sum"), F.col("kyc_risk_rating")).alias("risk_score"),
        typology(rules, F.col("red_flag_count")).alias("typology"),
        recommended_action(sanctioned, F.col("weight_sum")).alias("recommended_action"),
        "inflow_amt_48h", "outflow_amt_48h", "pass_through_ratio_48h", "cash_near_ctr_amt_10d",
        "round_trip_amt", "signal_as_of",
    )


def recent_high_risk_transactions(transactions: DataFrame, alerts: DataFrame, t: Anchor, min_score: int = 45, window_hours: int = 48) -> DataFrame:
    """Transactions of the trailing window on accounts with a high score (unordered)."""
    scored = alerts.where(F.col("risk_score") >= min_score).select(
        "account_id", "customer_id", F.col("full_name").alias("customer_name"), "risk_score", "typology",
        "recommended_action", F.col("red_flags").alias("evidence_flags"),
    )
    recent = since(transactions, t, hours(window_hours)).select(
        "txn_id", "txn_ts", "account_id", "counterparty_account_id", "channel", "direction", "amount_inr"
    )
    return recent.join(scored, "account_id")


def by_score_and_time(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("risk_score"), F.desc("txn_ts"), "txn_id")
