"""Rule boundaries, scoring, typology and the demo customer."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import small_bank as sb
from ledgerwatch.functions.windows import fixed
from ledgerwatch.operators import rules
from ledgerwatch.operators.signals import account_signals
from ledgerwatch.sources.tables import empty_table

SIGNALS = (
    "account_id string, customer_id string, full_name string, segment string, kyc_risk_rating string, occupation string, "
    "declared_annual_income bigint, is_pep boolean, account_age_days int, dormant_days_before_window int, inflow_cnt_48h bigint, "
    "distinct_remitters_48h bigint, inflow_amt_48h decimal(28,2), outflow_amt_48h decimal(28,2), pass_through_ratio_48h decimal(38,3), "
    "distinct_devices_48h bigint, foreign_or_risky_ip_txns_48h bigint, cash_near_ctr_10d bigint, cash_near_ctr_amt_10d decimal(28,2), "
    "round_trip_cycles_7d bigint, round_trip_amt decimal(18,2), round_trip_ring array<string>, watchlist_hit string, "
    "watchlist_score decimal(4,2), signal_as_of timestamp_ntz"
)
QUIET = dict(
    account_id="A", customer_id="C", full_name="N", segment="MSME", kyc_risk_rating="LOW", occupation="Retired", declared_annual_income=1_000_000,
    is_pep=False, account_age_days=1000, dormant_days_before_window=0, inflow_cnt_48h=0, distinct_remitters_48h=0, inflow_amt_48h=Decimal("0.00"),
    outflow_amt_48h=Decimal("0.00"), pass_through_ratio_48h=None, distinct_devices_48h=0, foreign_or_risky_ip_txns_48h=0, cash_near_ctr_10d=0,
    cash_near_ctr_amt_10d=Decimal("0.00"), round_trip_cycles_7d=0, round_trip_amt=None, round_trip_ring=None, watchlist_hit=None,
    watchlist_score=None, signal_as_of=sb.T0,
)


def signals(spark, *changes):
    return spark.createDataFrame([{**QUIET, "account_id": f"A{i}", **c} for i, c in enumerate(changes)], SIGNALS)


def dec(x):
    return Decimal(x)


# (flag, rows that do not fire, rows that fire)
BOUNDARIES = [
    ("NEW_OR_DORMANT_BURST",
     [dict(account_age_days=180, inflow_cnt_48h=9), dict(account_age_days=181, inflow_cnt_48h=10), dict(dormant_days_before_window=29, inflow_cnt_48h=10),
      dict(account_age_days=181, dormant_days_before_window=None, inflow_cnt_48h=10)],
     [dict(account_age_days=180, inflow_cnt_48h=10), dict(dormant_days_before_window=30, inflow_cnt_48h=11),
      dict(account_age_days=179, dormant_days_before_window=None, inflow_cnt_48h=10)]),
    ("MANY_REMITTERS", [dict(distinct_remitters_48h=14)], [dict(distinct_remitters_48h=15)]),
    ("RAPID_PASS_THROUGH",
     [dict(pass_through_ratio_48h=dec("0.799"), inflow_amt_48h=dec("300000")), dict(pass_through_ratio_48h=dec("0.8"), inflow_amt_48h=dec("199999.99")),
      dict(pass_through_ratio_48h=None, inflow_amt_48h=dec("300000"))],
     [dict(pass_through_ratio_48h=dec("0.8"), inflow_amt_48h=dec("200000"))]),
    ("DEVICE_IP_ANOMALY", [dict(distinct_devices_48h=3, foreign_or_risky_ip_txns_48h=4)], [dict(distinct_devices_48h=4), dict(foreign_or_risky_ip_txns_48h=5)]),
    ("PROFILE_MISMATCH", [dict(inflow_amt_48h=dec("500000.00"))], [dict(inflow_amt_48h=dec("500000.01"))]),
    ("STRUCTURING", [dict(cash_near_ctr_10d=2)], [dict(cash_near_ctr_10d=3, cash_near_ctr_amt_10d=dec("2700000"))]),
    ("ROUND_TRIPPING", [dict(round_trip_cycles_7d=0)], [dict(round_trip_cycles_7d=1, round_trip_amt=dec("2500000"), round_trip_ring=["A>B>C"])]),
    ("SANCTIONS_WATCHLIST_HIT", [dict(watchlist_hit="L", watchlist_score=dec("0.84")), dict(watchlist_score=None)],
     [dict(watchlist_hit="L", watchlist_score=dec("0.85"))]),
    ("PEP_ACTIVITY", [dict(is_pep=True), dict(is_pep=False, inflow_amt_48h=dec("1")), dict(is_pep=None, inflow_amt_48h=dec("1"))],
     [dict(is_pep=True, inflow_amt_48h=dec("0.01"))]),
]


@pytest.mark.parametrize("flag,quiet,firing", BOUNDARIES, ids=[b[0] for b in BOUNDARIES])
def test_rule_boundaries(spark, flag, quiet, firing):
    rs = rules.RuleSet()
    out = rs.evaluate(signals(spark, *quiet, *firing)).orderBy("account_id").select(rs.hit(flag)).collect()
    assert [r[0] for r in out] == [False] * len(quiet) + [True] * len(firing)


def test_evidence_text_is_complete(spark):
    rs = rules.RuleSet()
    rows = signals(
        spark,
        dict(account_age_days=100, dormant_days_before_window=None, inflow_cnt_48h=12, distinct_remitters_48h=20, inflow_amt_48h=dec("867855.50"),
             pass_through_ratio_48h=dec("0.925"), watchlist_hit="OFAC_SDN_SYNTH", watchlist_score=dec("0.90")),
    )
    flags = {f.flag: f.evidence for f in rs.evaluate(rows).select(rs.red_flags().alias("f")).first().f}
    assert flags["NEW_OR_DORMANT_BURST"] == "age 100d, dormant n/ad, 12 credits/48h"
    assert flags["RAPID_PASS_THROUGH"] == "93% of INR 867856 moved out"
    assert flags["PROFILE_MISMATCH"] == "INR 867856 in 48h vs declared income INR 1000000 (Retired)"
    assert flags["SANCTIONS_WATCHLIST_HIT"] == "OFAC_SDN_SYNTH match score 0.9"


def test_inclusion_score_and_typology(spark):
    many = dict(account_age_days=10, inflow_cnt_48h=20, distinct_remitters_48h=20, inflow_amt_48h=dec("900000"), pass_through_ratio_48h=dec("0.92"),
                distinct_devices_48h=6, watchlist_hit="L", watchlist_score=dec("0.9"), kyc_risk_rating="HIGH")
    rows = signals(
        spark,
        many,
        dict(distinct_remitters_48h=15),  # one plain flag: no alert
        dict(cash_near_ctr_10d=3),  # one strong flag: alert
        dict(watchlist_hit="L", watchlist_score=dec("0.9")),
        dict(distinct_remitters_48h=15, distinct_devices_48h=4),
        {**many, "cash_near_ctr_10d": 3},
    )
    got = {r.account_id: r for r in rules.fraud_alerts(rows).collect()}
    assert set(got) == {"A0", "A2", "A3", "A4", "A5"}
    assert (got["A0"].risk_score, got["A0"].typology, got["A0"].recommended_action) == (100, "MONEY_MULE", "FREEZE_ACCOUNT")
    assert (got["A2"].risk_score, got["A2"].typology, got["A2"].recommended_action) == (35, "AML_LAYERING", "PLACE_HOLD")
    assert (got["A3"].typology, got["A3"].recommended_action) == ("SANCTIONS", "FREEZE_ACCOUNT")
    assert (got["A4"].risk_score, got["A4"].typology, got["A4"].recommended_action) == (30, "OTHER", "STEP_UP_AUTH")
    assert got["A5"].typology == "AML_LAYERING"
    assert got["A4"].flag_names == ["MANY_REMITTERS", "DEVICE_IP_ANOMALY"]


def test_every_action_can_be_named(spark):
    """REVIEW_AND_CLEAR cannot come out of the inclusion filter, so the ladder is tested on its own."""
    rows = spark.createDataFrame([(False, 19), (False, 20), (False, 34), (False, 35), (False, 59), (False, 60), (True, 0)], "s boolean, w int")
    got = [r[0] for r in rows.select(rules.recommended_action(F.col("s"), F.col("w"))).collect()]
    assert got == ["REVIEW_AND_CLEAR", "STEP_UP_AUTH", "STEP_UP_AUTH", "PLACE_HOLD", "PLACE_HOLD", "FREEZE_ACCOUNT", "FREEZE_ACCOUNT"]


def test_thresholds_are_parameters(spark):
    strict = rules.RuleSet(rules.default_rules(rules.Thresholds(remitters=5)))
    row = strict.evaluate(signals(spark, dict(distinct_remitters_48h=5))).first()
    assert row.hit_MANY_REMITTERS and row.red_flag_count == 1


def test_demo_customer_and_moving_time_anchor(spark):
    """17 deposits give 55 / PLACE_HOLD / AML_LAYERING; the later feed moves every window past them."""
    cust, acc, txns = sb.demo(spark)
    watch = empty_table(spark, "watchlist")
    alert = rules.fraud_alerts(account_signals(acc, cust, txns, watch)).first()
    assert (alert.risk_score, alert.recommended_action, alert.typology) == (55, "PLACE_HOLD", "AML_LAYERING")
    assert alert.flag_names == ["PROFILE_MISMATCH", "STRUCTURING"]
    assert alert.cash_near_ctr_amt_10d == Decimal("16215000.00")

    with_feed = txns.unionByName(sb.demo_feed(spark, "ACC0009821"))
    later = account_signals(acc, cust, with_feed, watch).first()
    assert later.inflow_cnt_48h == 0 and later.outflow_amt_48h == Decimal("900000.00") and later.distinct_devices_48h == 2
    assert later.cash_near_ctr_10d == 17  # ten days still reach back
    kept = rules.fraud_alerts(account_signals(acc, cust, with_feed, watch, t=fixed(spark, dt.datetime(2026, 9, 28, 21, 30)))).first()
    assert kept.risk_score == 55


def test_windows_are_inclusive_and_cash_bounds_hold(spark):
    cust = sb.customers(spark, [dict(customer_id="C1", full_name="One")])
    acc = sb.accounts(spark, [dict(account_id="A1", customer_id="C1"), dict(account_id="L1", customer_id="C1", account_type="LOAN")])
    h = dt.timedelta(hours=1)
    txns = sb.transactions(
        spark,
        [
            dict(account_id="A1", txn_ts=sb.T0, amount_inr="10"),
            dict(account_id="A1", txn_ts=sb.T0 - 48 * h, amount_inr="20", counterparty_account_id="Y"),
            dict(account_id="A1", txn_ts=sb.T0 - 48 * h - dt.timedelta(seconds=1), amount_inr="40"),
            dict(account_id="A1", txn_ts=sb.T0 - 240 * h, channel="CASH", amount_inr="900000"),
            dict(account_id="A1", txn_ts=sb.T0 - 100 * h, channel="CASH", amount_inr="999999"),
            dict(account_id="A1", txn_ts=sb.T0 - 100 * h, channel="CASH", amount_inr="999999.01"),
            dict(account_id="A1", txn_ts=sb.T0 - 240 * h - dt.timedelta(seconds=1), channel="CASH", amount_inr="950000"),
        ],
    )
    rows = account_signals(acc, cust, txns, empty_table(spark, "watchlist")).collect()
    assert len(rows) == 1  # loan accounts have no signals
    s = rows[0]
    assert (s.inflow_cnt_48h, s.distinct_remitters_48h, s.inflow_amt_48h) == (2, 2, Decimal("30.00"))
    assert (s.cash_near_ctr_10d, s.cash_near_ctr_amt_10d) == (2, Decimal("1899999.00"))
    assert s.pass_through_ratio_48h == Decimal("0.000") and s.dormant_days_before_window == 0
    assert s.round_trip_cycles_7d == 0 and s.watchlist_hit is None
