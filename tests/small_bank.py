"""A tiny bank: helpers that build business tables for the tests."""

import datetime as dt
from decimal import Decimal

import demo_values
from ledgerwatch.sources.tables import SCHEMAS

T0 = dt.datetime(2026, 9, 28, 23, 59)


def customers(spark, rows):
    base = dict(segment="INDIVIDUAL", kyc_risk_rating="LOW", city="Pune", is_pep=False, onboarded_date=dt.date(2020, 1, 1), occupation="Salaried", declared_annual_income=1_000_000)
    return spark.createDataFrame([{**base, **r} for r in rows], SCHEMAS["customers"])


def accounts(spark, rows):
    base = dict(account_type="SAVINGS", open_date=dt.date(2020, 1, 1), status="ACTIVE", current_balance=Decimal("1.00"))
    return spark.createDataFrame([{**base, **r} for r in rows], SCHEMAS["accounts"])


def transactions(spark, rows):
    base = dict(counterparty_account_id="X", channel="UPI", direction="CREDIT", amount_inr=Decimal("100.00"), device_id="D1", ip_address="10.0.0.1", geo_country="IN", synth_label="NORMAL")
    out = [{**base, "txn_id": f"T{i}", **r} for i, r in enumerate(rows)]
    for r in out:
        r["amount_inr"] = Decimal(r["amount_inr"])
    return spark.createDataFrame(out, SCHEMAS["transactions"])


def demo(spark):
    """The demo customer with 17 cash deposits just under the reporting limit."""
    c, a = demo_values.DEMO_CUSTOMER, demo_values.DEMO_ACCOUNT
    cust = spark.createDataFrame([(*c[:6], dt.date.fromisoformat(c[6]), c[7], c[8])], SCHEMAS["customers"])
    acc = spark.createDataFrame([(a[0], a[1], a[2], dt.date.fromisoformat(a[3]), a[4], Decimal(a[5]))], SCHEMAS["accounts"])
    txns = transactions(
        spark,
        [
            dict(txn_id=f"TXS-9821-{i:02d}", account_id=a[0], counterparty_account_id=branch, txn_ts=dt.datetime.fromisoformat(ts), channel="CASH",
                 amount_inr=amt, device_id="BRANCH-COUNTER", ip_address=f"10.200.5.{i}", synth_label="STRUCTURING")
            for i, (branch, amt, ts) in enumerate(demo_values.DEMO_CASH_DEPOSITS, start=1)
        ],
    )
    return cust, acc, txns


def demo_feed(spark, account_id):
    return transactions(
        spark,
        [
            dict(txn_id=f"DEMO-{i}", account_id=account_id, counterparty_account_id="CP-DEMO-001", txn_ts=dt.datetime.fromisoformat(ts), channel="IMPS",
                 direction="DEBIT", amount_inr=amt, device_id=dev, ip_address="203.0.113.25", synth_label="DEMO_ACCOUNT_TAKEOVER")
            for i, (ts, amt, dev) in enumerate(demo_values.DEMO_FEED)
        ],
    )
