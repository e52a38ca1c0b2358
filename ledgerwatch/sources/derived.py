"""Business tables derived from the given star-schema tables.

Every table is a narrow projection of a given table (plus unions), so it scans
and prunes like the table it comes from; nothing is generated on the driver and
nothing is shuffled except the two lookups of a name or a segment. The planted
patterns (mule bursts, structuring, rings, watchlist hits) are a fixed fraction
of ``customer``, so they grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.credit import with_outstanding
from ledgerwatch.sources import fixed_values as fv

TRANSACTION_COLUMNS = [
    "txn_id", "account_id", "counterparty_account_id", "txn_ts", "channel", "direction",
    "amount_inr", "device_id", "ip_address", "geo_country", "synth_label",
]
POSITION_DAYS = 30
FLOW_SCALE = "4.05"  # aligns line values with order values, so that the coverage ratio spans all four statuses


def given(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def _pad(expr: str, width: int) -> str:
    """Zero-pad to ``width`` without ever cutting a longer number."""
    text = f"CAST({expr} AS STRING)"
    return f"lpad({text}, greatest({width}, length({text})), '0')"


def _account(expr: str) -> str:
    return f"concat('ACC', {_pad(expr, 7)})"


def _pick(values: list, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({items}), CAST({index} AS INT) + 1)"


def _minutes_after(ts: str, minutes: str) -> str:
    return f"TIMESTAMP_NTZ'{ts}' + make_dt_interval(0, 0, CAST({minutes} AS INT), 0)"


IS_MULE = "c % 125 = 7"
IN_RING = "c % 250 IN (29, 30, 31)"  # one transfer per leg
IN_BUSY_RING = "c % 1000 IN (529, 530, 531)"  # BUSY_TRANSFERS per leg
BUSY_TRANSFERS = 360
SEGMENT = "CASE WHEN c % 10 < 7 THEN 'INDIVIDUAL' WHEN c % 2 = 0 THEN 'MSME' ELSE 'CORPORATE' END"
OPEN_DATE = f"CASE WHEN {IS_MULE} THEN DATE'2026-06-20' ELSE date_sub(DATE'2026-09-28', CAST(30 + (c * 104729) % 3620 AS INT)) END"


def _keys(customer: DataFrame, where: str = "true", *cols: str) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("c"), *cols).where(where)


def customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    named = customer.select(F.col("c_custkey").alias("c"), "c_name", "c_nationkey").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    )
    return named.selectExpr(
        f"concat('CUST', {_pad('c', 6)}) AS customer_id",
        "c_name AS full_name",
        f"{SEGMENT} AS segment",
        f"CASE WHEN {IS_MULE} THEN 'HIGH' WHEN c % 6 < 3 THEN 'LOW' WHEN c % 6 < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS kyc_risk_rating",
        "n_name AS city",
        "c % 50 = 3 AS is_pep",
        f"{OPEN_DATE} AS onboarded_date",
        f"CASE WHEN {IS_MULE} THEN 'Student' ELSE "
        + _pick(["Salaried", "Self-Employed", "Business", "Student", "Retired"], "c % 5")
        + " END AS occupation",
        f"CASE WHEN {IS_MULE} THEN 180000 ELSE 300000 + (c * 7919) % 4700000 END AS declared_annual_income",
    )


def accounts(customer: DataFrame) -> DataFrame:
    def leg(where: str, prefix: str, kind: str) -> DataFrame:
        return _keys(customer, where).selectExpr(
            f"concat('{prefix}', {_pad('c', 7)}) AS account_id",
            f"concat('CUST', {_pad('c', 6)}) AS customer_id",
            f"{kind} AS account_type",
            f"{OPEN_DATE} AS open_date",
            "'ACTIVE' AS status",
            "CAST(5000 + (c * 7919) % 1995000 AS DECIMAL(18,2)) AS current_balance",
        )

    deposit = leg("true", "ACC", f"CASE WHEN {SEGMENT} = 'INDIVIDUAL' THEN 'SAVINGS' ELSE 'CURRENT' END")
    return deposit.unionByName(leg("c % 5 < 2", "LON", "'LOAN'"))


def scenarios(customer: DataFrame) -> DataFrame:
    return _keys(customer).selectExpr(
        f"{_account('c')} AS account_id",
        f"concat('CUST', {_pad('c', 6)}) AS customer_id",
        f"CASE WHEN {IS_MULE} THEN 'MULE' WHEN c % 250 = 18 THEN 'STRUCTURING' "
        f"WHEN {IN_RING} OR {IN_BUSY_RING} THEN 'ROUND_TRIP' END AS scenario",
    ).where("scenario IS NOT NULL")


def ordinary_transactions(orders: DataFrame, customer_count: Column) -> DataFrame:
    """One transaction per order; works on a batch and on a streaming frame."""
    keyed = orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("a"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        customer_count.alias("n"),
    ).withColumn("ch", F.expr("(k * 31 + a) % 100"))
    return keyed.selectExpr(
        f"concat('TXN', {_pad('k', 9)}) AS txn_id",
        f"{_account('a')} AS account_id",
        f"{_account('(a + 1 + (k * 7919) % (n - 1)) % n')} AS counterparty_account_id",
        "TIMESTAMP_NTZ'2026-09-28 23:59:00' - make_dt_interval(0, 0, CAST((k * 48271) % 86400 AS INT), 0) AS txn_ts",
        "CASE WHEN ch < 45 THEN 'UPI' WHEN ch < 60 THEN 'IMPS' WHEN ch < 80 THEN 'NEFT' WHEN ch < 85 THEN 'RTGS' ELSE 'CARD' END AS channel",
        "CASE WHEN k % 2 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS direction",
        "CAST(round(price * 0.1BD, 2) * CASE WHEN ch BETWEEN 80 AND 84 THEN 20 ELSE 1 END AS DECIMAL(18,2)) AS amount_inr",
        f"concat('DEV', {_pad('(a * 7919) % 99999', 5)}) AS device_id",
        "concat('10.', a % 255, '.', (a * 31) % 255, '.1') AS ip_address",
        "'IN' AS geo_country",
        "'NORMAL' AS synth_label",
    )


def planted_transactions(customer: DataFrame, customer_count: Column) -> DataFrame:
    """Suspicious patterns planted on a fixed fraction of the customers."""
    numbered = customer.select(F.col("c_custkey").alias("c"), customer_count.alias("n"))
    mules = numbered.where(IS_MULE)
    gift = "9000 + (c * 104729 + g * 7919) % 40000"

    inflow = mules.withColumn("g", F.expr("explode(sequence(0L, 29L))")).selectExpr(
        f"concat('TXM', {_pad('c', 6)}, {_pad('g', 3)}) AS txn_id",
        f"{_account('c')} AS account_id",
        f"{_account('(c + 1 + 3 * g) % n')} AS counterparty_account_id",
        f"{_minutes_after('2026-09-28 20:00:00', '-(2640 - 60 * g - (g * c) % 50)')} AS txn_ts",
        "CASE WHEN g % 2 = 0 THEN 'UPI' ELSE 'IMPS' END AS channel",
        "'CREDIT' AS direction",
        f"CAST({gift} AS DECIMAL(18,2)) AS amount_inr",
        "concat('DEV', 90000 + (c + g) % 6) AS device_id",
        "concat('185.', (c + g) % 200, '.44.', g % 9) AS ip_address",
        "'IN' AS geo_country",
        "'MULE_INFLOW' AS synth_label",
    )
    received = f"aggregate(transform(sequence(0L, 29L), g -> {gift}), 0L, (t, x) -> t + x)"
    outflow = mules.withColumn("g", F.expr("explode(array(0L, 1L))")).selectExpr(
        f"concat('TXO', {_pad('c', 6)}, g) AS txn_id",
        f"{_account('c')} AS account_id",
        f"concat('EXT-BENF-', {_pad('c % 7', 3)}) AS counterparty_account_id",
        f"{_minutes_after('2026-09-28 08:00:00', '30 + 45 * g')} AS txn_ts",
        "'RTGS' AS channel",
        "'DEBIT' AS direction",
        f"CAST(0.46BD * CAST({received} AS DECIMAL(18,0)) AS DECIMAL(18,2)) AS amount_inr",
        "'DEV90003' AS device_id",
        "'185.12.44.7' AS ip_address",
        "CASE WHEN g = 0 THEN 'IN' ELSE 'AE' END AS geo_country",
        "'MULE_OUTFLOW' AS synth_label",
    )
    deposits = numbered.where("c % 250 = 18").withColumn("g", F.expr("explode(sequence(0L, 7L))")).selectExpr(
        f"concat('TXS', {_pad('c', 6)}, g) AS txn_id",
        f"{_account('c')} AS account_id",
        "concat('CASH-BRANCH-', g % 4) AS counterparty_account_id",
        f"{_minutes_after('2026-09-27 11:00:00', '-1440 * g')} AS txn_ts",
        "'CASH' AS channel",
        "'CREDIT' AS direction",
        "CAST(940000 + (c * 31 + g * 7919) % 55000 AS DECIMAL(18,2)) AS amount_inr",
        "'BRANCH' AS device_id",
        "'0.0.0.0' AS ip_address",
        "'IN' AS geo_country",
        "'STRUCTURING' AS synth_label",
    )
    rings = numbered.where(IN_RING).selectExpr(
        f"concat('TXR', {_pad('c', 6)}) AS txn_id",
        f"{_account('c')} AS account_id",
        f"{_account('CASE WHEN c % 250 = 31 THEN c - 2 ELSE c + 1 END')} AS counterparty_account_id",
        f"{_minutes_after('2026-09-25 10:00:00', '180 * (c % 250 - 29)')} AS txn_ts",
        "'NEFT' AS channel",
        "'DEBIT' AS direction",
        "CAST(2500000 AS DECIMAL(18,2)) AS amount_inr",
        "concat('DEV7', c div 50) AS device_id",
        "concat('10.9.9.', c div 50) AS ip_address",
        "'IN' AS geo_country",
        "'ROUND_TRIP' AS synth_label",
    )
    busy = numbered.where(IN_BUSY_RING).withColumn("g", F.expr(f"explode(sequence(0L, {BUSY_TRANSFERS - 1}L))")).selectExpr(
        f"concat('TXB', {_pad('c', 6)}, {_pad('g', 3)}) AS txn_id",
        f"{_account('c')} AS account_id",
        f"{_account('CASE WHEN c % 1000 = 531 THEN c - 2 ELSE c + 1 END')} AS counterparty_account_id",
        f"{_minutes_after('2026-09-24 00:00:00', '11 * g + 3 * (c % 1000 - 529)')} AS txn_ts",
        "'NEFT' AS channel",
        "'DEBIT' AS direction",
        "CAST(2500000 + 1000 * ((c + g * 7919) % 400) AS DECIMAL(18,2)) AS amount_inr",
        "concat('DEV8', c div 1000) AS device_id",
        "concat('10.9.8.', c div 1000) AS ip_address",
        "'IN' AS geo_country",
        "'ROUND_TRIP' AS synth_label",
    )
    return inflow.unionByName(outflow).unionByName(deposits).unionByName(rings).unionByName(busy)



def customer_count(customer: DataFrame) -> Column:
    return customer.agg(F.count(F.lit(1))).scalar()


def transactions(orders: DataFrame, customer: DataFrame) -> DataFrame:
    n = customer_count(customer)
    return ordinary_transactions(orders, n).unionByName(planted_transactions(customer, n))


def watchlist(customer: DataFrame) -> DataFrame:
    hits = _keys(customer, f"{IS_MULE} OR c % 250 = 31", "c_name").selectExpr(
        "CASE WHEN (c div 125) % 3 = 0 THEN 'OFAC_SDN_SYNTH' ELSE 'UN_CONSOLIDATED_SYNTH' END AS list_name",
        "c_name AS entity_name",
        f"concat('CUST', {_pad('c', 6)}) AS matched_customer_id",
        "CAST((82 + c % 17) * 0.01BD AS DECIMAL(4,2)) AS match_score",
        "DATE'2025-11-01' AS listed_date",
        "'Name match; needs disposition' AS remarks",
    )
    peps = _keys(customer, "c % 50 = 3", "c_name").selectExpr(
        "'PEP_DOMESTIC_SYNTH' AS list_name",
        "c_name AS entity_name",
        f"concat('CUST', {_pad('c', 6)}) AS matched_customer_id",
        "CAST(1 AS DECIMAL(4,2)) AS match_score",
        "DATE'2024-01-01' AS listed_date",
        "'Politically exposed person' AS remarks",
    )
    return hits.unionByName(peps)


def loans(customer: DataFrame) -> DataFrame:
    book = _keys(customer, "c % 5 < 2").selectExpr(
        f"concat('LON', {_pad('c', 7)}) AS loan_id",
        f"concat('CUST', {_pad('c', 6)}) AS customer_id",
        f"{SEGMENT} AS segment",
        f"CASE {SEGMENT} WHEN 'MSME' THEN 'WORKING_CAPITAL' WHEN 'CORPORATE' THEN 'TERM_LOAN' ELSE "
        + _pick(["HOME", "PERSONAL", "AUTO", "GOLD"], "c % 4")
        + " END AS product",
        _pick(fv.INDUSTRIES, "(c div 5) % 10") + " AS industry",
        "CAST((c * 7919) % 800 * 125000 + 100000 AS DECIMAL(18,0)) AS sanctioned_limit",
        f"{OPEN_DATE} AS disbursal_date",
        "CAST((800 + (c * 271) % 1001) * 0.01BD AS DECIMAL(5,2)) AS interest_rate",
        _pick(["PROPERTY", "VEHICLE", "GOLD", "RECEIVABLES", "UNSECURED"], "c % 5") + " AS collateral_type",
        "CAST(300 + (c * 389) % 551 AS INT) AS bureau_score",
        "CAST((200 + (c * 733) % 801) * 0.1BD AS DECIMAL(5,1)) AS utilization_pct",
        "CAST(CASE WHEN (c * 31) % 100 < 60 THEN 0 ELSE 1 + (c * 97) % 130 END AS INT) AS dpd",
        "CAST(CASE WHEN (c * 17) % 100 < 70 THEN 0 ELSE 1 + (c * 13) % 5 END AS INT) AS nach_bounces_90d",
        "CAST(((c * 577) % 1001 - 600) * 0.1BD AS DECIMAL(5,1)) AS sales_velocity_chg_pct",
    )
    return with_outstanding(book)


def hqla_holdings(orders: DataFrame) -> DataFrame:
    """Every order is one lot of a liquid instrument on one of thirty days."""
    names, levels, cuts, base = (list(x) for x in zip(*fv.INSTRUMENTS))
    lots = orders.select(
        F.expr(f"o_orderkey % {POSITION_DAYS}").alias("d"),
        F.expr(f"(o_orderkey div {POSITION_DAYS}) % {len(names)}").alias("i"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    return lots.selectExpr(
        "date_sub(DATE'2026-09-28', CAST(d AS INT)) AS as_of_date",
        f"{_pick(names, 'i')} AS instrument",
        f"{_pick(levels, 'i')} AS hqla_level",
        f"CAST({_pick(cuts, 'i')} AS DECIMAL(4,2)) AS haircut",
        f"CAST(round(price * CAST({_pick(base, 'i')} AS DECIMAL(6,0)) * CAST(1 + 0.004BD * d AS DECIMAL(5,3)), 0) AS DECIMAL(22,0)) AS market_value_inr",
    )


def cashflow_positions(lineitem: DataFrame) -> DataFrame:
    """Every order line is one cash-flow position on one of thirty days."""
    names, flows, rates, base = (list(x) for x in zip(*fv.FLOW_CATEGORIES))
    buckets, weights = (list(x) for x in zip(*fv.BUCKETS))
    lines = lineitem.select(
        F.expr(f"l_orderkey % {POSITION_DAYS}").alias("d"),
        F.expr(f"l_partkey % {len(names)}").alias("i"),
        F.expr(f"l_suppkey % {len(buckets)}").alias("b"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    ).selectExpr("*", f"{_pick(names, 'i')} AS category")
    return lines.selectExpr(
        "date_sub(DATE'2026-09-28', CAST(d AS INT)) AS as_of_date",
        "category",
        f"{_pick(flows, 'i')} AS flow_type",
        f"CAST({_pick(rates, 'i')} AS DECIMAL(4,2)) AS rate",
        f"{_pick(buckets, 'b')} AS bucket",
        f"CAST(round(price * CAST({_pick(base, 'i')} AS DECIMAL(6,0)) * CAST({_pick(weights, 'b')} AS DECIMAL(3,2))"
        " * CAST(CASE WHEN category LIKE '%non-operational%' OR category LIKE '%less stable%' THEN 1 + 0.024BD * (29 - d) ELSE 1 END AS DECIMAL(5,3))"
        f" * {FLOW_SCALE}BD, 0) AS DECIMAL(22,0)) AS balance_inr",
    )


def policy_sections(spark: SparkSession) -> DataFrame:
    cols = "doc_id string, doc_title string, doc_type string, section string, domain string, effective_date string, chunk_text string"
    return spark.createDataFrame(fv.POLICY_SECTIONS, cols).withColumn("effective_date", F.col("effective_date").cast("date"))


def policy_docs(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The policy library: the internal sections and every given document."""
    library = documents.selectExpr(
        f"concat('DOC-', {_pad('doc_id', 7)}) AS doc_id",
        "source AS doc_title",
        "'DOCUMENT' AS doc_type",
        f"concat('DOC-', {_pad('doc_id', 7)}, ' ', lang) AS section",
        _pick(["AML", "FRAUD", "LIQUIDITY", "CREDIT", "GENERAL"], "doc_id % 5") + " AS domain",
        "date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT)) AS effective_date",
        "text AS chunk_text",
    )
    return policy_sections(spark).unionByName(library)
