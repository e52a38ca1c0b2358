"""Every named query against its SQL on the smallest data; metric layer; exports."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows  # noqa: E402
from conftest import DATA  # noqa: E402
from ledgerwatch.catalog import build_registry  # noqa: E402
from ledgerwatch.catalog.registry import select_list  # noqa: E402
from ledgerwatch.plans import metrics  # noqa: E402
from ledgerwatch.sources import export  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(build_registry()) <= set(SQL) <= set(QUERIES)
    assert {f"b{i:02d}" for i in range(46)} <= set(QUERIES)


def test_select_list():
    assert select_list("a; x.b:i; string_agg(c, '; ') AS d; sum(e) AS f:d") == (
        "a AS a, CAST(x.b AS BIGINT) AS b, string_agg(c, '; ') AS d, CAST(sum(e) AS DOUBLE) AS f"
    )


def test_metric_layer(workspace):
    layer = metrics.MetricLayer(workspace)
    total = layer.query(["alert_count"]).first().alert_count
    by_city = layer.query(["alert_count"], by=["city"]).collect()
    assert sum(r.alert_count for r in by_city) == total
    few = layer.query(["alert_count"], by=["typology"], where=F.col("dim_typology") == "MONEY_MULE").collect()
    assert [r.typology for r in few] == ["MONEY_MULE"]
    with pytest.raises(ValueError):
        layer.query(["alert_count", "loan_count"])
    with pytest.raises(ValueError):
        layer.query(["loan_count"], by=["city"])
    assert set(metrics.METRIC_NAMES) == set(metrics._metrics())


def test_json_export(spark, workspace, tmp_path):
    recent = workspace.recent_high_risk
    customer = recent.select("customer_id").first().customer_id
    export.write_json(recent, str(tmp_path / "out"), customer)
    read = spark.read.json(str(tmp_path / "out"))
    assert read.count() == recent.where(F.col("customer_id") == customer).count()
    assert {"txn_id", "evidence_flags", "risk_score"} <= set(read.columns)


def test_time_filter_reaches_the_scan(workspace):
    from ledgerwatch.operators.signals import activity_48h

    plan = activity_48h(workspace.transactions, workspace.t)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(txn_ts" in plan and "PartitionFilters: [isnotnull(txn_date" in plan
