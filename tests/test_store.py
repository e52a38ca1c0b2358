"""Curated tables are written once, read back, and refreshed on request."""

from pyspark.sql import functions as F

from ledgerwatch.plans.store import CuratedStore


def test_store_writes_once_and_refreshes(spark, tmp_path):
    store, calls = CuratedStore(spark, str(tmp_path)), []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n).withColumn("day", F.lit("2026-09-28").cast("date"))

        return run

    first = store.table("t", build(3), "day")
    assert store.table("t", build(5), "day").count() == 3 and calls == [3]
    assert store.value("n", lambda: first.agg(F.count("id"))) == 3
    store.forget()
    second = store.table("t", build(5), "day")
    assert (second.count(), first.count(), calls) == (5, 3, [3, 5])
    assert store.value("n", lambda: second.agg(F.count("id"))) == 5
    assert [p.name for p in sorted((tmp_path / "t" / "v2").glob("day=*"))] == ["day=2026-09-28"]
