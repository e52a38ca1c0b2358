"""Coverage and loan warnings by what a batch touches."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerwatch.operators.credit import loan_ews
from ledgerwatch.operators.liquidity import lcr_daily
from ledgerwatch.streaming.books import CoverageRefresh, LoanRefresh

DAY = dt.date(2026, 9, 20)


def values(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def files(path, name):
    return {p: p.stat().st_mtime_ns for p in path.glob(f"{name}/**/*.parquet")}


def test_coverage_of_touched_days_only(workspace, spark, tmp_path):
    refresh = CoverageRefresh(spark, str(tmp_path))
    lots, flows = (x.where(F.col("as_of_date").between("2026-09-18", "2026-09-22")) for x in (workspace.hqla_holdings, workspace.cashflow_positions))
    late = F.pmod(F.xxhash64("market_value_inr", "instrument"), F.lit(3)) == 0
    touched = refresh.update(0, hqla_holdings=lots.where(~((F.col("as_of_date") == F.lit(DAY)) & late)), cashflow_positions=flows)
    assert len(touched) == 5
    before = files(tmp_path, "lcr_daily")
    assert refresh.update(1, hqla_holdings=lots.where((F.col("as_of_date") == F.lit(DAY)) & late)) == [DAY]
    want = values(lcr_daily(lots, flows))
    assert values(refresh.coverage()) == want
    after = files(tmp_path, "lcr_daily")
    others = {p for p in before if f"as_of_date={DAY}" not in str(p)}
    assert others and {p: before[p] for p in others} == {p: t for p, t in after.items() if f"as_of_date={DAY}" not in str(p)}
    assert refresh.update(1, hqla_holdings=lots.where((F.col("as_of_date") == F.lit(DAY)) & late)) == [DAY] and values(refresh.coverage()) == want
    assert refresh.update(2, hqla_holdings=lots.limit(0)) == [] and values(refresh.coverage()) == want


def test_warnings_of_touched_loans_only(workspace, spark, tmp_path):
    refresh = LoanRefresh(spark, str(tmp_path), workspace.customers, buckets=8)
    loans = workspace.loans
    refresh.update(loans, 0)
    assert values(refresh.warnings.read()) == values(loan_ews(loans, workspace.customers))
    before = files(tmp_path, "loan_ews")
    one = loans.orderBy("loan_id").limit(1).withColumns({"dpd": F.lit(95), "utilization_pct": F.lit(99).cast("decimal(5,1)")})
    new = one.withColumn("loan_id", F.lit("LON-NEW"))
    buckets = refresh.update(one.unionByName(new), 1)
    assert len(buckets) <= 2
    now = loans.join(one.select("loan_id"), "loan_id", "left_anti").unionByName(one).unionByName(new)
    assert values(refresh.warnings.read()) == values(loan_ews(now, workspace.customers))
    assert before.items() <= files(tmp_path, "loan_ews").items()
    assert {p.parent.name for p in tmp_path.glob("loan_ews/batch_id=1/*/*.parquet")} <= {f"bucket={b}" for b in buckets}
    assert values(refresh.warnings.read(as_of=0)) == values(loan_ews(loans, workspace.customers))
