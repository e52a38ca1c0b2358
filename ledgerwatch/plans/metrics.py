"""A small metric layer: logical tables, declared joins, dimensions and metrics.

``MetricLayer.query(["npa_ratio_pct"], by=["industry"])`` becomes one join chain and
one ``groupBy().agg()``; there is no query language behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.credit import gross_npa_pct, sma_exposure
from ledgerwatch.plans.workspace import Workspace


@dataclass(frozen=True)
class Relationship:
    name: str
    table: str
    column: str
    references: str
    key: str


PRIMARY_KEYS = {
    "alerts": "alert_id", "signals": "account_id", "loans": "loan_id", "lcr": "as_of_date", "conc": "industry", "cases": "case_id",
}

RELATIONSHIPS = [
    Relationship("alerts_to_signals", "alerts", "account_id", "signals", "account_id"),
    Relationship("cases_to_alerts", "cases", "alert_id", "alerts", "alert_id"),
]

# name -> (table, column)
FACTS = {
    "risk_score_f": ("alerts", "risk_score"), "inflow_48h": ("alerts", "inflow_amt_48h"), "outflow_48h": ("alerts", "outflow_amt_48h"),
    "inflow_amt_48h_f": ("signals", "inflow_amt_48h"),
    "outstanding_f": ("loans", "outstanding"), "sanctioned_limit_f": ("loans", "sanctioned_limit"), "dpd_f": ("loans", "dpd"),
    "lcr_pct_f": ("lcr", "lcr_pct"), "lcr_stress_f": ("lcr", "lcr_stress_s1_pct"), "hqla_f": ("lcr", "hqla_stock"),
    "net_outflows_f": ("lcr", "net_cash_outflows_30d"), "gap_1_7_f": ("lcr", "net_out_1_7d"), "gap_8_14_f": ("lcr", "net_out_8_14d"),
    "gap_15_30_f": ("lcr", "net_out_15_30d"), "share_pct_f": ("conc", "share_pct"), "outstanding_inr_f": ("conc", "outstanding_inr"),
}
DIMENSIONS = {
    "alert_id": ("alerts", "alert_id"), "account_id": ("alerts", "account_id"), "customer_id": ("alerts", "customer_id"),
    "customer_name": ("alerts", "full_name"), "typology": ("alerts", "typology"), "recommended_action": ("alerts", "recommended_action"),
    "kyc_risk": ("alerts", "kyc_risk_rating"), "segment": ("alerts", "segment"), "flag_names": ("alerts", "flag_names"),
    "alert_risk_score": ("alerts", "risk_score"),
    "city": ("signals", "city"), "occupation": ("signals", "occupation"), "account_type": ("signals", "account_type"),
    "watchlist_hit": ("signals", "watchlist_hit"),
    "loan_id": ("loans", "loan_id"), "borrower": ("loans", "full_name"), "product": ("loans", "product"), "industry": ("loans", "industry"),
    "loan_segment": ("loans", "segment"), "asset_class": ("loans", "asset_class"), "ifrs9_stage": ("loans", "ifrs9_stage"),
    "ews_action": ("loans", "ews_action"), "collateral_type": ("loans", "collateral_type"), "ews_trigger_count": ("loans", "ews_trigger_count"),
    "as_of_date": ("lcr", "as_of_date"), "lcr_status": ("lcr", "lcr_status"),
    "conc_industry": ("conc", "industry"), "conc_status": ("conc", "status"), "limit_pct": ("conc", "limit_pct"),
    "case_id": ("cases", "case_id"), "case_status": ("cases", "status"), "case_typology": ("cases", "typology"),
    "created_at": ("cases", "created_at"), "reviewed_by": ("cases", "reviewed_by"),
}


def _metrics() -> dict[str, tuple[str, Column]]:
    return {
        "alert_count": ("alerts", F.count("alert_id")),
        "avg_risk_score": ("alerts", F.avg("risk_score")),
        "total_inflow_48h": ("alerts", F.sum("inflow_amt_48h")),
        "total_outflow_48h": ("alerts", F.sum("outflow_amt_48h")),
        "loan_count": ("loans", F.count("loan_id")),
        "total_outstanding": ("loans", F.sum("outstanding")),
        "npa_ratio_pct": ("loans", gross_npa_pct()),
        "sma_exposure": ("loans", sma_exposure()),
        "latest_lcr": ("lcr", F.max_by("lcr_pct", "as_of_date")),
        "avg_lcr": ("lcr", F.avg("lcr_pct")),
        "min_lcr": ("lcr", F.min("lcr_pct")),
        "avg_stress_lcr": ("lcr", F.avg("lcr_stress_s1_pct")),
        "max_industry_share": ("conc", F.max("share_pct")),
        "case_count": ("cases", F.count("case_id")),
    }


METRIC_NAMES = (
    "alert_count", "avg_risk_score", "total_inflow_48h", "total_outflow_48h", "loan_count", "total_outstanding", "npa_ratio_pct",
    "sma_exposure", "latest_lcr", "avg_lcr", "min_lcr", "avg_stress_lcr", "max_industry_share", "case_count",
)


class MetricLayer:
    def __init__(self, w: Workspace):
        self._tables = {
            "alerts": lambda: w.alerts, "signals": lambda: w.signals, "loans": lambda: w.loan_ews,
            "lcr": lambda: w.lcr_daily, "conc": lambda: w.concentration, "cases": lambda: w.cases,
        }

    def table(self, name: str) -> DataFrame:
        return self._tables[name]()

    def _frame(self, base: str, dims: Sequence[str]) -> DataFrame:
        """The base table with the wanted dimensions under their own names."""
        frame = self.table(base).withColumns(
            {f"dim_{d}": F.col(DIMENSIONS[d][1]) for d in dims if DIMENSIONS[d][0] == base}
        )
        here = base
        missing = [d for d in dims if DIMENSIONS[d][0] != base]
        link_col: dict[str, str] = {}
        while missing:
            step = next((r for r in RELATIONSHIPS if r.table == here), None)
            if step is None:
                raise ValueError(f"no relationship from {base} to {DIMENSIONS[missing[0]][0]}")
            wanted = {d: DIMENSIONS[d][1] for d in missing if DIMENSIONS[d][0] == step.references}
            onward = next((r for r in RELATIONSHIPS if r.table == step.references), None)
            other = self.table(step.references).select(
                F.col(step.key).alias("link_key"),
                *[F.col(c).alias(f"dim_{d}") for d, c in wanted.items()],
                *([F.col(onward.column).alias(f"link_{onward.references}")] if onward else []),
            )
            left = F.col(link_col.get(here, step.column))
            frame = frame.withColumn("link_key", left).join(other, "link_key", "left").drop("link_key")
            if onward:
                link_col[step.references] = f"link_{onward.references}"
            missing = [d for d in missing if d not in wanted]
            here = step.references
        return frame

    def query(self, metrics: Sequence[str], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
        """Metrics of one table grouped by dimensions; ``where`` uses ``dim_<name>`` or base columns."""
        known = _metrics()
        bases = {known[m][0] for m in metrics}
        if len(bases) != 1:
            raise ValueError("metrics of one query have to come from one table")
        frame = self._frame(bases.pop(), by)
        if where is not None:
            frame = frame.where(where)
        keys = [F.col(f"dim_{d}").alias(d) for d in by]
        return frame.groupBy(*keys).agg(*[known[m][1].alias(m) for m in metrics])

    def records(self, table: str, names: Sequence[str]) -> DataFrame:
        """Rows of one logical table with the given dimensions and facts under their names."""
        column = {**FACTS, **DIMENSIONS}
        wrong = [n for n in names if column[n][0] != table]
        if wrong:
            raise ValueError(f"not in {table}: {wrong}")
        return self.table(table).select(*[F.col(column[n][1]).alias(n) for n in names])


# --- verified queries ---------------------------------------------------------
def latest_lcr(layer: MetricLayer) -> DataFrame:
    rows = layer.records(
        "lcr", ["as_of_date", "lcr_pct_f", "lcr_stress_f", "lcr_status", "gap_1_7_f", "gap_8_14_f", "gap_15_30_f"]
    )
    return rows.withColumnsRenamed({"lcr_pct_f": "lcr_pct", "lcr_stress_f": "stress_lcr_pct"}).orderBy(F.desc("as_of_date")).limit(1)


_ALERT_LIST = ["alert_id", "account_id", "customer_name", "typology", "alert_risk_score", "recommended_action"]


def top_alerts(layer: MetricLayer, n: int = 20) -> DataFrame:
    return layer.records("alerts", [*_ALERT_LIST, "outflow_48h"]).orderBy(F.desc("alert_risk_score"), "alert_id").limit(n)


def structuring(layer: MetricLayer) -> DataFrame:
    hit = (F.col("typology") == "AML_LAYERING") | F.array_contains("flag_names", "STRUCTURING")
    rows = layer.records("alerts", [*_ALERT_LIST, "flag_names"]).where(hit)
    return rows.select(_ALERT_LIST).orderBy(F.desc("alert_risk_score"), "alert_id")


def sma_by_industry(layer: MetricLayer) -> DataFrame:
    return (
        layer.query(["loan_count", "total_outstanding"], by=["industry", "asset_class"], where=F.col("asset_class") != "STANDARD")
        .withColumnsRenamed({"loan_count": "loans", "total_outstanding": "outstanding_inr"})
        .orderBy("industry", "asset_class")
    )
