"""JSON records of high-risk transactions, as rows of text or as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_records(recent: DataFrame, customer_id: str | None = None) -> DataFrame:
    """One JSON object per transaction, of one customer or of all."""
    chosen = recent if customer_id is None else recent.where(F.col("customer_id") == customer_id)
    return chosen.select("customer_id", F.to_json(F.struct("*")).alias("record"))


def write_json(recent: DataFrame, path: str, customer_id: str | None = None) -> None:
    """Write the records as JSON lines, one folder per customer."""
    json_records(recent, customer_id).write.mode("overwrite").partitionBy("customer_id").text(path)


def parsed_back(records: DataFrame) -> DataFrame:
    """Key fields read out of the JSON text."""
    schema = "txn_id string, customer_id string, amount_inr decimal(18,2), risk_score int, evidence_flags array<struct<flag:string>>"
    return records.select(F.from_json("record", schema).alias("r")).select(
        "r.txn_id", "r.customer_id", "r.amount_inr", "r.risk_score", F.size("r.evidence_flags").alias("n_flags")
    )
