"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def plain_number(col: Column) -> Column:
    """A decimal as text without trailing zeros (0.90 -> 0.9, 95.0 -> 95)."""
    trimmed = F.regexp_replace(col.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(trimmed, r"\.$", "")


def whole_number(col: Column) -> Column:
    """A number rounded half up, as text."""
    return F.round(col, 0).cast("bigint").cast("string")


def first_match(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """A searched CASE over literal results: the first true condition wins."""
    (cond, value), *rest = cases
    out = F.when(cond, F.lit(value))
    for cond, value in rest:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, NULL where the denominator is 0."""
    return num / F.nullif(den, F.lit(0))


def latest_row(df: DataFrame, by: str, tie: str | None = None) -> DataFrame:
    """The row with the greatest ``by``: one partial aggregate, no sort."""
    key = F.struct(by, tie) if tie else F.col(by)
    packed = df.agg(F.max_by(F.struct(*df.columns), key).alias("row"))
    return packed.where(F.col("row").isNotNull()).select("row.*")


def kpi_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side; each becomes a scalar subquery."""
    first, *rest = parts
    out = first
    for part in rest:
        for name in part.columns:
            out = out.withColumn(name, part.select(name).scalar())
    return out
