"""Named queries: a Spark builder and the SQL to check it against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.catalog.oracle import oracle
from ledgerwatch.plans.workspace import Workspace

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def present(df: DataFrame) -> DataFrame:
    """Flatten a result to scalars that any engine renders alike.

    Integers widen to BIGINT, decimals become DOUBLE, dates and timestamps text,
    arrays of strings one joined text.
    """

    def flat(field: T.StructField):
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, TS_FORMAT)
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, T.ArrayType):
            col = F.when(col.isNotNull(), F.concat_ws("; ", col))
        return col.alias(field.name)

    return df.select(*[flat(f) for f in df.schema.fields])


_RENDER = {
    "i": "CAST({} AS BIGINT)",
    "d": "CAST({} AS DOUBLE)",
    "t": "strftime({}, '%Y-%m-%d %H:%M:%S')",
    "y": "CAST({} AS VARCHAR)",
    "a": "array_to_string({}, '; ')",
}


def select_list(columns: str) -> str:
    """``a; b:i; sum(x) AS c:d`` -> a select list with the casts ``present`` does."""
    out = []
    items = re.findall(r"(?:[^;']|'[^']*')+", columns)  # a semicolon in quotes does not separate
    for item in (c.strip() for c in items if c.strip()):
        kind = re.search(r":([a-z])$", item)
        body = item[: kind.start()] if kind else item
        expr, _, alias = body.rpartition(" AS ")
        expr, alias = (expr, alias) if expr else (body, body.split(".")[-1])
        out.append(f"{_RENDER[kind.group(1)].format(expr) if kind else expr} AS {alias}")
    return ", ".join(out)


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Workspace], DataFrame]
    sql: str | None


class Registry(dict[str, Entry]):
    def add(self, name: str, build: Callable[[Workspace], DataFrame], columns: str | None = None, rest: str | None = None) -> None:
        """Register ``build``; ``columns`` and ``rest`` (FROM ...) give the checking SQL."""
        if name in self:
            raise ValueError(f"duplicate query {name}")
        sql = oracle(f"SELECT {select_list(columns)} {rest}") if columns and rest else None
        self[name] = Entry(name, build, sql)

    def add_sql(self, name: str, build: Callable[[Workspace], DataFrame], sql: str) -> None:
        if name in self:
            raise ValueError(f"duplicate query {name}")
        self[name] = Entry(name, build, oracle(sql))
