"""Registry plumbing for named queries: a Spark builder plus an optional DuckDB oracle.

The registered builders take (spark, sf_dir) and return a DataFrame over the whole
supplied tables.  ``finish`` normalises the output for engine-neutral comparison:
timestamps become zone-less (``TIMESTAMP_NTZ``, wall clock in UTC) and doubles are
rounded to 6 digits; the oracle SQL applies the same rounding via ``rounded``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.sources.tables import one_stamp

DIGITS = 6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


QUERIES: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def rounded(sql: str, doubles: list[str]) -> str:
    """Wrap oracle SQL so the listed double columns are rounded like ``finish``."""
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


def register(name: str, operators: str, sql: str | None = None, doubles: list[str] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            with one_stamp():
                return finish(fn(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        QUERIES[name] = Query(name, build, rounded(sql, doubles or []) if sql else None, operators)
        return fn
    return deco


def as_of_literal(df: DataFrame, ts: str = "ts") -> Column:
    """max(ts) of ``df`` as a timestamp literal (one scalar through the driver), so later
    range predicates on it fold to constants and reach the parquet scan."""
    s = df.agg(F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first()["m"]
    if s is None:
        return F.lit(None).cast("timestamp")
    return F.expr(f"TIMESTAMP '{s}'")
