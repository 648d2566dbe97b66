"""Registry of driver queries: a Spark callable and, where SQL can state
it, the equivalent DuckDB SQL over the same raw tables.

Outputs are normalised the same way on both sides so that the comparison
tests the operator and not number formatting: integers as BIGINT, doubles
rounded to 6 decimals (and -0.0 as 0.0), dates as DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_CHANGED = (T.DoubleType, T.FloatType, T.DecimalType, T.IntegerType, T.ShortType, T.ByteType)


def normalise(df: DataFrame, digits: int = 6) -> DataFrame:
    if not any(isinstance(f.dataType, _CHANGED) for f in df.schema.fields):
        return df  # no expression a column: there may be 60,000
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)  # no -0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def finished(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalise(fn(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def r6(expr: str, alias: str | None = None) -> str:
    """SQL for a double rounded to 6 decimals, with -0.0 made 0.0."""
    e = f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END)"
    return f"{e} AS {alias or expr}"
