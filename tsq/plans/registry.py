"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle is ANSI SQL over
the pre-registered parquet views; queries without an exact SQL form register
no oracle (rows-only check) and are tested against a brute-force reference
on a small fixture in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(c, digits: int = 6):
    """Round half up as floor(x*10^d + 0.5)/10^d.

    The same IEEE operations in Spark and DuckDB give the same double for
    the same input, ties included (``round`` differs between the engines on
    ties: decimal HALF_UP of the shortest repr vs binary arithmetic).
    Doubles of 2^52 / 10^d and more have no digits beyond d decimals, so they
    (and NaN and infinities) are their own rounding and pass unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    scale = F.lit(float(10 ** digits))
    return F.when(F.abs(c) < F.lit(2.0 ** 52 / 10 ** digits), F.floor(c * scale + F.lit(0.5)) / scale).otherwise(c)


def rounded(df: DataFrame, digits: int = 6, **per_col: int) -> DataFrame:
    """Round every floating column (6 decimals unless given per column)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = per_col.get(f.name, digits)
            out.append(rnd(f.name, d).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            d = per_col.get(f.name, digits)
            out.append(F.transform(f.name, lambda v, d=d: rnd(v, d)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def dbl(x: float) -> str:
    """A double literal DuckDB reads as exactly the same double."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rnd`."""
    x = f"CAST({expr} AS DOUBLE)"
    sc = f"CAST({float(10 ** digits)!r} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < CAST({2.0 ** 52 / 10 ** digits!r} AS DOUBLE) THEN floor({x} * {sc} + CAST(0.5 AS DOUBLE)) / {sc} "
            f"ELSE {x} END)")
