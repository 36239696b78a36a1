"""Cleaning: coercion, non-finite handling, imputation, date repair, text
normalisation, feature selection.

All are column expressions or DataFrame -> DataFrame functions; statistics
(means, counts, std) are one-row or one-row-per-key aggregates joined back,
never collected, except :func:`select_numeric_features`, which returns the
*names* of the kept columns (a schema decision, bounded by the column count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators.index import _keys, fill_backward, fill_forward

MAX_DOUBLE = 1.7976931348623157e308

# Fixed values of the reference's date repair: formats tried in order
# (Python strptime) and their Spark patterns; strptime accepts one-digit
# month/day, so the Spark patterns use single letters.
DATE_FORMATS = ["%Y-%m-%d", "%Y %m/%d", "%Y/%m/%d", "%Y%m%d"]
SPARK_DATE_PATTERNS = ["y-M-d", "y M/d", "y/M/d", "yyyyMMdd"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coerce_numeric(x) -> Column:
    """Non-parsable text -> NULL (pandas ``to_numeric(errors='coerce')``)."""
    return F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")


def is_finite(x) -> Column:
    c = _c(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def inf_to_null(x) -> Column:
    """NaN and +-Inf -> NULL."""
    c = _c(x)
    return F.when(is_finite(c), c)


def nan_to_num(x) -> Column:
    """NULL/NaN -> 0, +Inf -> max double, -Inf -> -max double (numpy)."""
    c = _c(x)
    return (F.when(c.isNull() | F.isnan(c), F.lit(0.0))
            .when(c == F.lit(float("inf")), F.lit(MAX_DOUBLE))
            .when(c == F.lit(float("-inf")), F.lit(-MAX_DOUBLE)).otherwise(c))


def ieee_divide(a, b) -> Column:
    """a / b with IEEE results (+-Inf, NaN) instead of ANSI errors."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return (F.when(b != 0, a / b)
            .when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


def dropna_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL, NaN or infinite."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & is_finite(c)
    return df.filter(cond)


def select_numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns (minus ``exclude``) that are not all-null and not
    constant: one aggregate pass, result = one row per kept column name."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)) and f.name not in exclude]
    aggs = []
    for c in num:
        v = inf_to_null(F.col(c).cast("double"))
        aggs += [F.count(v).alias(f"n__{c}"), F.stddev_pop(v).alias(f"s__{c}")]
    stats = df.agg(*aggs)
    rows = stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"n__{c}").alias("n"), F.col(f"s__{c}").alias("std"))
        for i, c in enumerate(num)])))
    return rows.filter((F.col("n") > 0) & F.col("std").isNotNull() & (F.col("std") != 0)).select("column", "pos")


def impute_mean(df: DataFrame, cols: Sequence[str], keys=None) -> DataFrame:
    """NULL/non-finite -> column mean (per key, or over all rows), then any
    remaining non-finite -> 0."""
    keys = _keys(keys)
    m = df.groupBy(*keys).agg(*[F.avg(inf_to_null(c)).alias(f"_m_{c}") for c in cols]) if keys else \
        df.agg(*[F.avg(inf_to_null(c)).alias(f"_m_{c}") for c in cols])
    d = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    for c in cols:
        d = d.withColumn(c, F.coalesce(inf_to_null(c), F.col(f"_m_{c}"), F.lit(0.0)))
    return d.drop(*[f"_m_{c}" for c in cols])


def impute_ffill_bfill(df: DataFrame, keys, t: str, cols: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill (leading gaps), within each series."""
    return fill_backward(fill_forward(df, keys, t, cols), keys, t, cols)


def impute_linear(df: DataFrame, keys, t: str, cols: Sequence[str]) -> DataFrame:
    """Linear interpolation between the neighbouring observed points, edges
    held at the nearest observation (pandas ``limit_direction='both'``)."""
    d = df
    for c in cols:
        d = d.withColumn(f"_pv_{c}", F.col(c)).withColumn(f"_pt_{c}", F.when(F.col(c).isNotNull(), F.col(t)))
        d = d.withColumn(f"_nv_{c}", F.col(c)).withColumn(f"_nt_{c}", F.when(F.col(c).isNotNull(), F.col(t)))
    d = fill_forward(d, keys, t, [f"_p{k}_{c}" for c in cols for k in ("v", "t")])
    d = fill_backward(d, keys, t, [f"_n{k}_{c}" for c in cols for k in ("v", "t")])
    for c in cols:
        pv, pt, nv, nt = (F.col(f"_{k}_{c}") for k in ("pv", "pt", "nv", "nt"))
        w = (F.col(t) - pt) / (nt - pt)
        interp = F.when(F.col(c).isNotNull(), F.col(c)) \
            .when(pt.isNull(), nv).when(nt.isNull(), pv) \
            .otherwise(pv + (nv - pv) * w)
        d = d.withColumn(c, interp)
    return d.drop(*[f"_{k}_{c}" for c in cols for k in ("pv", "pt", "nv", "nt")])


def fill_text_null(x, fill: str = "null") -> Column:
    """'' -> NULL -> ``fill``."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(fill))


def clean_date_multi(x) -> Column:
    """Parse with the fixed formats in order; else repair a day written as
    '0' (after '/' and ' ' -> '-') to '01'; else NULL.  Returns DATE."""
    s = _c(x)
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in SPARK_DATE_PATTERNS]
    parts = F.split(F.regexp_replace(s, "[/ ]", "-"), "-")
    repaired = F.when((F.size(parts) >= 3) & (F.element_at(parts, 3) == "0"),
                      F.try_to_timestamp(F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit("01")),
                                                               F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))), "-"), F.lit("y-M-d")))
    return F.to_date(F.coalesce(*tries, repaired))


def clean_tickers(x) -> Column:
    """'.' -> '-' in symbols."""
    return F.translate(_c(x), ".", "-")


def compose_text(headline, summary) -> Column:
    """trim(headline + ' ' + summary) with NULL parts as ''."""
    return F.trim(F.concat(F.coalesce(_c(headline), F.lit("")), F.lit(" "), F.coalesce(_c(summary), F.lit(""))))


def tokenize_truncate(x, max_len: int | None) -> Column:
    """Lower-case word tokens (split on non-word characters, empties
    dropped), truncated to ``max_len`` (None: all of them)."""
    toks = F.filter(F.split(F.lower(_c(x)), r"\W+"), lambda s: s != "")
    return toks if max_len is None else F.slice(toks, 1, max_len)
