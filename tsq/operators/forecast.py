"""Baseline forecasters and forecast assembly on long-form horizons.

A forecast table has one row per (series, window, step h); each baseline is
a lookup of an already-known value by key (equi-join on (series, t)), so
forecasting never gathers a window into an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.operators.index import _keys


def horizon_frame(df: DataFrame, keys, t: str, seq_len: int, pred_len: int,
                  lo: str | int | None = None, hi: str | int | None = None) -> DataFrame:
    """Targets of every stride-1 window inside rows [lo, hi) (columns or
    constants; default the whole series): each target row t is step
    h in 1..pred_len of window s = t - seq_len - h + 1 with lo <= s and
    s + seq_len + pred_len <= hi.  Adds window_id (= s), h, origin
    (= s + seq_len - 1)."""
    keys = _keys(keys)
    d = df
    if hi is None:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hi"))
        d = d.join(n, keys) if keys else d.crossJoin(F.broadcast(n))
        hi_c = F.col("_hi")
    else:
        hi_c = F.col(hi) if isinstance(hi, str) else F.lit(hi)
    lo_c = F.lit(0) if lo is None else (F.col(lo) if isinstance(lo, str) else F.lit(lo))
    d = d.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(pred_len))))
    s = F.col(t) - F.lit(seq_len) - F.col("h") + F.lit(1)
    d = d.withColumn("window_id", s.cast("long")).filter(
        (F.col("window_id") >= lo_c) & (F.col("window_id") + F.lit(seq_len + pred_len) <= hi_c))
    return d.withColumn("origin", F.col("window_id") + F.lit(seq_len - 1)).drop("_hi")


def lookup(frame: DataFrame, values: DataFrame, keys, at: str, t: str, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Attach ``cols`` of ``values`` at position ``frame[at]`` (equi-join on
    (keys, t)); missing positions give NULL."""
    keys = _keys(keys)
    v = values.select(*[F.col(k).alias(f"_lk_{k}") for k in keys], F.col(t).alias("_lk_t"),
                      *[F.col(c).alias(prefix + c) for c in cols])
    cond = F.col(at) == F.col("_lk_t")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_lk_{k}"))
    return frame.join(v, cond, "left").drop("_lk_t", *[f"_lk_{k}" for k in keys])


def seasonal_source(t: str, h: str, period: int):
    """Position of the seasonal-naive source: t - m * ceil(h / m)."""
    return F.col(t) - F.lit(period) * F.ceil(F.col(h) / F.lit(period))


def blend_prior(y_hat, prior, weight: float, text=None):
    """(1 - w) * y_hat + w * (text + prior); text defaults to 0."""
    extra = prior if text is None else (text + prior)
    return F.lit(1.0 - weight) * y_hat + F.lit(weight) * extra


def damped_phi_sum(phi: float, h):
    return F.lit(phi) * (F.lit(1.0) - F.pow(F.lit(phi), h)) / F.lit(1.0 - phi)
