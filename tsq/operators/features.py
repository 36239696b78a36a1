"""Window features of price / value series: returns, lags, trailing
statistics, RSI, EMA/MACD, Bollinger bands, volatility, targets.

All expressions take a window spec ``w`` ordered by the row position ``t``
inside a series (normally the block window of :mod:`tsq.operators.index`),
so one shuffle + one sort serves every feature that shares the spec.
Trailing statistics exclude the current row (the value at ``t`` is not yet
known when the feature is used), pandas ``min_periods=1`` semantics: the
average of the available non-null values, NULL when there are none;
standard deviations are population (ddof 0).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.operators.index import block_window, core_rows, fill_forward, halo, series_index
from tsq.operators.recurrence import convergence
from tsq.session import materialize

# Fixed values of the reference's feature table
PRIOR_HISTORY_WINDOW = 30
TRADING_DAYS = 252
RSI_PERIOD = 14
SMA_SPANS = (5, 10, 20)
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BOLLINGER_WINDOW, BOLLINGER_K = 20, 2
# fixed leading header of the reference's feature CSV, in its order
PANEL_HEADER = [
    "Month", "Exports", "Imports", "OT", "start_date", "date", "end_date",
    "his_avg_1", "his_std_1", "his_avg_2", "his_std_2", "his_avg_3", "his_std_3",
    "his_avg_4", "his_std_4", "his_avg_5", "his_std_5", "his_avg_6", "his_std_6",
    "his_avg_7", "his_std_7", "prior_history_avg", "prior_history_std",
    "Final_Search_2", "Final_Search_4", "Final_Search_6",
]
STOCK_COLUMNS = ["ticker", "open", "high", "low", "close", "adj_close", "close_used",
                 "volume", "log_return", "pct_change"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(fn, x, n: int, w) -> Column:
    """``fn`` over the ``n`` rows before the current one."""
    return fn(_c(x)).over(w.rowsBetween(-n, -1))


def trailing_mean(x, n: int, w) -> Column:
    return trailing(F.avg, x, n, w)


def trailing_std(x, n: int, w) -> Column:
    return trailing(F.stddev_pop, x, n, w)


def log_return(x, w) -> Column:
    x = _c(x)
    return F.ln(F.try_divide(x, F.lag(x, 1).over(w)))


def first_diff(x, w) -> Column:
    x = _c(x)
    return x - F.lag(x, 1).over(w)


def pct_change(filled, w) -> Column:
    """x_t / x_{t-1} - 1 of a series without inner gaps: fill nulls with
    :func:`tsq.operators.index.fill_forward` first (pandas 1.5 pads them)."""
    filled = _c(filled)
    return F.try_divide(filled, F.lag(filled, 1).over(w)) - F.lit(1.0)


def rsi_from_delta(delta, w, period: int = RSI_PERIOD) -> Column:
    """Simple-mean RSI over ``period`` deltas (``delta`` = first difference
    column); NULL until ``period`` deltas exist and when the average loss is 0."""
    d = _c(delta)
    fr = w.rowsBetween(-(period - 1), 0)
    gain = F.when(d > 0, d).when(d.isNotNull(), F.lit(0.0))
    loss = F.when(d < 0, -d).when(d.isNotNull(), F.lit(0.0))
    n = F.count(d).over(fr)
    avg_gain = F.when(n == period, F.avg(gain).over(fr))
    avg_loss = F.when(n == period, F.avg(loss).over(fr))
    rs = avg_gain / F.nullif(avg_loss, F.lit(0.0))
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)


def ema_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def stock_features(panel: DataFrame, keys: str = "ticker", date: str = "date",
                   price: str = "close", adj_price: str | None = "adj_close",
                   block: int | None = None) -> DataFrame:
    """The full feature table of the reference's panel builder.

    One row per (ticker, date) with: close_used (adjusted close when present,
    else close), log_return, pct_change, lag_1..7 of log_return,
    rolling_mean/std_1..7 of close_used, his_avg/std_1..7 and
    prior_history_avg/std (30) of log_return, sma_5/10/20, rsi_14,
    macd/macd_signal/macd_hist, Bollinger (20, 2), annualised 20-row
    volatility; plus the fixed header columns (Month, date as text, the
    download span start/end, null placeholders).
    Plan: a row index per series; prices filled forward and smoothed
    (MACD's two averages and the one of their difference) in one pass of
    block carries; one halo explode and two window passes over one (ticker, block)
    partitioning for everything else.
    """
    cu = F.coalesce(F.col(adj_price), F.col(price)) if adj_price and adj_price in panel.columns else F.col(price)
    p = panel.withColumn("close_used", cu.cast("double"))
    if adj_price and adj_price not in p.columns:
        p = p.withColumn(adj_price, F.lit(None).cast("double"))
    # the panel is an aggregate of a large scan with four consumers (index
    # counts, index rows, usable-series filter, download span): build it once
    p = materialize(p)
    # per-series facts once, in one small table: usable-price count (series
    # without any are skipped) and date span (for the download span)
    st = materialize(p.groupBy(keys).agg(F.count("close_used").alias("_n"), F.min(date).alias("_s0"),
                                         F.max(date).alias("_e0")).filter("_n > 0"), "series-stats")
    p = p.join(st.select(keys), keys, "left_semi")
    span = st.agg(F.min("_s0").alias("_s"), F.max("_e0").alias("_e"))
    p = series_index(p, keys, date)

    p = convergence(p, keys, "t", "close_used", *[ema_alpha(n) for n in (MACD_FAST, MACD_SLOW, MACD_SIGNAL)])
    p = materialize(p, "panel-smoothed")
    back = PRIOR_HISTORY_WINDOW + 2
    if block is None:
        block = 4096
    h = halo(p, "t", back=back, block=block)
    w = block_window(keys, "t")
    c = F.col("close_used")
    h = h.withColumn("log_return", log_return(c, w))
    cols = [
        pct_change("_filled", w).alias("pct_change"),
        (c - F.lag(c, 1).over(w)).alias("_delta"),
    ]
    lr = F.col("log_return")
    cols += [F.lag(lr, k).over(w).alias(f"lag_{k}") for k in range(1, 8)]
    for n in range(1, 8):
        cols += [trailing_mean(c, n, w).alias(f"rolling_mean_{n}"),
                 trailing_std(c, n, w).alias(f"rolling_std_{n}")]
    for n in range(1, 8):
        cols += [trailing_mean(lr, n, w).alias(f"his_avg_{n}"),
                 trailing_std(lr, n, w).alias(f"his_std_{n}")]
    cols += [trailing_mean(lr, PRIOR_HISTORY_WINDOW, w).alias("prior_history_avg"),
             trailing_std(lr, PRIOR_HISTORY_WINDOW, w).alias("prior_history_std")]
    cols += [trailing_mean(c, s, w).alias(f"sma_{s}") for s in SMA_SPANS]
    cols += [trailing_mean(c, BOLLINGER_WINDOW, w).alias("bb_sma20"),
             trailing_std(c, BOLLINGER_WINDOW, w).alias("bb_std20"),
             (trailing_std(lr, BOLLINGER_WINDOW, w) * F.lit(math.sqrt(TRADING_DAYS))).alias("volatility_20_ann")]
    h = h.select("*", *cols)
    h = h.select(
        "*",
        rsi_from_delta("_delta", w).alias("rsi_14"),
    ).drop("_delta", "_filled")
    out = core_rows(h)
    out = out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")) \
        .withColumn("bb_upper", F.col("bb_sma20") + F.lit(float(BOLLINGER_K)) * F.col("bb_std20")) \
        .withColumn("bb_lower", F.col("bb_sma20") - F.lit(float(BOLLINGER_K)) * F.col("bb_std20"))
    # download span = first/last date of the whole panel (one-row table)
    out = out.crossJoin(F.broadcast(span))
    out = out.select(
        "*",
        F.date_format(date, "yyyy-MM").alias("Month"),
        F.lit(None).cast("double").alias("Exports"),
        F.lit(None).cast("double").alias("Imports"),
        F.lit(None).cast("double").alias("OT"),
        F.date_format("_s", "yyyy-MM-dd").alias("start_date"),
        F.date_format("_e", "yyyy-MM-dd").alias("end_date"),
        F.lit(None).cast("string").alias("Final_Search_2"),
        F.lit(None).cast("string").alias("Final_Search_4"),
        F.lit(None).cast("string").alias("Final_Search_6"),
    ).drop("_s", "_e").withColumn(date, F.date_format(date, "yyyy-MM-dd"))
    extra = sorted(c for c in out.columns if c not in PANEL_HEADER + STOCK_COLUMNS and c != "t")
    return out.select(*PANEL_HEADER, *STOCK_COLUMNS, *extra)


def with_features(df: DataFrame, keys, t: str, build, back: int, ahead: int = 0,
                  block: int = 4096) -> DataFrame:
    """Run ``build(w) -> [Column]`` over halo blocks and keep core rows."""
    h = halo(df, t, back=back, ahead=ahead, block=max(block, back, ahead))
    w = block_window(keys, t)
    return core_rows(h.select("*", *build(w)))


def next_return_target(df: DataFrame, keys, t: str, price: str, out: str = "target") -> DataFrame:
    """target = p_{t+1} / p_t - 1; the last row of each series is dropped."""
    res = with_features(df, keys, t, lambda w: [(F.try_divide(F.lead(price, 1).over(w), F.col(price)) - F.lit(1.0)).alias(out)],
                        back=0, ahead=1)
    return res.filter(F.col(out).isNotNull())
