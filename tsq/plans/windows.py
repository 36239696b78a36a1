"""Queries: window features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsq.operators import features as fe
from tsq.operators import windows as wo
from tsq.operators.index import series_index
from tsq.operators.recurrence import Smooth, smoothed
from tsq.plans import sqlparts as S
from tsq.plans.features import PRICE_COLS, _stock, _stock_sql
from tsq.plans.registry import dbl, query, r, rounded
from tsq.session import materialize
from tsq.sources import tables as tb

# Window sizes of the reference's weekly experiment: seq 24, label 12, pred 12
SEQ_LEN, LABEL_LEN, PRED_LEN = 24, 12, 12
MA_KERNEL = 25
MULTI_KERNELS = (12, 24)
SMOOTH_ALPHA = 0.8
DAMP_PHI, DAMP_H = 0.9, 12
STRIDE_WIN, STRIDE_STEP = 8, 4
LAST_WINDOW = 24


# ---------------------------------------------------------------- panel columns
def _panel_cols(name, cols):
    def fn(spark, sf):
        return _stock(spark, sf).select("ticker", "date", *cols)
    sql = f"SELECT ticker, date, {', '.join(cols)} FROM ({_stock_sql()})"
    query(name, sql)(fn)


_panel_cols("log_return", ["log_return"])
_panel_cols("pct_change", ["pct_change"])
_panel_cols("lag_k", [f"lag_{k}" for k in range(1, 8)])
_panel_cols("rolling_mean_w", [f"rolling_mean_{n}" for n in range(1, 8)])
_panel_cols("rolling_std_w", [f"rolling_std_{n}" for n in range(1, 8)])
_panel_cols("his_avg_n", [f"his_avg_{n}" for n in range(1, 8)])
_panel_cols("his_std_n", [f"his_std_{n}" for n in range(1, 8)])
_panel_cols("prior_history_avg", ["prior_history_avg"])
_panel_cols("prior_history_std", ["prior_history_std"])
_panel_cols("sma_span", [f"sma_{s}" for s in fe.SMA_SPANS])
_panel_cols("rsi", ["rsi_14"])
_panel_cols("macd", ["macd"])
_panel_cols("macd_signal", ["macd_signal"])
_panel_cols("macd_hist", ["macd_hist"])
_panel_cols("bollinger", ["bb_sma20", "bb_std20", "bb_upper", "bb_lower"])
_panel_cols("volatility_ann", ["volatility_20_ann"])


def indexed_panel(spark, sf):
    p = materialize(tb.ticker_panel(spark, sf))
    return series_index(p, "ticker", "date")


def indexed_daily(spark, sf):
    d = materialize(tb.daily_series(spark, sf))
    return series_index(d, "series_id", "date")


def indexed_events(spark, sf):
    return series_index(tb.event_series(spark, sf), "series_id", ["ts", "event_id"])


PANEL_SQL = f"panel AS ({S.PANEL}), p AS ({S.PANEL_T})"
DAILY_SQL = f"daily AS ({S.DAILY}), d AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS t FROM daily)"
EVENTS_SQL = f"""ev0 AS ({S.EVENT_SERIES}),
ev AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1 AS t FROM ev0)"""


# ------------------------------------------------------------------------ ema
@query("ema", f"""
WITH RECURSIVE {PANEL_SQL},
e(ticker, t, e12, e26) AS (
  SELECT ticker, t, close_used, close_used FROM p WHERE t = 0
  UNION ALL
  SELECT p.ticker, p.t, {dbl(1 - fe.ema_alpha(12))} * e.e12 + {dbl(fe.ema_alpha(12))} * p.close_used,
         {dbl(1 - fe.ema_alpha(26))} * e.e26 + {dbl(fe.ema_alpha(26))} * p.close_used
  FROM e JOIN p ON p.ticker = e.ticker AND p.t = e.t + 1)
SELECT p.ticker, p.date, {r('e12', 4)} AS ema_12, {r('e26', 4)} AS ema_26
FROM p JOIN e ON p.ticker = e.ticker AND p.t = e.t
""")
def q_ema(spark, sf):
    p = indexed_panel(spark, sf)
    res = smoothed(p, "ticker", "t", [Smooth("close", fe.ema_alpha(n), f"ema_{n}") for n in (12, 26)])
    return rounded(res.select("ticker", "date", "ema_12", "ema_26"), 4)


@query("first_diff", f"""
WITH {PANEL_SQL}
SELECT ticker, date, {r('close - lag(close) OVER (PARTITION BY ticker ORDER BY t)')} AS diff FROM p
""")
def q_first_diff(spark, sf):
    p = indexed_panel(spark, sf)
    res = fe.with_features(p, "ticker", "t", lambda w: [fe.first_diff("close", w).alias("diff")], back=1)
    return rounded(res.select("ticker", "date", "diff"))


@query("next_return_target", f"""
WITH {PANEL_SQL}
SELECT ticker, date, {r('target')} AS target FROM (
  SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY t) / close - 1.0 AS target FROM p)
WHERE target IS NOT NULL
""")
def q_next_return(spark, sf):
    p = indexed_panel(spark, sf)
    return rounded(fe.next_return_target(p, "ticker", "t", "close").select("ticker", "date", "target"))


# --------------------------------------------------------------- windowing
@query("sliding_windows", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d)
SELECT CAST(d.t - k.k AS BIGINT) AS window_id, CAST(k.k AS INTEGER) AS step, d.date, {r('d.OT')} AS value,
       k.k < {SEQ_LEN} AS in_x, k.k >= {SEQ_LEN - LABEL_LEN} AS in_y
FROM d CROSS JOIN c CROSS JOIN range(0, {SEQ_LEN + PRED_LEN}) k(k)
WHERE d.t - k.k >= 0 AND d.t - k.k <= c.n - {SEQ_LEN + PRED_LEN}
""")
def q_sliding(spark, sf):
    d = indexed_daily(spark, sf)
    w = wo.sliding_windows(d, "series_id", "t", SEQ_LEN, LABEL_LEN, PRED_LEN)
    return rounded(w.select("window_id", "step", "date", F.col("OT").alias("value"), "in_x", "in_y"))


@query("strided_windows", f"""
WITH {EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1)
SELECT ev.series_id, CAST((ev.t - k.k) / {STRIDE_STEP} AS BIGINT) AS window_id, CAST(k.k AS INTEGER) AS step,
       ev.event_id, {r('ev.value')} AS value
FROM ev JOIN c USING (series_id) CROSS JOIN range(0, {STRIDE_WIN}) k(k)
WHERE ev.t - k.k >= 0 AND (ev.t - k.k) % {STRIDE_STEP} = 0 AND ev.t - k.k <= c.n - {STRIDE_WIN}
""")
def q_strided(spark, sf):
    e = indexed_events(spark, sf)
    w = wo.strided_windows(e, "series_id", "t", STRIDE_WIN, STRIDE_STEP)
    return rounded(w.select("series_id", "window_id", "step", "event_id", "value"))


@query("split_chrono", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n,
    CAST(floor(count(*) * {dbl(0.7)}) AS BIGINT) AS n_train, CAST(floor(count(*) * {dbl(0.2)}) AS BIGINT) AS n_test FROM d)
SELECT d.date, d.t, s.split FROM d CROSS JOIN c, (VALUES ('train'), ('val'), ('test')) s(split)
WHERE (s.split = 'train' AND d.t < c.n_train)
   OR (s.split = 'val' AND d.t >= c.n_train - {SEQ_LEN} AND d.t < c.n - c.n_test)
   OR (s.split = 'test' AND d.t >= c.n - c.n_test - {SEQ_LEN})
""")
def q_split_chrono(spark, sf):
    d = indexed_daily(spark, sf)
    return wo.split_chrono(d, "series_id", "t", SEQ_LEN).select("date", "t", "split")


@query("split_tail", f"""
WITH panel AS ({S.PANEL}),
g AS (SELECT ticker, date, row_number() OVER (ORDER BY ticker, date) AS pos, count(*) OVER () AS n FROM panel)
SELECT ticker, date, CASE WHEN pos > n - ceil(n * {dbl(0.15)}) THEN 'test' ELSE 'train' END AS split FROM g
""")
def q_split_tail(spark, sf):
    p = materialize(tb.ticker_panel(spark, sf))
    return wo.split_tail(p, ["ticker", "date"], 0.15).select("ticker", "date", "split")


@query("val_tail_20", f"""
WITH h AS ({S.HOURLY}), g AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n FROM h)
SELECT ts, t >= CAST(floor(n * {dbl(0.8)}) AS BIGINT) AS in_val FROM g
""")
def q_val_tail(spark, sf):
    # one series: no key (a constant key would fold into a cartesian join)
    h = series_index(tb.hourly_matrix(spark, sf), None, "ts")
    return wo.head_fraction(h, None, "t", 0.8, "in_train").select("ts", (~F.col("in_train")).alias("in_val"))


@query("split_80_docs", f"""
WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS t, count(*) OVER () AS n FROM documents)
SELECT doc_id, t < CAST(floor(n * {dbl(0.8)}) AS BIGINT) AS in_train FROM g
""")
def q_split_80(spark, sf):
    d = series_index(tb.read(spark, sf, "documents").select("doc_id"), None, "doc_id")
    return wo.head_fraction(d, None, "t", 0.8, "in_train").select("doc_id", "in_train")


@query("last_window", f"""
WITH {EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1)
SELECT ev.series_id, CAST(ev.t - (c.n - {LAST_WINDOW}) AS INTEGER) AS pos, {r('ev.value')} AS value, 1 AS mask
FROM ev JOIN c USING (series_id) WHERE ev.t >= c.n - {LAST_WINDOW}
UNION ALL
SELECT c.series_id, CAST(k.k AS INTEGER) AS pos, CAST(0.0 AS DOUBLE) AS value, 0 AS mask
FROM c CROSS JOIN range(0, {LAST_WINDOW}) k(k) WHERE k.k < {LAST_WINDOW} - c.n
""")
def q_last_window(spark, sf):
    e = indexed_events(spark, sf)
    lw = wo.last_window(e, "series_id", "t", LAST_WINDOW).select("series_id", "pos", "value", F.lit(1).alias("mask"))
    n = e.groupBy("series_id").count().filter(F.col("count") < LAST_WINDOW)
    pads = n.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(LAST_WINDOW - 1) - F.col("count").cast("int"))).alias("pos"))
    pads = pads.select("series_id", "pos", F.lit(0.0).alias("value"), F.lit(0).alias("mask"))
    return rounded(lw.unionByName(pads))


def _ma_sql(kernels, seasonal: bool):
    ks = [k + 1 if k % 2 == 0 else k for k in kernels]
    parts = []
    for k in ks:
        h = (k - 1) // 2
        parts.append(f"""(sum(OT) OVER (ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)
           + ({h} - count(*) OVER (ORDER BY t ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)) * first_value(OT) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
           + ({h} - count(*) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) * last_value(OT) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
          ) / {float(k)}""")
    tr = "(" + " + ".join(parts) + f") / {float(len(parts))}"
    cols = f"{r('trend')} AS trend" + (f", {r('OT - trend')} AS seasonal" if seasonal else "")
    return f"WITH {DAILY_SQL}, m AS (SELECT date, OT, {tr} AS trend FROM d) SELECT date, {cols} FROM m"


@query("moving_average", _ma_sql([MA_KERNEL], False))
def q_moving_average(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(wo.moving_average(d, "series_id", "t", "OT", MA_KERNEL).select("date", "trend"))


@query("series_decomp", _ma_sql([MA_KERNEL], True))
def q_series_decomp(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(wo.decompose(d, "series_id", "t", "OT", [MA_KERNEL]).select("date", "trend", "seasonal"))


@query("series_decomp_multi", _ma_sql(list(MULTI_KERNELS), True))
def q_series_decomp_multi(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(wo.decompose(d, "series_id", "t", "OT", list(MULTI_KERNELS)).select("date", "trend", "seasonal"))


# anomaly truth = error event; detection = value above a fixed cut
POINT_CUT = 450.0


@query("point_adjust", f"""
WITH {EVENTS_SQL},
x AS (SELECT *, label AS gt, CAST(value > {POINT_CUT} AS INTEGER) AS pred,
       CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY series_id ORDER BY t), 0) = 0 THEN t END AS st FROM ev),
y AS (SELECT *, CASE WHEN gt = 1 THEN max(st) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS seg FROM x),
z AS (SELECT *, max(pred) OVER (PARTITION BY series_id, seg) AS hit FROM y)
SELECT series_id, event_id, gt, pred, CASE WHEN seg IS NOT NULL AND hit = 1 THEN 1 ELSE pred END AS pred_adj FROM z
""")
def q_point_adjust(spark, sf):
    e = indexed_events(spark, sf).withColumn("gt", F.col("label")) \
        .withColumn("pred", (F.col("value") > POINT_CUT).cast("int"))
    return wo.point_adjust(e, "series_id", "t").select("series_id", "event_id", "gt", "pred", "pred_adj")


@query("exp_smoothing", f"""
WITH RECURSIVE {DAILY_SQL},
s(t, lvl) AS (
  SELECT t, OT FROM d WHERE t = 0
  UNION ALL
  SELECT d.t, {dbl(SMOOTH_ALPHA)} * s.lvl + {dbl(1 - SMOOTH_ALPHA)} * d.OT FROM s JOIN d ON d.t = s.t + 1)
SELECT d.date, {r('s.lvl')} AS level FROM d JOIN s USING (t)
""")
def q_exp_smoothing(spark, sf):
    d = indexed_daily(spark, sf)
    # s_{-1} = x_0 gives s_0 = x_0
    return rounded(wo.smoothing(d, "series_id", "t", "OT", SMOOTH_ALPHA, init=None).select("date", "level"))


@query("damped_trend", f"""
WITH {PANEL_SQL},
g AS (SELECT ticker, avg(lr) AS growth FROM (
        SELECT ticker, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY t)) AS lr FROM p) GROUP BY 1)
SELECT ticker, CAST(h.h AS INTEGER) AS h,
       {r(f'growth * ({dbl(DAMP_PHI)} * (1.0 - pow({dbl(DAMP_PHI)}, h.h)) / {dbl(1 - DAMP_PHI)})', 9)} AS damped
FROM g CROSS JOIN range(1, {DAMP_H + 1}) h(h)
""")
def q_damped(spark, sf):
    p = indexed_panel(spark, sf)
    lr = fe.with_features(p, "ticker", "t", lambda w: [fe.log_return("close", w).alias("lr")], back=1)
    g = lr.groupBy("ticker").agg(F.avg("lr").alias("growth"))
    return rounded(wo.damped_trend(g, "growth", DAMP_PHI, DAMP_H).select("ticker", "h", "damped"), 9)


# -------------------------------------------------- per-window normalisation
def _daily_windows(spark, sf):
    d = indexed_daily(spark, sf)
    return wo.sliding_windows(d, "series_id", "t", SEQ_LEN, LABEL_LEN, PRED_LEN)


WIN_SQL = f"""{DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
w AS (SELECT d.t - k.k AS window_id, CAST(k.k AS INTEGER) AS step, d.OT AS value
      FROM d CROSS JOIN c CROSS JOIN range(0, {SEQ_LEN + PRED_LEN}) k(k)
      WHERE d.t - k.k >= 0 AND d.t - k.k <= c.n - {SEQ_LEN + PRED_LEN}),
st AS (SELECT window_id, avg(value) AS w_mean, var_pop(value) AS w_var, arg_max(value, step) AS w_last
       FROM w WHERE step < {SEQ_LEN} GROUP BY 1)"""


@query("rev_norm", f"""
WITH {WIN_SQL}
SELECT w.window_id, w.step, {r('(w.value - st.w_mean) / sqrt(st.w_var + 1e-5)')} AS x_norm
FROM w JOIN st USING (window_id)
""")
def q_rev_norm(spark, sf):
    w = _daily_windows(spark, sf).withColumnRenamed("OT", "value")
    return rounded(wo.rev_norm(w, "series_id", "value").select("window_id", "step", "x_norm"))


@query("rev_denorm", f"""
WITH {WIN_SQL}
SELECT w.window_id, w.step,
       {r('((st.w_last - st.w_mean) / sqrt(st.w_var + 1e-5)) * sqrt(st.w_var + 1e-5) + st.w_mean')} AS y_pred
FROM w JOIN st USING (window_id) WHERE w.step >= {SEQ_LEN}
""")
def q_rev_denorm(spark, sf):
    """Persistence forecast made in normalised space, mapped back."""
    w = _daily_windows(spark, sf).withColumnRenamed("OT", "value")
    n = wo.rev_norm(w, "series_id", "value")
    n = n.withColumn("x_norm", (F.col("w_last") - F.col("w_mean")) / F.sqrt(F.col("w_var") + F.lit(wo.REVIN_EPS)))
    out = wo.rev_denorm(n.filter(F.col("step") >= SEQ_LEN), "x_norm", out="y_pred")
    return rounded(out.select("window_id", "step", "y_pred"))


@query("subtract_last", f"""
WITH {WIN_SQL}
SELECT w.window_id, w.step, {r('w.value - st.w_last')} AS x_sub FROM w JOIN st USING (window_id)
""")
def q_subtract_last(spark, sf):
    w = _daily_windows(spark, sf).withColumnRenamed("OT", "value")
    st = wo.window_stats(w, "series_id", "value")
    return rounded(w.join(st, ["series_id", "window_id"])
                   .select("window_id", "step", (F.col("value") - F.col("w_last")).alias("x_sub")))


@query("lookback_profile", f"""
WITH {DAILY_SQL},
g AS (SELECT date, OT,
        avg(OT) OVER (ORDER BY t ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS lb_mean,
        stddev_pop(OT) OVER (ORDER BY t ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS lb_std,
        count(*) OVER (ORDER BY t ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS c FROM d)
SELECT date, {r('lb_mean', 9)} AS lb_mean, {r('lb_std', 4)} AS lb_std, {r('OT')} AS lb_last FROM g WHERE c = {SEQ_LEN}
""")
def q_lookback_profile(spark, sf):
    d = indexed_daily(spark, sf)
    # the mean of 5-decimal values over 24 rows is exact at 9 decimals
    return rounded(wo.lookback_profile(d, "series_id", "t", "OT", SEQ_LEN).select("date", "lb_mean", "lb_std", "lb_last"),
                   lb_mean=9, lb_std=4)


# --------------------------------------------------------- vector windows
EMB_SQL = f"s AS ({S.SEQUENCES})"


@query("embedding_norm", f"""
WITH {EMB_SQL}, st AS (SELECT sample_id, avg(value) AS m, var_pop(value) AS v FROM s GROUP BY 1)
SELECT s.sample_id, s.t AS dim, {r('(s.value - st.m) / sqrt(st.v + 1e-5)')} AS z FROM s JOIN st USING (sample_id)
""")
def q_embedding_norm(spark, sf):
    s = tb.sequences(spark, sf)
    w = Window.partitionBy("sample_id")
    # one sample = one bounded vector (64 values): a per-sample window is fine
    z = (F.col("value") - F.avg("value").over(w)) / F.sqrt(F.var_pop("value").over(w) + F.lit(wo.REVIN_EPS))
    return rounded(s.select("sample_id", F.col("t").alias("dim"), z.alias("z")))


@query("rank_within_group", f"""
WITH {EMB_SQL}, c AS (SELECT label, t, avg(value) AS cv FROM s GROUP BY 1, 2),
d AS (SELECT s.sample_id, s.label, sqrt(sum((s.value - c.cv) * (s.value - c.cv))) AS dist
      FROM s JOIN c USING (label, t) GROUP BY 1, 2)
SELECT sample_id, label, {r('dist')} AS dist,
       CAST(row_number() OVER (PARTITION BY label ORDER BY dist, sample_id) AS INTEGER) AS rnk FROM d
""")
def q_rank_within_group(spark, sf):
    s = tb.sequences(spark, sf)
    cen = s.groupBy("label", "t").agg(F.avg("value").alias("cv"))
    d = s.join(cen, ["label", "t"]).groupBy("sample_id", "label").agg(
        F.sqrt(F.sum((F.col("value") - F.col("cv")) ** 2)).alias("dist"))
    # rank inside a class without sorting a whole class in one task: the
    # distributed index buckets the sort key (a class may be huge)
    d = series_index(d, "label", ["dist", "sample_id"], out="_r", bucket=F.floor(F.col("dist") * F.lit(64.0)))
    return rounded(d.select("sample_id", "label", "dist", (F.col("_r") + 1).cast("int").alias("rnk")))
