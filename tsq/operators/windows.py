"""Window-shaped operators: supervised windows, splits, centred moving
averages and decompositions, smoothing, segment adjustment, per-window
normalisation.

Windows over a series are produced in *long form* (one row per
(window, step)) by exploding each row into the windows that contain it:
no row ever waits for its neighbours in one task, and the output has exactly
the size of the windowed data set.  Per-series counts (needed for the last
valid window) come from a small ``groupBy`` table joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.operators.index import _keys, block_window, core_rows, fill_forward, halo, series_index
from tsq.operators.recurrence import Smooth, smoothed


def with_count(df: DataFrame, keys, out: str = "_n") -> DataFrame:
    keys = _keys(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(n, keys) if keys else df.crossJoin(F.broadcast(n))


def sliding_windows(df: DataFrame, keys, t: str, seq_len: int, label_len: int, pred_len: int) -> DataFrame:
    """Stride-1 supervised windows, long form.

    Window ``s`` covers rows s .. s+seq_len+pred_len-1 of its series;
    ``step`` < seq_len is the look-back (encoder input x), ``step`` >=
    seq_len-label_len is the decoder target y.  There are
    n - seq_len - pred_len + 1 windows per series.
    """
    total = seq_len + pred_len
    d = with_count(df, keys)
    tc = F.col(t).cast("long")
    lo = F.greatest(tc - F.lit(total - 1), F.lit(0).cast("long"))
    hi = F.least(tc, F.col("_n") - F.lit(total))
    d = d.withColumn("window_id", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    d = d.withColumn("step", (tc - F.col("window_id")).cast("int"))
    return d.withColumn("in_x", F.col("step") < seq_len) \
        .withColumn("in_y", F.col("step") >= seq_len - label_len).drop("_n")


def strided_windows(df: DataFrame, keys, t: str, win: int, stride: int) -> DataFrame:
    """Windows of ``win`` rows starting every ``stride`` rows (count
    (n-win)//stride+1); long form with ``window_id`` = start // stride."""
    d = with_count(df, keys)
    tc = F.col(t).cast("long")
    first = F.ceil(F.greatest(tc - F.lit(win - 1), F.lit(0)) / F.lit(stride)).cast("long") * F.lit(stride)
    last = F.least(tc, F.col("_n") - F.lit(win))
    d = d.withColumn("_s", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long")))))
    return d.withColumn("window_id", (F.col("_s") / F.lit(stride)).cast("long")) \
        .withColumn("step", (tc - F.col("_s")).cast("int")).drop("_s", "_n")


def tumbling_windows(df: DataFrame, keys, t: str, win: int) -> DataFrame:
    """Non-overlapping windows of ``win`` rows; a partial tail is dropped."""
    d = with_count(df, keys)
    tc = F.col(t).cast("long")
    d = d.filter(tc < F.floor(F.col("_n") / F.lit(win)) * F.lit(win))
    return d.withColumn("window_id", F.floor(tc / F.lit(win)).cast("long")) \
        .withColumn("step", (tc % F.lit(win)).cast("int")).drop("_n")


# Fixed values of the reference's chronological split
TRAIN_FRAC, TEST_FRAC = 0.7, 0.2


def split_chrono(df: DataFrame, keys, t: str, seq_len: int) -> DataFrame:
    """70/10/20 split per series with the look-back overlap: val and test
    start ``seq_len`` rows early, so rows can be in two splits (one output
    row per (row, split))."""
    d = with_count(df, keys)
    n = F.col("_n")
    n_train = F.floor(n * F.lit(TRAIN_FRAC)).cast("long")
    n_test = F.floor(n * F.lit(TEST_FRAC)).cast("long")
    n_val = n - n_train - n_test
    tc = F.col(t)
    b1 = [F.lit(0), n_train - F.lit(seq_len), n - n_test - F.lit(seq_len)]
    b2 = [n_train, n_train + n_val, n]
    names = ["train", "val", "test"]
    arr = F.array(*[F.when((tc >= b1[i]) & (tc < b2[i]), F.lit(names[i])) for i in range(3)])
    return d.withColumn("split", F.explode(F.filter(arr, lambda s: s.isNotNull()))).drop("_n")


def split_tail(df: DataFrame, order: Sequence[str], frac: float = 0.15, bucket: Column | None = None) -> DataFrame:
    """Ordered split of the whole table: the last ceil(frac*n) rows in
    ``order`` are test.  Global positions come from :func:`series_index`
    with no series key (per-bucket counts + prefix offsets)."""
    order = list(order)
    b = bucket if bucket is not None else F.struct(*[F.col(c) for c in order[:-1]],
                                                   F.date_trunc("month", F.col(order[-1])))
    d = series_index(df, None, order, out="_pos", bucket=b)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = d.crossJoin(F.broadcast(n))
    n_test = F.ceil(F.col("_n") * F.lit(frac))
    return d.withColumn("split", F.when(F.col("_pos") >= F.col("_n") - n_test, "test").otherwise("train")) \
        .drop("_pos", "_n")


def head_fraction(df: DataFrame, keys, t: str, frac: float, out: str = "in_head") -> DataFrame:
    """Flag the first int(frac*n) rows of each series (e.g. the first 80 %
    of texts used to train a text model; validation = rows from int(.8n))."""
    d = with_count(df, keys)
    return d.withColumn(out, F.col(t) < F.floor(F.col("_n") * F.lit(frac))).drop("_n")


def last_window(df: DataFrame, keys, t: str, length: int) -> DataFrame:
    """Last ``length`` points of each series, left-padded with zeros: long
    form ``pos`` 0..length-1, ``value`` and ``mask`` (1 = observed)."""
    keys = _keys(keys)
    d = with_count(df, keys)
    d = d.filter(F.col(t) >= F.col("_n") - F.lit(length))
    d = d.withColumn("pos", (F.col(t) - (F.col("_n") - F.lit(length))).cast("int"))
    return d.drop("_n")


def moving_average(df: DataFrame, keys, t: str, x: str, kernel: int, out: str = "trend",
                   block: int = 8192) -> DataFrame:
    """Centred moving average with edge replication (odd ``kernel``): the
    series is padded with (kernel-1)/2 copies of its first and last value."""
    return decompose(df, keys, t, x, [kernel], trend=out, seasonal=None, block=block)


def _odd(k: int) -> int:
    return k + 1 if k % 2 == 0 else k


def decompose(df: DataFrame, keys, t: str, x: str, kernels: Sequence[int], trend: str = "trend",
              seasonal: str | None = "seasonal", block: int = 8192) -> DataFrame:
    """trend = mean of the centred moving averages (even kernels bumped to
    odd), seasonal = x - trend.  One halo pass; edge replication via the
    partition's first/last value and the number of missing neighbours."""
    ks = [_odd(k) for k in kernels]
    hmax = max((k - 1) // 2 for k in ks)
    h = halo(df, t, back=hmax, ahead=hmax, block=max(block, 2 * hmax))
    w = block_window(keys, t)
    xc = F.col(x)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_v = F.first(xc).over(full)
    last_v = F.last(xc).over(full)
    mas = []
    for k in ks:
        hk = (k - 1) // 2
        s = F.sum(xc).over(w.rowsBetween(-hk, hk))
        before = F.count(F.lit(1)).over(w.rowsBetween(-hk, -1)) if hk else F.lit(0)
        after = F.count(F.lit(1)).over(w.rowsBetween(1, hk)) if hk else F.lit(0)
        mas.append((s + (F.lit(hk) - before) * first_v + (F.lit(hk) - after) * last_v) / F.lit(float(k)))
    tr = mas[0]
    for m in mas[1:]:
        tr = tr + m
    tr = tr / F.lit(float(len(mas)))
    out = h.withColumn(trend, tr)
    if seasonal:
        out = out.withColumn(seasonal, xc - F.col(trend))
    return core_rows(out)


def smoothing(df: DataFrame, keys, t: str, x: str, alpha: float, init: str | float | None = None,
              out: str = "level") -> DataFrame:
    """Exponential smoothing s_t = alpha*s_{t-1} + (1-alpha)*x_t with
    s_{-1} = ``init`` (a column, a constant, or None for s_0 = x_0), i.e.
    s_t = alpha^(t+1) v0 + sum_i (1-alpha) alpha^(t-i) x_i.

    Exact for any length and alpha (:mod:`tsq.operators.recurrence`); a null
    x keeps the level and makes the next value weigh more, as there.
    """
    start = None if init is None else "_init"
    d = df if init is None else df.withColumn("_init", F.col(init) if isinstance(init, str) else F.lit(float(init)))
    return smoothed(d, keys, t, [Smooth(x, 1.0 - alpha, out, start)]).drop("_init")


def point_adjust(df: DataFrame, keys, t: str, gt: str = "gt", pred: str = "pred", out: str = "pred_adj") -> DataFrame:
    """Detection inside a true anomaly segment marks the whole segment.

    Segments (gaps and islands of gt=1) get the position of their first row
    as id, carried forward with the exact block-carry fill; the segment's
    max(pred) is a grouped aggregate joined to the rows of segments alone
    (the other rows have no segment and would all meet under a null key).
    """
    keys = _keys(keys)
    # start-of-segment flag via a halo of one row (no whole-series window)
    h = halo(df, t, back=1, block=65536)
    w = block_window(keys, t)
    h = h.withColumn("_start", F.when((F.col(gt) == 1) & (F.coalesce(F.lag(gt, 1).over(w), F.lit(0)) == 0), F.col(t)))
    d = core_rows(h)
    inside = fill_forward(d, keys, t, ["_start"]).filter(F.col(gt) == 1).withColumnRenamed("_start", "_seg")
    seg = inside.groupBy(*keys, "_seg").agg(F.max(pred).alias("_hit"))
    inside = inside.join(seg, [*keys, "_seg"]).withColumn(out, F.when(F.col("_hit") == 1, F.lit(1)).otherwise(F.col(pred)))
    outside = d.filter(F.coalesce(F.col(gt) != 1, F.lit(True))).withColumn(out, F.col(pred))
    cols = [*df.columns, out]
    return inside.select(*cols).unionByName(outside.select(*cols))


def lookback_profile(df: DataFrame, keys, t: str, x: str, length: int) -> DataFrame:
    """Per origin row: mean, population std and last value of the
    ``length`` rows ending at it (the statistics every per-window
    normaliser uses); rows without a full look-back are dropped."""
    h = halo(df, t, back=length - 1, block=max(8192, length))
    w = block_window(keys, t)
    fr = w.rowsBetween(-(length - 1), 0)
    xc = F.col(x)
    out = h.select("*", F.avg(xc).over(fr).alias("lb_mean"), F.stddev_pop(xc).over(fr).alias("lb_std"),
                   F.count(F.lit(1)).over(fr).alias("_c"))
    out = core_rows(out).filter(F.col("_c") == length).drop("_c")
    return out.withColumn("lb_last", xc)


def window_stats(windows: DataFrame, keys, value: str, part: str = "in_x") -> DataFrame:
    """Per-window mean, population variance and last look-back value."""
    keys = _keys(keys)
    return windows.filter(F.col(part)).groupBy(*keys, "window_id").agg(
        F.avg(value).alias("w_mean"), F.var_pop(value).alias("w_var"),
        F.max_by(value, "step").alias("w_last"))


REVIN_EPS = 1e-5


def rev_norm(windows: DataFrame, keys, value: str, subtract_last: bool = False, out: str = "x_norm") -> DataFrame:
    """(x - mean, or x - last) / sqrt(var_pop + 1e-5) per window (look-back)."""
    keys = _keys(keys)
    st = window_stats(windows, keys, value)
    d = windows.join(st, [*keys, "window_id"])
    centre = F.col("w_last") if subtract_last else F.col("w_mean")
    return d.withColumn(out, (F.col(value) - centre) / F.sqrt(F.col("w_var") + F.lit(REVIN_EPS)))


def rev_denorm(df: DataFrame, norm_col: str, subtract_last: bool = False, out: str = "x_denorm") -> DataFrame:
    centre = F.col("w_last") if subtract_last else F.col("w_mean")
    return df.withColumn(out, F.col(norm_col) * F.sqrt(F.col("w_var") + F.lit(REVIN_EPS)) + centre)


def masked_norm(windows: DataFrame, keys, value: str, mask: str, out: str = "x_norm") -> DataFrame:
    """Normalise with statistics of observed cells only (mask = 1):
    mean = sum(x*m)/sum(m), std = sqrt(sum(((x-mean)*m)^2)/sum(m) + 1e-5);
    masked cells become 0."""
    keys = _keys(keys)
    m = F.col(mask).cast("double")
    st = windows.groupBy(*keys, "window_id").agg(
        F.try_divide(F.sum(F.col(value) * m), F.sum(m)).alias("m_mean"))
    d = windows.join(st, [*keys, "window_id"])
    d = d.withColumn("_c", F.when(F.col(mask) == 1, F.col(value) - F.col("m_mean")).otherwise(F.lit(0.0)))
    sd = d.groupBy(*keys, "window_id").agg(
        F.sqrt(F.try_divide(F.sum(F.col("_c") * F.col("_c")), F.sum(F.col(mask).cast("double"))) + F.lit(REVIN_EPS)).alias("m_std"))
    d = d.join(sd, [*keys, "window_id"])
    return d.withColumn(out, F.col("_c") / F.col("m_std")).drop("_c")


def damped_trend(df: DataFrame, growth: str, phi: float, horizon: int) -> DataFrame:
    """growth * sum_{j=1..h} phi^j for h = 1..horizon (closed form)."""
    d = df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    if phi == 1.0:
        factor = F.col("h").cast("double")
    else:
        factor = F.lit(phi) * (F.lit(1.0) - F.pow(F.lit(phi), F.col("h"))) / F.lit(1.0 - phi)
    return d.withColumn("damped", F.col(growth) * factor)
