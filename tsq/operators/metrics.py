"""Evaluation metrics, losses, scalers and score thresholds as grouped
aggregates.

Every metric is an aggregate expression list for ``groupBy(...).agg(...)``
(partial + final aggregation, so a hot group never moves more than one
partial row per task).  Divisions that can hit zero use ``try_divide``
(NULL, ignored by ``avg``) or the explicit zero rules of the losses.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.operators.index import _keys, series_index
from tsq.session import materialize

# numpy float64 machine epsilon (the normalisers add it to denominators)
FLOAT_EPS = 2.220446049250313e-16


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def err(y, p) -> Column:
    return _c(p) - _c(y)


def mae(y, p) -> Column:
    return F.avg(F.abs(err(y, p)))


def mse(y, p) -> Column:
    return F.avg(err(y, p) * err(y, p))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mape(y, p) -> Column:
    """mean |(p-y)/y|; a zero truth gives NULL (skipped), not Inf."""
    return F.avg(F.abs(F.try_divide(err(y, p), _c(y))))


def mspe(y, p) -> Column:
    q = F.try_divide(err(y, p), _c(y))
    return F.avg(q * q)


def metric_bundle(y, p) -> list[Column]:
    return [mae(y, p).alias("mae"), mse(y, p).alias("mse"), rmse(y, p).alias("rmse"),
            mape(y, p).alias("mape"), mspe(y, p).alias("mspe")]


def rse(y, p) -> Column:
    """sqrt(sum e^2) / sqrt(sum (y - mean y)^2), one pass."""
    e = err(y, p)
    return F.sqrt(F.sum(e * e)) / F.sqrt(F.var_pop(_c(y)) * F.count(_c(y)))


def corr_ref(df: DataFrame, keys, y: str, p: str, out: str = "corr") -> DataFrame:
    """The reference's CORR: sum((y-my)(p-mp)) / sqrt(sum((y-my)^2 (p-mp)^2)).

    Two passes: group means (small table) joined back, then sums."""
    keys = _keys(keys)
    m = df.groupBy(*keys).agg(F.avg(y).alias("_my"), F.avg(p).alias("_mp"))
    d = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    a = F.col(y) - F.col("_my")
    b = F.col(p) - F.col("_mp")
    return d.groupBy(*keys).agg((F.sum(a * b) / F.sqrt(F.sum(a * a * b * b))).alias(out),
                                F.corr(y, p).alias("pearson"))


def divide_no_nan(a, b) -> Column:
    """a/b with NaN and +Inf results replaced by 0 (-Inf kept)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    # IEEE: a/0 is +Inf (a>0, -> 0), NaN (a=0, -> 0) or -Inf (a<0, kept);
    # Spark's ANSI division raises on 0, so the zero divisor is a branch
    return F.when(b == 0, F.when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))).otherwise(a / b)


def mape_loss(y, p, mask) -> Column:
    w = divide_no_nan(_c(mask).cast("double"), _c(y))
    return F.avg(F.abs((_c(p) - _c(y)) * w))


def smape_loss(y, p, mask) -> Column:
    return F.lit(200.0) * F.avg(divide_no_nan(F.abs(_c(p) - _c(y)), F.abs(_c(p)) + F.abs(_c(y))) * _c(mask).cast("double"))


def mase_loss(y, p, mask, masep) -> Column:
    """mean |y - p| * mask / masep (masep = in-sample seasonal-naive MAE)."""
    return F.avg(F.abs(_c(y) - _c(p)) * divide_no_nan(_c(mask).cast("double"), _c(masep)))


def m4_smape(y, f) -> Column:
    den = F.abs(_c(y)) + F.abs(_c(f))
    return F.lit(200.0) * F.abs(_c(f) - _c(y)) / F.when(den == 0, F.lit(1.0)).otherwise(den)


def m4_mape(y, f) -> Column:
    den = F.abs(_c(y))
    return F.lit(100.0) * F.abs(_c(f) - _c(y)) / F.when(den == 0, F.lit(1.0)).otherwise(den)


# Fixed M4 regrouping: three single groups, the rest pooled as "Others"
M4_SINGLE = ["Yearly", "Quarterly", "Monthly"]
M4_OTHERS = ["Weekly", "Daily", "Hourly"]


def m4_summarize(scores: DataFrame, counts: DataFrame, metric_cols: Sequence[str]) -> DataFrame:
    """Re-group per-group scores: Yearly/Quarterly/Monthly as is, Others =
    count-weighted mean of Weekly/Daily/Hourly, Average = count-weighted
    mean of all groups.  ``scores``: (grp, metric...), ``counts``: (grp, n)."""
    s = scores.join(counts, "grp")
    sg = F.when(F.col("grp").isin(M4_SINGLE), F.col("grp")).otherwise(F.lit("Others"))
    parts = s.groupBy(sg.alias("summary")).agg(
        *[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in metric_cols])
    avg = s.agg(*[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in metric_cols]) \
        .withColumn("summary", F.lit("Average"))
    return parts.unionByName(avg)


def direction_accuracy(y, p) -> Column:
    return F.avg((F.signum(_c(y)) == F.signum(_c(p))).cast("double"))


def accuracy(y, p) -> Column:
    return F.avg((_c(y) == _c(p)).cast("double"))


def prf_binary(y, p) -> list[Column]:
    """precision, recall, F1 of the positive class (0 when undefined)."""
    tp = F.sum(((_c(y) == 1) & (_c(p) == 1)).cast("double"))
    fp = F.sum(((_c(y) == 0) & (_c(p) == 1)).cast("double"))
    fn = F.sum(((_c(y) == 1) & (_c(p) == 0)).cast("double"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0))
    return [prec.alias("precision"), rec.alias("recall"), f1.alias("f1")]


def fit_standard(df: DataFrame, cols: Sequence[str], keys=None) -> DataFrame:
    """mean and population std per column (std 0 -> 1), one row per key."""
    keys = _keys(keys)
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def apply_standard(df: DataFrame, stats: DataFrame, cols: Sequence[str], keys=None, inverse: bool = False) -> DataFrame:
    """(x - mean)/std with fitted stats (broadcast when it is one row)."""
    keys = _keys(keys)
    d = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    for c in cols:
        m, s = F.col(f"{c}_mean"), F.col(f"{c}_std")
        d = d.withColumn(c, F.col(c) * s + m if inverse else (F.col(c) - m) / s)
    return d.drop(*[f"{c}_{k}" for c in cols for k in ("mean", "std")])


def exact_percentile(df: DataFrame, col: str, q: float, buckets: int = 65536) -> DataFrame:
    """Exact linear-interpolation percentile (numpy default) without
    collecting or sorting the values.

    Rows are counted per value bucket (a table of at most ``buckets`` rows);
    a prefix sum over that small table finds the one or two buckets holding
    ranks floor(q(n-1)) and ceil(q(n-1)); only their rows are kept (the
    bucket list has at most two rows, so it is broadcast) and counted per
    distinct value -- runs of equal values collapse in the partial
    aggregate instead of being ranked row by row.  One-row result
    ``percentile``."""
    # written once, narrow: the passes below read it again
    v = materialize(df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull()), "percentile-of")
    # approximate quantiles bracket the rank, so that outliers don't stretch
    # the buckets; a few numbers of each pass reach the driver
    near = F.percentile_approx("_v", F.array(F.lit(max(q - 2e-4, 0.0)), F.lit(min(q + 2e-4, 1.0))), F.lit(10000))
    ends = v.agg(near.alias("e"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return df.sparkSession.createDataFrame([(None,)], "percentile double")
    pos = q * (ends["n"] - 1)
    lo_i, hi_i = math.floor(pos), math.ceil(pos)
    held = v.agg(F.sum((F.col("_v") < F.lit(ends["e"][0])).cast("long")).alias("below"),
                 F.sum((F.col("_v") <= F.lit(ends["e"][1])).cast("long")).alias("upto")).first()
    inside = held["below"] <= lo_i and hi_i < held["upto"]  # else the whole range
    lo, hi, before = (*ends["e"], held["below"]) if inside else (ends["lo"], ends["hi"], 0)
    width = (F.lit(hi) - F.lit(lo)) / F.lit(float(buckets))
    b = F.when(width > 0, F.least(F.floor((F.col("_v") - F.lit(lo)) / width), F.lit(buckets - 1))).otherwise(F.lit(0))
    vb = v.filter((F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi))).withColumn("_b", b.cast("long"))
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    bc = vb.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.lit(before) + F.coalesce(F.sum("_c").over(wb), F.lit(0)))
    holds = lambda start, size, i: (start <= F.lit(i)) & (F.lit(i) < start + size)
    need = bc.filter(holds(F.col("_start"), F.col("_c"), lo_i) | holds(F.col("_start"), F.col("_c"), hi_i)).collect()  # two rows at most
    start = F.coalesce(*[F.when(F.col("_b") == r["_b"], F.lit(r["_start"])) for r in need])
    vc = vb.filter(F.col("_b").isin([r["_b"] for r in need])).groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_k"))
    wv = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    vc = vc.withColumn("_first", start + F.coalesce(F.sum("_k").over(wv), F.lit(0)))
    at = lambda i: F.max(F.when(holds(F.col("_first"), F.col("_k"), i), F.col("_v")))
    return vc.agg((at(lo_i) + F.lit(pos - lo_i) * (at(hi_i) - at(lo_i))).alias("percentile"))


def softmax_argmax(scores: DataFrame, keys, cls: str, score: str) -> DataFrame:
    """Per key: class with the highest score (ties: smallest class) and its
    softmax probability exp(s-max)/sum exp(s-max)."""
    keys = _keys(keys)
    g = scores.groupBy(*keys).agg(F.max(score).alias("_mx"))
    d = scores.join(g, keys).withColumn("_e", F.exp(F.col(score) - F.col("_mx")))
    return d.groupBy(*keys).agg(
        F.min(F.when(F.col(score) == F.col("_mx"), F.col(cls))).alias("pred_class"),
        (F.lit(1.0) / F.sum("_e")).alias("prob"))
