"""Queries: metrics, losses, M4 summary, scalers, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsq.functions import rng
from tsq.operators import features as fe
from tsq.operators import metrics as me
from tsq.operators import windows as wo
from tsq.operators.index import series_index
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rounded
from tsq.plans.windows import DAILY_SQL, EVENTS_SQL, PANEL_SQL, indexed_daily, indexed_events, indexed_panel
from tsq.session import materialize
from tsq.sources import tables as tb

MASK_SEED = 7
MASK_RATE = 0.1
MASE_FREQ = 5


# ------------------------------------------------------- forecast fixture
def forecasts(spark, sf):
    """Persistence forecast of the daily close (in thousands) per ticker,
    with a hash mask (1 = kept, 0 = held out, 10 %)."""
    p = indexed_panel(spark, sf)
    f = fe.with_features(p, "ticker", "t", lambda w: [(F.lag("close", 1).over(w) / F.lit(1000.0)).alias("y_pred")], back=1)
    f = f.withColumn("y_true", F.col("close") / F.lit(1000.0)).filter(F.col("y_pred").isNotNull())
    m = (rng.uniform("ticker", "t", F.lit("mask"), F.lit(MASK_SEED)) >= F.lit(MASK_RATE)).cast("int")
    return f.select("ticker", "date", "t", "y_true", "y_pred", m.alias("mask"))


F_SQL = f"""{PANEL_SQL},
fc AS (SELECT ticker, date, t, close / 1000.0 AS y_true,
              lag(close) OVER (PARTITION BY ticker ORDER BY t) / 1000.0 AS y_pred FROM p),
f AS (SELECT *, CAST({rng.sql_uniform('ticker', 't', "'mask'", str(MASK_SEED))} >= {dbl(MASK_RATE)} AS INTEGER) AS mask
      FROM fc WHERE y_pred IS NOT NULL)"""


def _per_ticker(name, sql_exprs: dict, spark_exprs):
    sel = ", ".join(f"{r(e)} AS {k}" for k, e in sql_exprs.items())
    sql = f"WITH {F_SQL} SELECT ticker, {sel} FROM f GROUP BY ticker"

    def fn(spark, sf):
        return rounded(forecasts(spark, sf).groupBy("ticker").agg(*spark_exprs()))
    query(name, sql)(fn)


E = "(y_pred - y_true)"
_per_ticker("metric_mae", {"mae": f"avg(abs{E})"}, lambda: [me.mae("y_true", "y_pred").alias("mae")])
_per_ticker("metric_mse", {"mse": f"avg({E} * {E})"}, lambda: [me.mse("y_true", "y_pred").alias("mse")])
_per_ticker("metric_rmse", {"rmse": f"sqrt(avg({E} * {E}))"}, lambda: [me.rmse("y_true", "y_pred").alias("rmse")])
_per_ticker("metric_mape", {"mape": f"avg(abs({E} / y_true))"}, lambda: [me.mape("y_true", "y_pred").alias("mape")])
_per_ticker("metric_mspe", {"mspe": f"avg(({E} / y_true) * ({E} / y_true))"}, lambda: [me.mspe("y_true", "y_pred").alias("mspe")])
_per_ticker("metric_bundle", {"mae": f"avg(abs{E})", "mse": f"avg({E} * {E})", "rmse": f"sqrt(avg({E} * {E}))",
                              "mape": f"avg(abs({E} / y_true))", "mspe": f"avg(({E} / y_true) * ({E} / y_true))"},
            lambda: me.metric_bundle("y_true", "y_pred"))
_per_ticker("metric_rse", {"rse": f"sqrt(sum({E} * {E})) / sqrt(var_pop(y_true) * count(y_true))"},
            lambda: [me.rse("y_true", "y_pred").alias("rse")])


def _dnn(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN (CASE WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) ELSE 0.0 END) ELSE ({a}) / ({b}) END)"


_per_ticker("mape_loss", {"mape_loss": f"avg(abs({E} * {_dnn('CAST(mask AS DOUBLE)', 'y_true')}))"},
            lambda: [me.mape_loss("y_true", "y_pred", "mask").alias("mape_loss")])
_per_ticker("smape_loss", {"smape_loss": f"200.0 * avg({_dnn('abs(y_pred - y_true)', 'abs(y_pred) + abs(y_true)')} * mask)"},
            lambda: [me.smape_loss("y_true", "y_pred", "mask").alias("smape_loss")])


@query("metric_masked", f"""
WITH {F_SQL}
SELECT ticker, {r(f'avg(abs{E})')} AS mae, {r(f'avg({E} * {E})')} AS mse, CAST(count(*) AS BIGINT) AS n
FROM f WHERE mask = 0 GROUP BY ticker
""")
def q_metric_masked(spark, sf):
    f = forecasts(spark, sf).filter(F.col("mask") == 0)
    return rounded(f.groupBy("ticker").agg(me.mae("y_true", "y_pred").alias("mae"),
                                           me.mse("y_true", "y_pred").alias("mse"), F.count(F.lit(1)).alias("n")))


@query("metric_corr", f"""
WITH {F_SQL}, m AS (SELECT ticker, avg(y_true) AS my, avg(y_pred) AS mp FROM f GROUP BY 1)
SELECT ticker, {r('sum((y_true - my) * (y_pred - mp)) / sqrt(sum((y_true - my) * (y_true - my) * (y_pred - mp) * (y_pred - mp)))')} AS corr,
       {r('corr(y_true, y_pred)')} AS pearson
FROM f JOIN m USING (ticker) GROUP BY ticker
""")
def q_metric_corr(spark, sf):
    return rounded(me.corr_ref(forecasts(spark, sf), "ticker", "y_true", "y_pred"))


@query("mase_loss", f"""
WITH {F_SQL},
dd AS (SELECT ticker, abs(y_true - lag(y_true, {MASE_FREQ}) OVER (PARTITION BY ticker ORDER BY t)) AS d FROM f),
sc AS (SELECT ticker, avg(d) AS masep FROM dd GROUP BY ticker)
SELECT ticker, {r(f"avg(abs(y_true - y_pred) * {_dnn('CAST(mask AS DOUBLE)', 'masep')})")} AS mase_loss
FROM f JOIN sc USING (ticker) GROUP BY ticker
""")
def q_mase_loss(spark, sf):
    f = forecasts(spark, sf)
    d = fe.with_features(f, "ticker", "t", lambda w: [F.abs(F.col("y_true") - F.lag("y_true", MASE_FREQ).over(w)).alias("_d")],
                         back=MASE_FREQ)
    sc = d.groupBy("ticker").agg(F.avg("_d").alias("masep"))
    return rounded(f.join(sc, "ticker").groupBy("ticker").agg(me.mase_loss("y_true", "y_pred", "mask", "masep").alias("mase_loss")))


@query("sharpness_mse", f"""
WITH {F_SQL},
d AS (SELECT ticker, (y_pred - lag(y_pred) OVER (PARTITION BY ticker ORDER BY t))
                   - (y_true - lag(y_true) OVER (PARTITION BY ticker ORDER BY t)) AS dd FROM f)
SELECT ticker, {r('avg(dd * dd)')} AS sharpness_mse FROM d GROUP BY ticker
""")
def q_sharpness(spark, sf):
    f = forecasts(spark, sf)
    d = fe.with_features(f, "ticker", "t", lambda w: [
        ((F.col("y_pred") - F.lag("y_pred", 1).over(w)) - (F.col("y_true") - F.lag("y_true", 1).over(w))).alias("dd")], back=1)
    return rounded(d.groupBy("ticker").agg(F.avg(F.col("dd") * F.col("dd")).alias("sharpness_mse")))


@query("direction_accuracy", f"""
WITH {PANEL_SQL},
lr AS (SELECT ticker, t, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY t)) AS y FROM p),
d AS (SELECT ticker, y, lag(y) OVER (PARTITION BY ticker ORDER BY t) AS p FROM lr)
SELECT ticker, {r('avg(CAST(sign(y) = sign(p) AS DOUBLE))')} AS direction_accuracy
FROM d WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ticker
""")
def q_direction(spark, sf):
    p = indexed_panel(spark, sf)
    lr = fe.with_features(p, "ticker", "t", lambda w: [fe.log_return("close", w).alias("y")], back=1)
    d = fe.with_features(lr, "ticker", "t", lambda w: [F.lag("y", 1).over(w).alias("p")], back=1)
    d = d.filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    return rounded(d.groupBy("ticker").agg(me.direction_accuracy("y", "p").alias("direction_accuracy")))


# --------------------------------------------------------- anomaly scores
POINT_CUT = 450.0
ANOM_SQL = f"""a AS (SELECT CAST(event_type = 'error' AS INTEGER) AS gt, CAST(value > {POINT_CUT} AS INTEGER) AS pred FROM events)"""


def _anom(spark, sf):
    e = tb.read(spark, sf, "events")
    return e.select((F.col("event_type") == "error").cast("int").alias("gt"), (F.col("value") > POINT_CUT).cast("int").alias("pred"))


@query("accuracy", f"WITH {ANOM_SQL} SELECT {r('avg(CAST(gt = pred AS DOUBLE))')} AS accuracy FROM a")
def q_accuracy(spark, sf):
    return rounded(_anom(spark, sf).agg(me.accuracy("gt", "pred").alias("accuracy")))


@query("prf_binary", f"""
WITH {ANOM_SQL}, c AS (SELECT sum(CAST(gt = 1 AND pred = 1 AS DOUBLE)) AS tp, sum(CAST(gt = 0 AND pred = 1 AS DOUBLE)) AS fp,
                       sum(CAST(gt = 1 AND pred = 0 AS DOUBLE)) AS fn FROM a)
SELECT {r('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall,
       {r('coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0)')} AS f1 FROM c
""")
def q_prf(spark, sf):
    return rounded(_anom(spark, sf).agg(*me.prf_binary("gt", "pred")))


# --------------------------------------------------------------- M4 summary
# The competition's seasonal groups, frequencies, horizons
M4_META = [("Yearly", 1, 6), ("Quarterly", 4, 8), ("Monthly", 12, 18),
           ("Weekly", 1, 13), ("Daily", 1, 14), ("Hourly", 24, 48)]


def m4_frame(spark, sf):
    """Event series with group meta, in/out-of-sample split and step h."""
    meta = spark.createDataFrame(M4_META, "grp string, freq int, horizon int")
    e = indexed_events(spark, sf).join(F.broadcast(meta), "grp")
    e = wo.with_count(e, "series_id", "n")
    e = e.withColumn("n_in", F.col("n") - F.col("horizon"))
    return e


def m4_forecasts(spark, sf, e=None):
    """Seasonal-naive (model) and naive (baseline) forecasts per (series, h)."""
    e = m4_frame(spark, sf) if e is None else e
    outs = e.filter(F.col("t") >= F.col("n_in")).withColumn("h", (F.col("t") - F.col("n_in") + 1).cast("int"))
    outs = outs.withColumn("src", F.col("t") - F.col("freq") * F.ceil(F.col("h") / F.col("freq")))
    vals = e.select(F.col("series_id").alias("_sid"), F.col("t").alias("_st"), F.col("value").alias("_sv"))
    o = outs.join(vals, (F.col("series_id") == F.col("_sid")) & (F.col("src") == F.col("_st")), "left") \
        .drop("_sid", "_st").withColumnRenamed("_sv", "f_snaive")
    last = e.filter(F.col("t") == F.col("n_in") - 1).select(F.col("series_id").alias("_sid"), F.col("value").alias("f_naive"))
    o = o.join(last, F.col("series_id") == F.col("_sid"), "left").drop("_sid")
    o = o.withColumn("f_snaive", F.coalesce("f_snaive", "f_naive"))
    return o.select("series_id", "grp", "freq", "horizon", "h", "t", F.col("value").alias("y"), "f_snaive", "f_naive")


def m4_scales(spark, sf, e=None):
    """In-sample seasonal-naive MAE per series: mean |x_t - x_{t-m}|."""
    e = (m4_frame(spark, sf) if e is None else e).filter(F.col("t") < F.col("n_in"))
    prev = e.select(F.col("series_id").alias("_sid"), F.col("t").alias("_pt"), F.col("value").alias("_pv"))
    j = e.join(prev, (F.col("series_id") == F.col("_sid")) & (F.col("_pt") == F.col("t") - F.col("freq")))
    return j.groupBy("series_id").agg(F.avg(F.abs(F.col("value") - F.col("_pv"))).alias("scale"))


M4_SQL = f"""{EVENTS_SQL},
meta AS (SELECT * FROM (VALUES {', '.join(f"('{g}', {f}, {h})" for g, f, h in M4_META)}) m(grp, freq, horizon)),
s AS (SELECT ev.*, meta.freq, meta.horizon, count(*) OVER (PARTITION BY series_id) - meta.horizon AS n_in
      FROM ev JOIN meta USING (grp)),
outs AS (SELECT *, CAST(t - n_in + 1 AS INTEGER) AS h FROM s WHERE t >= n_in),
fc AS (SELECT o.series_id, o.grp, o.h, o.value AS y, coalesce(sn.value, nv.value) AS f_snaive, nv.value AS f_naive
       FROM outs o
       LEFT JOIN s sn ON sn.series_id = o.series_id AND sn.t = o.t - o.freq * ceil(o.h / o.freq)
       LEFT JOIN s nv ON nv.series_id = o.series_id AND nv.t = o.n_in - 1),
ins AS (SELECT * FROM s WHERE t < n_in),
sc AS (SELECT a.series_id, avg(abs(a.value - b.value)) AS scale FROM ins a JOIN ins b
       ON a.series_id = b.series_id AND b.t = a.t - a.freq GROUP BY 1)"""


def _smape_sql(f):
    return f"200.0 * abs({f} - y) / (CASE WHEN abs(y) + abs({f}) = 0 THEN 1.0 ELSE abs(y) + abs({f}) END)"


def _mape_sql(f):
    return f"100.0 * abs({f} - y) / (CASE WHEN abs(y) = 0 THEN 1.0 ELSE abs(y) END)"


@query("naive_baseline", f"WITH {M4_SQL} SELECT series_id, h, {r('f_snaive')} AS f_snaive, {r('f_naive')} AS f_naive FROM fc")
def q_naive_baseline(spark, sf):
    return rounded(m4_forecasts(spark, sf).select("series_id", "h", "f_snaive", "f_naive"))


@query("m4_smape", f"WITH {M4_SQL} SELECT grp, {r('avg(' + _smape_sql('f_snaive') + ')')} AS smape FROM fc GROUP BY grp")
def q_m4_smape(spark, sf):
    return rounded(m4_forecasts(spark, sf).groupBy("grp").agg(F.avg(me.m4_smape("y", "f_snaive")).alias("smape")))


@query("m4_mape", f"WITH {M4_SQL} SELECT grp, {r('avg(' + _mape_sql('f_snaive') + ')')} AS mape FROM fc GROUP BY grp")
def q_m4_mape(spark, sf):
    return rounded(m4_forecasts(spark, sf).groupBy("grp").agg(F.avg(me.m4_mape("y", "f_snaive")).alias("mape")))


def _series_mase(spark, sf, e=None, fc=None):
    fc = m4_forecasts(spark, sf, e) if fc is None else fc
    per = fc.groupBy("series_id", "grp").agg(F.avg(F.abs(F.col("f_snaive") - F.col("y"))).alias("_m"),
                                             F.avg(F.abs(F.col("f_naive") - F.col("y"))).alias("_n"))
    return per.join(m4_scales(spark, sf, e), "series_id").select(
        "series_id", "grp", F.try_divide("_m", "scale").alias("mase"), F.try_divide("_n", "scale").alias("mase_naive"))


MASE_SQL = """ms AS (SELECT fc.series_id, fc.grp, avg(abs(f_snaive - y)) / nullif(any_value(sc.scale), 0) AS mase,
                     avg(abs(f_naive - y)) / nullif(any_value(sc.scale), 0) AS mase_naive
              FROM fc JOIN sc USING (series_id) GROUP BY 1, 2)"""


@query("m4_mase", f"WITH {M4_SQL}, {MASE_SQL} SELECT grp, {r('avg(mase)')} AS mase FROM ms GROUP BY grp")
def q_m4_mase(spark, sf):
    return rounded(_series_mase(spark, sf).groupBy("grp").agg(F.avg("mase").alias("mase")))


@query("m4_owa_summary", f"""
WITH {M4_SQL}, {MASE_SQL},
g AS (SELECT grp, avg({_smape_sql('f_snaive')}) AS smape, avg({_mape_sql('f_snaive')}) AS mape,
             avg({_smape_sql('f_naive')}) AS smape_naive FROM fc GROUP BY grp),
gm AS (SELECT grp, avg(mase) AS mase, avg(mase_naive) AS mase_naive FROM ms GROUP BY grp),
cnt AS (SELECT grp, count(DISTINCT series_id) AS n FROM s GROUP BY grp),
a AS (SELECT * FROM g JOIN gm USING (grp) JOIN cnt USING (grp)),
sm AS (SELECT CASE WHEN grp IN ('Yearly', 'Quarterly', 'Monthly') THEN grp ELSE 'Others' END AS summary,
              sum(smape * n) / sum(n) AS smape, sum(mape * n) / sum(n) AS mape, sum(mase * n) / sum(n) AS mase,
              sum(smape_naive * n) / sum(n) AS smape_naive, sum(mase_naive * n) / sum(n) AS mase_naive FROM a GROUP BY 1
       UNION ALL
       SELECT 'Average', sum(smape * n) / sum(n), sum(mape * n) / sum(n), sum(mase * n) / sum(n),
              sum(smape_naive * n) / sum(n), sum(mase_naive * n) / sum(n) FROM a)
SELECT summary, {r('smape', 3)} AS smape, {r('mape', 3)} AS mape, {r('mase', 3)} AS mase,
       {r('(mase / mase_naive + smape / smape_naive) / 2.0', 3)} AS owa FROM sm
""")
def q_m4_owa(spark, sf):
    # the indexed event frame feeds forecasts, scales and counts: build once
    e = materialize(m4_frame(spark, sf))
    fc = m4_forecasts(spark, sf, e)
    g = fc.groupBy("grp").agg(F.avg(me.m4_smape("y", "f_snaive")).alias("smape"),
                              F.avg(me.m4_mape("y", "f_snaive")).alias("mape"),
                              F.avg(me.m4_smape("y", "f_naive")).alias("smape_naive"))
    gm = _series_mase(spark, sf, e, fc).groupBy("grp").agg(F.avg("mase").alias("mase"), F.avg("mase_naive").alias("mase_naive"))
    cnt = e.groupBy("grp").agg(F.countDistinct("series_id").alias("n"))
    sm = me.m4_summarize(g.join(gm, "grp"), cnt, ["smape", "mape", "mase", "smape_naive", "mase_naive"])
    sm = sm.withColumn("owa", (F.col("mase") / F.col("mase_naive") + F.col("smape") / F.col("smape_naive")) / F.lit(2.0))
    return rounded(sm.select("summary", "smape", "mape", "mase", "owa"), 3)


# ------------------------------------------------------------------ scalers
@query("fit_standard", f"""
WITH {DAILY_SQL}, c AS (SELECT CAST(floor(count(*) * {dbl(0.7)}) AS BIGINT) AS n_train FROM d)
SELECT {r('avg(OT)')} AS OT_mean, {r('CASE WHEN stddev_pop(OT) = 0 THEN 1.0 ELSE stddev_pop(OT) END')} AS OT_std
FROM d CROSS JOIN c WHERE d.t < c.n_train
""")
def q_fit_standard(spark, sf):
    d = wo.split_chrono(indexed_daily(spark, sf), "series_id", "t", 0).filter(F.col("split") == "train")
    return rounded(me.fit_standard(d, ["OT"]))


@query("inverse_standard", f"""
WITH {DAILY_SQL}, c AS (SELECT CAST(floor(count(*) * {dbl(0.7)}) AS BIGINT) AS n_train FROM d),
st AS (SELECT avg(OT) AS m, CASE WHEN stddev_pop(OT) = 0 THEN 1.0 ELSE stddev_pop(OT) END AS s FROM d CROSS JOIN c WHERE d.t < c.n_train)
SELECT date, {r('(OT - m) / s')} AS z, {r('((OT - m) / s) * s + m', 4)} AS OT_back FROM d CROSS JOIN st
""")
def q_inverse_standard(spark, sf):
    d = indexed_daily(spark, sf)
    st = me.fit_standard(wo.split_chrono(d, "series_id", "t", 0).filter(F.col("split") == "train"), ["OT"])
    z = me.apply_standard(d, st, ["OT"]).withColumnRenamed("OT", "z")
    back = me.apply_standard(z.withColumn("OT", F.col("z")), st, ["OT"], inverse=True)
    return rounded(back.select("date", "z", F.col("OT").alias("OT_back")), OT_back=4)


SEQ_SQL = f"s AS ({S.SEQUENCES})"
EPS = dbl(me.FLOAT_EPS)


@query("norm_standardization", f"""
WITH {SEQ_SQL}, st AS (SELECT t, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY t)
SELECT sample_id, t, {r(f'(value - m) / (sd + {EPS})')} AS z FROM s JOIN st USING (t)
""")
def q_norm_std(spark, sf):
    s = tb.sequences(spark, sf)
    st = s.groupBy("t").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return rounded(s.join(st, "t").select("sample_id", "t", ((F.col("value") - F.col("m")) / (F.col("sd") + F.lit(me.FLOAT_EPS))).alias("z")))


@query("norm_minmax", f"""
WITH {SEQ_SQL}, st AS (SELECT t, min(value) AS lo, max(value) AS hi FROM s GROUP BY t)
SELECT sample_id, t, {r(f'(value - lo) / (hi - lo + {EPS})')} AS z FROM s JOIN st USING (t)
""")
def q_norm_minmax(spark, sf):
    s = tb.sequences(spark, sf)
    st = s.groupBy("t").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rounded(s.join(st, "t").select("sample_id", "t", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(me.FLOAT_EPS))).alias("z")))


@query("norm_per_sample_std", f"""
WITH {SEQ_SQL}, st AS (SELECT sample_id, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY 1)
SELECT sample_id, t, {r('(value - m) / sd')} AS z FROM s JOIN st USING (sample_id)
""")
def q_norm_ps_std(spark, sf):
    s = tb.sequences(spark, sf)
    st = s.groupBy("sample_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return rounded(s.join(st, "sample_id").select("sample_id", "t", F.try_divide(F.col("value") - F.col("m"), F.col("sd")).alias("z")))


@query("norm_per_sample_minmax", f"""
WITH {SEQ_SQL}, st AS (SELECT sample_id, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1)
SELECT sample_id, t, {r(f'(value - lo) / (hi - lo + {EPS})')} AS z FROM s JOIN st USING (sample_id)
""")
def q_norm_ps_minmax(spark, sf):
    s = tb.sequences(spark, sf)
    st = s.groupBy("sample_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rounded(s.join(st, "sample_id").select("sample_id", "t", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(me.FLOAT_EPS))).alias("z")))


# --------------------------------------------------------------- vectors
@query("vector_mean", f"""
WITH {SEQ_SQL}, tv AS (SELECT label, t AS dim, avg(value) AS v FROM s GROUP BY 1, 2)
SELECT 'text' AS level, label AS id, dim, {r('v')} AS value FROM tv
UNION ALL
SELECT 'global' AS level, -1 AS id, dim, {r('avg(v)')} AS value FROM tv GROUP BY dim
""")
def q_vector_mean(spark, sf):
    """Token vectors (embedding rows) averaged per text (label), then the
    global vector = mean of the text vectors."""
    s = tb.sequences(spark, sf)
    tv = s.groupBy("label", F.col("t").alias("dim")).agg(F.avg("value").alias("v"))
    g = tv.groupBy("dim").agg(F.avg("v").alias("value")).select(F.lit("global").alias("level"), F.lit(-1).alias("id"), "dim", "value")
    t = tv.select(F.lit("text").alias("level"), F.col("label").alias("id"), "dim", F.col("v").alias("value"))
    return rounded(t.unionByName(g))


@query("vector_pool", f"""
WITH {SEQ_SQL}
SELECT label, t AS dim, {r('avg(value)')} AS avg_pool, {r('max(value)')} AS max_pool, {r('min(value)')} AS min_pool
FROM s GROUP BY 1, 2
""")
def q_vector_pool(spark, sf):
    s = tb.sequences(spark, sf)
    return rounded(s.groupBy("label", F.col("t").alias("dim")).agg(
        F.avg("value").alias("avg_pool"), F.max("value").alias("max_pool"), F.min("value").alias("min_pool")))


# ------------------------------------------------------- classification
CLS_SQL = f"""{SEQ_SQL}, c AS (SELECT label, t, avg(value) AS cv FROM s GROUP BY 1, 2),
sc AS (SELECT s.sample_id, c.label AS cls, -sqrt(sum((s.value - c.cv) * (s.value - c.cv))) AS score
       FROM s JOIN c USING (t) GROUP BY 1, 2)"""


def class_scores(spark, sf):
    """Score of every (sample, class) = minus the distance to the class
    centroid (centroids: one row per (class, dim), joined on dim)."""
    s = tb.sequences(spark, sf)
    c = s.groupBy(F.col("label").alias("cls"), "t").agg(F.avg("value").alias("cv"))
    return s.join(c, "t").groupBy("sample_id", "cls").agg(
        (-F.sqrt(F.sum((F.col("value") - F.col("cv")) ** 2))).alias("score"))


@query("argmax_class", f"""
WITH {CLS_SQL}, m AS (SELECT sample_id, max(score) AS mx FROM sc GROUP BY 1)
SELECT sample_id, min(CASE WHEN score = mx THEN cls END) AS pred_class, {r('1.0 / sum(exp(score - mx))')} AS prob
FROM sc JOIN m USING (sample_id) GROUP BY sample_id
""")
def q_argmax(spark, sf):
    return rounded(me.softmax_argmax(class_scores(spark, sf), "sample_id", "cls", "score"))


@query("category_codes", """
SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM events)
""")
def q_category_codes(spark, sf):
    d = tb.read(spark, sf, "events").select("event_type").distinct().withColumn("_k", F.lit(0))
    d = series_index(d, "_k", "event_type", out="code", bucket=F.substring("event_type", 1, 2))
    return d.select("event_type", F.col("code").cast("int").alias("code"))


@query("length_stats", f"""
WITH {EVENTS_SQL}, l AS (SELECT series_id, count(*) AS length FROM ev GROUP BY 1)
SELECT series_id, length, max(length) OVER () AS max_len, min(length) OVER () AS min_len,
       max(length) OVER () <> min(length) OVER () AS ragged FROM l
""")
def q_length_stats(spark, sf):
    l = tb.event_series(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("length"))
    g = l.agg(F.max("length").alias("max_len"), F.min("length").alias("min_len"))
    return l.crossJoin(F.broadcast(g)).withColumn("ragged", F.col("max_len") != F.col("min_len"))
