"""Queries: the reference's experiments as end-to-end Spark jobs
(SURVEY §2.13) and the baseline forecasters (§2.8, forecasting rows).

The network in the middle of each experiment is replaced by a
deterministic table-level model; everything before and after it is the
same data work: split, scale, window, forecast, blend, invert, score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tsq.functions import rng
from tsq.operators import anomaly as an
from tsq.operators import classify as lr
from tsq.operators import clean as cl
from tsq.operators import features as fe
from tsq.operators import forecast as fc
from tsq.operators import lagged as lg
from tsq.operators import metrics as me
from tsq.operators import windows as wo
from tsq.operators.index import series_index
from tsq.plans import sqlparts as S
from tsq.plans.functions import CHANNELS
from tsq.plans.metrics import M4_SQL, MASE_SQL, _mape_sql, _series_mase, _smape_sql, m4_forecasts
from tsq.plans.registry import dbl, query, r, rounded
from tsq.plans.windows import DAILY_SQL, EVENTS_SQL, LABEL_LEN, MA_KERNEL, SEQ_LEN, indexed_daily, indexed_events
from tsq.session import materialize
from tsq.sources import tables as tb

EVAL_PREDS = (12, 24)
SEASON = 7
PROMPT_WEIGHT = 0.01  # fixed default blend weight of the reference
PRIOR_WINDOW = 30


# ------------------------------------------------------------ forecasting
def scaled_daily(spark, sf):
    """Daily target and its prior, scaled with train-slice statistics."""
    d = wo.with_count(indexed_daily(spark, sf), "series_id")
    d = d.withColumn("n_train", F.floor(F.col("_n") * F.lit(0.7))).withColumn("n_test", F.floor(F.col("_n") * F.lit(0.2)))
    st = me.fit_standard(d.filter(F.col("t") < F.col("n_train")), ["OT"], keys="series_id")
    d = fe.with_features(d, "series_id", "t", lambda w: [fe.trailing_mean("OT", PRIOR_WINDOW, w).alias("prior")],
                         back=PRIOR_WINDOW)
    d = d.join(st, "series_id")
    return d.select("series_id", "t", "date", "_n", "n_test",
                    ((F.col("OT") - F.col("OT_mean")) / F.col("OT_std")).alias("z"),
                    ((F.col("prior") - F.col("OT_mean")) / F.col("OT_std")).alias("pz"))


def model_forecasts(z, seq_len: int, preds, lo=None, hi=None):
    """Persistence, look-back mean and seasonal-naive forecasts (long form
    with model, pred_len, window_id, h, t, y, yhat, pz)."""
    frames = None
    for p in preds:
        f = fc.horizon_frame(z, "series_id", "t", seq_len, p, lo=lo, hi=hi).withColumn("pred_len", F.lit(p))
        frames = f if frames is None else frames.unionByName(f)
    lb = wo.lookback_profile(z.select("series_id", "t", "z"), "series_id", "t", "z", seq_len)
    g = fc.lookup(frames, lb, "series_id", "origin", "t", ["lb_mean", "lb_last"])
    g = g.withColumn("_src", fc.seasonal_source("t", "h", SEASON))
    g = fc.lookup(g, z.select("series_id", "t", "z"), "series_id", "_src", "t", ["z"], prefix="sn_")
    models = F.array(F.struct(F.lit("persistence").alias("model"), F.col("lb_last").alias("yhat")),
                     F.struct(F.lit("mean").alias("model"), F.col("lb_mean").alias("yhat")),
                     F.struct(F.lit("seasonal_naive").alias("model"), F.col("sn_z").alias("yhat")))
    return g.select("series_id", "pred_len", "window_id", "h", "t", F.col("z").alias("y"), "pz", F.inline(models))


FC_SQL = f"""{DAILY_SQL},
c AS (SELECT count(*) AS n, floor(count(*) * {dbl(0.7)}) AS n_train, floor(count(*) * {dbl(0.2)}) AS n_test FROM d),
st AS (SELECT avg(OT) AS m, CASE WHEN stddev_pop(OT) = 0 THEN 1.0 ELSE stddev_pop(OT) END AS s FROM d CROSS JOIN c WHERE d.t < c.n_train),
z AS (SELECT t, (OT - m) / s AS z, (avg(OT) OVER (ORDER BY t ROWS BETWEEN {PRIOR_WINDOW} PRECEDING AND 1 PRECEDING) - m) / s AS pz
      FROM d CROSS JOIN st),
lb AS (SELECT t AS origin, avg(z) OVER (ORDER BY t ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS lb_mean, z AS lb_last FROM z),
f AS (SELECT P.pred_len, z.t, hh.h, z.t - {SEQ_LEN} - hh.h + 1 AS s, z.z AS y, z.pz
      FROM z CROSS JOIN c CROSS JOIN (VALUES {', '.join(f'({p})' for p in EVAL_PREDS)}) P(pred_len) CROSS JOIN range(1, 100) hh(h)
      WHERE hh.h <= P.pred_len AND z.t - {SEQ_LEN} - hh.h + 1 >= c.n - c.n_test - {SEQ_LEN}
        AND z.t - {SEQ_LEN} - hh.h + 1 + {SEQ_LEN} + P.pred_len <= c.n),
g AS (SELECT f.*, lb.lb_mean, lb.lb_last, zs.z AS sn FROM f JOIN lb ON lb.origin = f.s + {SEQ_LEN - 1}
      LEFT JOIN z zs ON zs.t = f.t - {SEASON} * ceil(f.h / {SEASON})),
m AS (SELECT 'persistence' AS model, pred_len, s, h, y, pz, lb_last AS yhat FROM g
      UNION ALL SELECT 'mean', pred_len, s, h, y, pz, lb_mean FROM g
      UNION ALL SELECT 'seasonal_naive', pred_len, s, h, y, pz, sn FROM g)"""

W = dbl(PROMPT_WEIGHT)
BL = f"({dbl(1 - PROMPT_WEIGHT)} * yhat + {W} * pz)"


@query("forecast_eval", f"""
WITH {FC_SQL}
SELECT model, pred_len, {r(f'avg(abs({BL} - y))')} AS mae, {r(f'avg(({BL} - y) * ({BL} - y))')} AS mse,
       {r(f'sqrt(avg(({BL} - y) * ({BL} - y)))')} AS rmse, {r(f'avg(abs(({BL} - y) / nullif(y, 0)))')} AS mape,
       {r(f'avg((({BL} - y) / nullif(y, 0)) * (({BL} - y) / nullif(y, 0)))')} AS mspe, count(*) AS n
FROM m GROUP BY model, pred_len
""")
def q_forecast_eval(spark, sf):
    """split -> scale (train stats) -> test windows (seq 24, horizons 12/24)
    -> persistence / look-back mean / seasonal naive -> blend with the scaled
    prior (w = 0.01) -> metric bundle per (model, horizon)."""
    z = scaled_daily(spark, sf).withColumn("_lo", F.col("_n") - F.col("n_test") - F.lit(SEQ_LEN))
    m = model_forecasts(z, SEQ_LEN, EVAL_PREDS, lo="_lo", hi="_n")
    m = m.withColumn("yb", fc.blend_prior(F.col("yhat"), F.col("pz"), PROMPT_WEIGHT))
    return rounded(m.groupBy("model", "pred_len").agg(*me.metric_bundle("y", "yb"), F.count(F.lit(1)).alias("n")))


LIN_P = 12


# the fitted map: products of (look-back, 1, horizon) summed over the training windows, the first
# seq_len + 1 variables swept; then rows are variables and columns 26 to 37 the steps' coefficients
LINEAR_SQL = f"""WITH RECURSIVE {FC_SQL},
near AS (SELECT t, list(z) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND {SEQ_LEN + LIN_P - 1} FOLLOWING) AS a FROM z),
v AS (SELECT 1 AS one, list_concat(a[1:{SEQ_LEN}], [1.0::DOUBLE], a[{SEQ_LEN + 1}:]) AS v FROM near CROSS JOIN c WHERE t + {SEQ_LEN + LIN_P} <= c.n_train),
gr AS {S.gram('v', 'one')},
sw AS (
  SELECT 1 AS k, m, m AS g FROM gr
  UNION ALL
  SELECT k + 1, {S.SWEPT}, g FROM sw WHERE k <= {SEQ_LEN + 1}),
fit AS (
  SELECT h, [m[i][{SEQ_LEN + 1} + h] for i in range(1, {SEQ_LEN + 1})] AS w, m[{SEQ_LEN + 1}][{SEQ_LEN + 1} + h] AS b
  FROM sw, range(1, {LIN_P + 1}) hh(h) WHERE k = {SEQ_LEN + 2})"""


@query("linear_ar_forecast", f"""
{LINEAR_SQL}
SELECT g.s AS window_id, g.h, {r('lb_mean')} AS y_pred, {r(f'list_dot_product(near.a[1:{SEQ_LEN}], fit.w) + fit.b')} AS y_fit
FROM g JOIN near ON near.t = g.s JOIN fit ON fit.h = g.h WHERE pred_len = {LIN_P}
""")
def q_linear_ar(spark, sf):
    """Linear look-back -> horizon map on the test windows: in its initial
    form (all weights 1/seq_len: the look-back mean) and fitted by least
    squares on the training windows, all steps at once."""
    z = scaled_daily(spark, sf).withColumn("_lo", F.col("_n") - F.col("n_test") - F.lit(SEQ_LEN))
    z = materialize(z, "scaled-daily")
    fitted = lg.fit_linear(z.where(F.col("t") < F.floor(F.col("_n") * F.lit(0.7))), "series_id", "t", "z", SEQ_LEN, LIN_P)
    test = z.where(F.col("t") >= F.col("_lo"))
    key = ["series_id", "window_id", "h"]
    first = lg.predict_linear(test, "series_id", "t", "z", lg.initial_linear(spark, SEQ_LEN, LIN_P), SEQ_LEN)
    best = lg.predict_linear(test, "series_id", "t", "z", fitted, SEQ_LEN).withColumnRenamed("y_pred", "y_fit")
    ends = z.groupBy("series_id").agg(F.max("_n").alias("_n"))
    out = first.join(best, key).join(ends, "series_id").where(F.col("window_id") + F.lit(SEQ_LEN + LIN_P) <= F.col("_n"))
    return rounded(out.select("window_id", "h", "y_pred", "y_fit"))


@query("forecast_ensemble", f"""
WITH {FC_SQL}
SELECT s AS window_id, h, {r('avg(yhat)')} AS y_ens FROM m WHERE pred_len = {LIN_P} GROUP BY s, h
""")
def q_ensemble(spark, sf):
    """Mean of the baseline forecasts per (window, step)."""
    z = scaled_daily(spark, sf).withColumn("_lo", F.col("_n") - F.col("n_test") - F.lit(SEQ_LEN))
    m = model_forecasts(z, SEQ_LEN, [LIN_P], lo="_lo", hi="_n")
    return rounded(m.groupBy("window_id", "h").agg(F.avg("yhat").alias("y_ens")))


def window_text_vectors(spark, sf, windows):
    """Text vector per window: the mean of the embedding rows of all documents
    of the origin day (doc id mod |embeddings|, ranked by vec_id); zero when
    the day has no text.  Long form (window_id, h, tv) for h = 1..P."""
    n = tb.news(spark, sf).select("date", "doc_id")
    e = tb.read(spark, sf, "embeddings").withColumn("_k", F.lit(0))
    e = series_index(e, "_k", "vec_id", out="er", bucket=F.floor(F.col("vec_id") / F.lit(65536))).drop("_k")
    ne = e.agg(F.count(F.lit(1)).alias("ne"))
    # documents of a day that share an embedding row are counted before the row is fetched
    dv = n.crossJoin(F.broadcast(ne)).groupBy("date", (F.col("doc_id") % F.col("ne")).alias("er")).agg(F.count(F.lit(1)).alias("_c")) \
        .join(e.select("er", "embedding"), "er").select("date", "_c", F.posexplode("embedding").alias("_p", "_v")) \
        .groupBy(F.col("date").alias("origin_date"), (F.col("_p") + 1).alias("h")) \
        .agg((F.sum(F.col("_v").cast("double") * F.col("_c")) / F.sum("_c")).alias("_m"))
    w = windows.join(dv, ["origin_date", "h"], "left").withColumn("tv", F.coalesce("_m", F.lit(0.0)))
    st = w.groupBy("window_id").agg(F.avg("tv").alias("_tm"), F.var_pop("tv").alias("_tv"))
    return w.join(st, "window_id").withColumn("tvn", (F.col("tv") - F.col("_tm")) / F.sqrt(F.col("_tv") + F.lit(1e-5)))


@query("blend_text_prior", f"""
WITH {FC_SQL}, nw AS ({S.NEWS}),
er AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS er FROM embeddings),
ne AS (SELECT count(*) AS ne FROM embeddings),
od AS (SELECT t, date AS origin_date FROM d),
tvd AS (SELECT nw.date, u.pos AS h, avg(CAST(u.v AS DOUBLE)) AS v
        FROM nw CROSS JOIN ne JOIN er ON er.er = nw.doc_id % ne.ne, unnest(er.embedding) WITH ORDINALITY AS u(v, pos) GROUP BY nw.date, u.pos),
b AS (SELECT g.s, g.h, g.lb_last AS yhat, g.pz, coalesce(tvd.v, 0.0) AS tv
      FROM g JOIN od ON od.t = g.s + {SEQ_LEN - 1} LEFT JOIN tvd ON tvd.date = od.origin_date AND tvd.h = g.h WHERE g.pred_len = {LIN_P}),
bn AS (SELECT *, (tv - avg(tv) OVER (PARTITION BY s)) / sqrt(var_pop(tv) OVER (PARTITION BY s) + 1e-5) AS tvn FROM b)
SELECT s AS window_id, h, {r(f'{dbl(1 - PROMPT_WEIGHT)} * yhat + {W} * (tvn + pz)')} AS y_blend FROM bn
""")
def q_blend_text_prior(spark, sf):
    """y = (1 - w) * y_hat + w * (norm(text vector) + prior), persistence
    forecast, text vector of the window's origin day."""
    z = scaled_daily(spark, sf).withColumn("_lo", F.col("_n") - F.col("n_test") - F.lit(SEQ_LEN))
    m = model_forecasts(z, SEQ_LEN, [LIN_P], lo="_lo", hi="_n").filter(F.col("model") == "persistence")
    dates = z.select(F.col("t").alias("origin"), F.col("date").alias("origin_date"))
    m = m.withColumn("origin", F.col("window_id") + F.lit(SEQ_LEN - 1)).join(dates, "origin")
    w = window_text_vectors(spark, sf, m)
    out = w.withColumn("y_blend", fc.blend_prior(F.col("yhat"), F.col("pz"), PROMPT_WEIGHT, text=F.col("tvn")))
    return rounded(out.select("window_id", "h", "y_blend"))


@query("decomp_init_forecast", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
m AS (SELECT t, OT, (sum(OT) OVER (ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
        + (12 - count(*) OVER (ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) * first_value(OT) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        + (12 - count(*) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)) * last_value(OT) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 25.0 AS trend,
        avg(OT) OVER (ORDER BY t ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS xm FROM d),
w AS (SELECT m.t - {SEQ_LEN - 1} AS window_id, m.xm FROM m CROSS JOIN c WHERE m.t >= {SEQ_LEN - 1} AND m.t + {LIN_P} < c.n)
SELECT w.window_id, CAST(k.k AS INTEGER) AS step,
       {r(f'CASE WHEN k.k < {LABEL_LEN} THEN mm.trend ELSE w.xm END', 9)} AS trend_init,
       {r(f'CASE WHEN k.k < {LABEL_LEN} THEN mm.OT - mm.trend ELSE 0.0 END', 9)} AS seasonal_init
FROM w CROSS JOIN range(0, {LABEL_LEN + LIN_P}) k(k)
LEFT JOIN m mm ON mm.t = w.window_id + {SEQ_LEN - LABEL_LEN} + k.k AND k.k < {LABEL_LEN}
""")
def q_decomp_init(spark, sf):
    """Decoder initialisation: trend of the last label_len look-back steps
    then the look-back mean; seasonal part of those steps then zeros."""
    d = indexed_daily(spark, sf)
    dec = wo.decompose(d, "series_id", "t", "OT", [MA_KERNEL])
    lb = wo.lookback_profile(d, "series_id", "t", "OT", SEQ_LEN)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    w = lb.crossJoin(F.broadcast(n)).filter(F.col("t") + F.lit(LIN_P) < F.col("n")) \
        .select((F.col("t") - F.lit(SEQ_LEN - 1)).alias("window_id"), F.col("lb_mean").alias("xm"))
    w = w.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(LABEL_LEN + LIN_P - 1))))
    w = w.withColumn("_src", F.when(F.col("step") < LABEL_LEN, F.col("window_id") + F.lit(SEQ_LEN - LABEL_LEN) + F.col("step")))
    w = fc.lookup(w, dec.withColumn("series_id", F.lit("all")), [], "_src", "t", ["trend", "seasonal"])
    return rounded(w.select("window_id", "step",
                            F.when(F.col("step") < LABEL_LEN, F.col("trend")).otherwise(F.col("xm")).alias("trend_init"),
                            F.when(F.col("step") < LABEL_LEN, F.col("seasonal")).otherwise(F.lit(0.0)).alias("seasonal_init")),
                   9)  # means of 5-decimal values are exact at 9 decimals


# -------------------------------------------------------------------- M4
@query("m4_eval", f"""
WITH {M4_SQL}, {MASE_SQL},
g AS (SELECT grp, avg({_smape_sql('f_snaive')}) AS smape, avg({_mape_sql('f_snaive')}) AS mape,
             avg({_smape_sql('f_naive')}) AS smape_naive FROM fc GROUP BY grp),
gm AS (SELECT grp, avg(mase) AS mase, avg(mase_naive) AS mase_naive FROM ms GROUP BY grp)
SELECT grp, {r('smape')} AS smape, {r('mape')} AS mape, {r('mase')} AS mase,
       {r('(mase / mase_naive + smape / smape_naive) / 2.0')} AS owa FROM g JOIN gm USING (grp)
""")
def q_m4_eval(spark, sf):
    """Last horizon of every series held out -> seasonal-naive forecast ->
    per-group sMAPE / MAPE / MASE / OWA against the naive baseline."""
    from tsq.plans.metrics import m4_frame
    e = materialize(m4_frame(spark, sf))
    f = m4_forecasts(spark, sf, e)
    g = f.groupBy("grp").agg(F.avg(me.m4_smape("y", "f_snaive")).alias("smape"),
                             F.avg(me.m4_mape("y", "f_snaive")).alias("mape"),
                             F.avg(me.m4_smape("y", "f_naive")).alias("smape_naive"))
    gm = _series_mase(spark, sf, e, f).groupBy("grp").agg(F.avg("mase").alias("mase"), F.avg("mase_naive").alias("mase_naive"))
    j = g.join(gm, "grp").withColumn("owa", (F.col("mase") / F.col("mase_naive") + F.col("smape") / F.col("smape_naive")) / F.lit(2.0))
    return rounded(j.select("grp", "smape", "mape", "mase", "owa"))


# --------------------------------------------------------------- anomaly
ANOMALY_RATIO = 20.0
RECON_K = 5


ANOMALY_WINDOW, ANOMALY_AXES = 8, 3


def anomaly_windows(spark, sf):
    """Windows of the training part and of the test part of every series,
    scaled with the training part's statistics."""
    e = wo.with_count(indexed_events(spark, sf), "series_id")
    e = e.withColumn("n_train", F.floor(F.col("_n") * F.lit(0.7)))
    st = me.fit_standard(e.filter(F.col("t") < F.col("n_train")), ["value"], keys="series_id")
    z = me.apply_standard(e, st, ["value"], keys="series_id")
    z = z.withColumn("split", F.when(F.col("t") < F.col("n_train"), F.lit("train")).otherwise(F.lit("test")))
    return an.windows(z, ["series_id", "split"], "t", {"x": "value", "label": "label"}, ANOMALY_WINDOW)


def anomaly_scores(spark, sf, components: bool = False):
    """One energy for each window and step, by the moving average of the
    window itself or by the components of all training windows."""
    w = materialize(anomaly_windows(spark, sf), "anomaly-windows")
    if components:
        model = an.fit_components(w.where("split = 'train'"), "x", ANOMALY_AXES)
        w = w.withColumn("e", an.component_energy(model, "x")) if model else w.limit(0).withColumn("e", F.col("x"))
    else:
        w = w.withColumn("e", an.smooth_energy("x", ANOMALY_WINDOW, RECON_K))
    return an.scores(w, ["series_id", "split"], "e", "label")


W_ = ANOMALY_WINDOW
AN_SQL = f"""{EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n, floor(count(*) * {dbl(0.7)}) AS n_train FROM ev GROUP BY 1),
st AS (SELECT series_id, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS s
       FROM ev JOIN c USING (series_id) WHERE t < n_train GROUP BY 1),
z AS (SELECT ev.series_id, ev.t, ev.label, (ev.value - st.m) / st.s AS x, CASE WHEN ev.t < c.n_train THEN 'train' ELSE 'test' END AS split,
             CASE WHEN ev.t < c.n_train THEN c.n_train ELSE c.n END AS stop
      FROM ev JOIN st USING (series_id) JOIN c USING (series_id)),
wx AS (SELECT a.series_id, a.split, a.t AS window_id, b.t - a.t AS step, b.x, b.label
       FROM z a JOIN z b ON b.series_id = a.series_id AND b.split = a.split AND b.t BETWEEN a.t AND a.t + {W_ - 1} WHERE a.t + {W_} <= a.stop),
rc AS (SELECT *, (sum(x) OVER w + (2 - least(step, 2)) * first_value(x) OVER wa + (2 - least({W_ - 1} - step, 2)) * last_value(x) OVER wa) / 5.0 AS rec
       FROM wx WINDOW w AS (PARTITION BY series_id, split, window_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
                      wa AS (PARTITION BY series_id, split, window_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
en AS (SELECT *, (x - rec) * (x - rec) AS energy FROM rc)"""

ADJUST_SQL = f"""th AS (SELECT quantile_cont(energy, {dbl(1 - ANOMALY_RATIO / 100)}) AS thr FROM en),
te AS (SELECT series_id, window_id * {W_} + step AS t, label AS gt, CAST(energy > thr AS INTEGER) AS pred FROM en CROSS JOIN th WHERE split = 'test'),
t0 AS (SELECT *, CASE WHEN gt = 1 AND coalesce(lag(gt) OVER (PARTITION BY series_id ORDER BY t), 0) = 0 THEN t END AS st0 FROM te),
sg AS (SELECT *, CASE WHEN gt = 1 THEN max(st0) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS seg FROM t0),
adj AS (SELECT gt, CASE WHEN seg IS NOT NULL AND max(pred) OVER (PARTITION BY series_id, seg) = 1 THEN 1 ELSE pred END AS pred FROM sg),
cnt AS (SELECT sum(CAST(gt = 1 AND pred = 1 AS DOUBLE)) AS tp, sum(CAST(gt = 0 AND pred = 1 AS DOUBLE)) AS fp,
               sum(CAST(gt = 1 AND pred = 0 AS DOUBLE)) AS fn, avg(CAST(gt = pred AS DOUBLE)) AS acc, count(*) AS n FROM adj)"""


@query("anomaly_window_scores", f"""
WITH {AN_SQL}
SELECT series_id, split, window_id, step, label, {r('energy')} AS energy FROM en
""")
def q_anomaly_window_scores(spark, sf):
    """Energies of all windows and steps (moving-average reconstruction)."""
    return rounded(anomaly_scores(spark, sf))


def _evaluated(s):
    """Threshold = percentile of all window energies of both parts; detect on
    the test windows one after the other, point-adjust, score."""
    s = materialize(s, "anomaly-scores")
    thr = me.exact_percentile(s, "energy", 1 - ANOMALY_RATIO / 100)
    te = s.filter(F.col("split") == "test").crossJoin(F.broadcast(thr))
    te = te.select("series_id", (F.col("window_id") * ANOMALY_WINDOW + F.col("step")).alias("t"), F.col("label").alias("gt"),
                   (F.col("energy") > F.col("percentile")).cast("int").alias("pred"))
    adj = wo.point_adjust(te, "series_id", "t")
    return rounded(adj.agg(me.accuracy("gt", "pred_adj").alias("accuracy"), *me.prf_binary("gt", "pred_adj"), F.count(F.lit(1)).alias("n")))


@query("anomaly_eval", f"""
WITH {AN_SQL},
{ADJUST_SQL}
SELECT {r('acc')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision,
       {r('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall,
       {r('coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0)')} AS f1, n FROM cnt
""")
def q_anomaly_eval(spark, sf):
    """scale (train stats per series) -> windows of either part -> rebuild
    (centred moving average of the window) -> energy per (window, step) ->
    threshold = percentile of train+test energies -> detect on test windows ->
    point adjust -> accuracy / precision / recall / F1."""
    return _evaluated(anomaly_scores(spark, sf))


@query("anomaly_eval_pca")
def q_anomaly_eval_pca(spark, sf):
    """The same with windows rebuilt from the leading principal components of
    all training windows (no SQL: tested against numpy)."""
    return _evaluated(anomaly_scores(spark, sf, components=True))


# ------------------------------------------------------------ imputation
IMP_RATE, IMP_SEED = 0.125, 11


def _gappy(spark, sf):
    from tsq.plans.clean import hourly_gappy
    g = hourly_gappy(spark, sf)
    keep = (rng.uniform("ts", "channel", F.lit("mask"), F.lit(IMP_SEED)) > F.lit(IMP_RATE)).cast("int")
    return g.withColumn("mask", keep)


@query("imputation_eval", f"""
WITH h AS ({S.HOURLY}), ht AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t FROM h),
hg AS ({' UNION ALL '.join(f"SELECT ts, t, '{c}' AS channel, \"{c}\" AS value FROM ht" for c in CHANNELS)}),
mk AS (SELECT *, CAST({rng.sql_uniform('ts', 'channel', "'mask'", str(IMP_SEED))} > {dbl(IMP_RATE)} AS INTEGER) AS mask FROM hg),
xin AS (SELECT *, CASE WHEN mask = 1 THEN value END AS xi FROM mk),
st AS (SELECT channel, avg(xi) AS m, sqrt(var_pop(xi) + 1e-5) AS s FROM xin GROUP BY 1),
zz AS (SELECT xin.*, (xi - m) / s AS zi, (value - m) / s AS zt FROM xin JOIN st USING (channel)),
a AS (SELECT *,
        last_value(CASE WHEN zi IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
        last_value(zi IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        first_value(CASE WHEN zi IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
        first_value(zi IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM zz),
f AS (SELECT channel, zt, mask, value,
        CASE WHEN zi IS NOT NULL THEN zi WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END AS zf FROM a)
SELECT channel, {r('avg(abs(zf - zt))')} AS mae, {r('avg((zf - zt) * (zf - zt))')} AS mse, count(*) AS n
FROM f WHERE mask = 0 AND value IS NOT NULL GROUP BY channel
""")
def q_imputation_eval(spark, sf):
    """hash mask (12.5 %) -> masked normalisation (observed, unmasked cells)
    -> linear interpolation -> MAE/MSE on masked observed cells per channel."""
    g = _gappy(spark, sf).withColumn("xi", F.when(F.col("mask") == 1, F.col("value")))
    st = g.groupBy("channel").agg(F.avg("xi").alias("m"), F.sqrt(F.var_pop("xi") + F.lit(1e-5)).alias("s"))
    z = g.join(st, "channel").withColumn("zi", (F.col("xi") - F.col("m")) / F.col("s")) \
        .withColumn("zt", (F.col("value") - F.col("m")) / F.col("s"))
    f = cl.impute_linear(z.withColumn("zf", F.col("zi")), "channel", "t", ["zf"])
    ev = f.filter((F.col("mask") == 0) & F.col("value").isNotNull())
    return rounded(ev.groupBy("channel").agg(me.mae("zt", "zf").alias("mae"), me.mse("zt", "zf").alias("mse"),
                                             F.count(F.lit(1)).alias("n")))


# -------------------------------------------------------- classification
SPLIT_SEED = 5


@query("classification_eval", f"""
WITH s AS ({S.SEQUENCES}),
sp AS (SELECT *, {rng.sql_uniform('sample_id', "'split'", str(SPLIT_SEED))} < 0.7 AS is_train FROM s),
st AS (SELECT t, avg(value) AS m, stddev_samp(value) AS sd FROM sp WHERE is_train GROUP BY t),
z AS (SELECT sp.sample_id, sp.label, sp.t, sp.is_train, (sp.value - st.m) / (st.sd + {dbl(me.FLOAT_EPS)}) AS z FROM sp JOIN st USING (t)),
c AS (SELECT label AS cls, t, avg(z) AS cz FROM z WHERE is_train GROUP BY 1, 2),
sc AS (SELECT z.sample_id, any_value(z.label) AS label, c.cls, -sqrt(sum((z.z - c.cz) * (z.z - c.cz))) AS score
       FROM z JOIN c USING (t) WHERE NOT z.is_train GROUP BY z.sample_id, c.cls),
mx AS (SELECT sample_id, max(score) AS m FROM sc GROUP BY 1),
pr AS (SELECT sc.sample_id, any_value(sc.label) AS label, min(CASE WHEN score = m THEN cls END) AS pred FROM sc JOIN mx USING (sample_id) GROUP BY 1)
SELECT count(*) AS n_test, {r('avg(CAST(pred = label AS DOUBLE))')} AS accuracy FROM pr
""")
def q_classification_eval(spark, sf):
    """hash split -> normalise (train stats per position) -> nearest class
    centroid -> argmax -> accuracy on the test samples."""
    s = tb.sequences(spark, sf).withColumn("is_train", rng.uniform("sample_id", F.lit("split"), F.lit(SPLIT_SEED)) < F.lit(0.7))
    st = s.filter("is_train").groupBy("t").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = s.join(st, "t").withColumn("z", (F.col("value") - F.col("m")) / (F.col("sd") + F.lit(me.FLOAT_EPS)))
    c = z.filter("is_train").groupBy(F.col("label").alias("cls"), "t").agg(F.avg("z").alias("cz"))
    sc = z.filter(~F.col("is_train")).join(c, "t").groupBy("sample_id", "label", "cls") \
        .agg((-F.sqrt(F.sum((F.col("z") - F.col("cz")) ** 2))).alias("score"))
    pr = me.softmax_argmax(sc, ["sample_id", "label"], "cls", "score")
    return rounded(pr.agg(F.count(F.lit(1)).alias("n_test"), me.accuracy("label", "pred_class").alias("accuracy")))


@query("classification_logistic")
def q_classification_logistic(spark, sf):
    """The same split -> multinomial logistic regression on padded, masked
    samples (gradients summed over the cluster) -> accuracy on the test
    samples (no SQL: tested against numpy)."""
    s = tb.sequence_arrays(spark, sf).withColumn("is_train", rng.uniform("sample_id", F.lit("split"), F.lit(SPLIT_SEED)) < F.lit(0.7))
    s = materialize(s, "samples")  # read again by every step
    model = lr.fit_logistic(s.filter("is_train"))
    test = s.filter(~F.col("is_train"))
    pr = lr.predict(test, model) if model else test.withColumn("pred_class", F.lit(None).cast("int"))
    return rounded(pr.agg(F.count(F.lit(1)).alias("n_test"), me.accuracy("label", "pred_class").alias("accuracy")))


# ------------------------------------------------------------ regression
@query("return_regression")
def q_return_regression(spark, sf):
    """select features -> impute means -> join the global text vector ->
    ordered split (last 15 % test) -> scale (train) -> linear regression of
    the next return -> RMSE.  ``pyspark.ml`` fits by distributed normal
    equations; not SQL-expressible (rows-only check)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tsq.plans.joins import global_vector

    f = materialize(fe.stock_features(tb.ticker_panel(spark, sf)))
    fi = series_index(f.withColumn("_d", F.to_date("date")), "ticker", "_d")
    tgt = fe.next_return_target(fi, "ticker", "t", "close_used", out="target")
    # the kept feature *names* (bounded by the column count) drive the schema
    kept = [row["column"] for row in cl.select_numeric_features(f.drop("close_used"), exclude=["target"]).collect()]
    d = cl.impute_mean(tgt.select("ticker", "_d", "target", *kept), kept)
    d = d.crossJoin(F.broadcast(global_vector(spark, sf)))
    feats = kept + [f"news_{i}" for i in range(64)]
    # the fit makes several passes (scaler, solver): read a checkpoint, not
    # the whole feature lineage, on every pass
    d = materialize(wo.split_tail(d, ["ticker", "_d"], 0.15))
    tr, te = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="x", handleInvalid="keep"),
                            StandardScaler(inputCol="x", outputCol="xs", withMean=True, withStd=True),
                            LinearRegression(featuresCol="xs", labelCol="target", regParam=1e-3)])
    model = pipe.fit(tr)
    p = model.transform(te)
    return rounded(p.agg(me.rmse("target", "prediction").alias("rmse"), F.count(F.lit(1)).alias("n_test")))


# ------------------------------------------------------------------ text
def _fmt(d, k):
    return (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy MM/dd"))
            .when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "yyyyMMdd"))
            .when(k == 4, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-0")))
            .otherwise(F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))))


def _fmt_sql(d, k):
    return f"""CASE {k} WHEN 0 THEN strftime({d}, '%Y-%m-%d') WHEN 1 THEN strftime({d}, '%Y %m/%d')
      WHEN 2 THEN strftime({d}, '%Y/%m/%d') WHEN 3 THEN strftime({d}, '%Y%m%d') WHEN 4 THEN strftime({d}, '%Y-%m') || '-0'
      ELSE CAST(year({d}) AS VARCHAR) || '-' || CAST(month({d}) AS VARCHAR) || '-' || CAST(day({d}) AS VARCHAR) END"""


def _clean_sql(col):
    from tsq.plans.clean import CLEAN_DATE_SQL
    return CLEAN_DATE_SQL.replace("date_str", col)


@query("text_prepare", f"""
WITH nw AS ({S.NEWS}),
rp AS (SELECT doc_id, {_fmt_sql('date', 'doc_id % 6')} AS s_str,
              {_fmt_sql("CAST(date + INTERVAL 6 DAY AS DATE)", '(doc_id + 1) % 6')} AS e_str, summary FROM nw),
mr AS (SELECT avg(CAST(nullif(summary, '') IS NULL AS DOUBLE)) * 100.0 AS missing_ratio FROM rp)
SELECT doc_id, {_clean_sql('s_str')} AS start_date, {_clean_sql('e_str')} AS end_date,
       coalesce(nullif(summary, ''), 'NA') AS final_sum, {r('missing_ratio')} AS missing_ratio FROM rp CROSS JOIN mr
""")
def q_text_prepare(spark, sf):
    """report dates in mixed formats -> multi-format parse with day-0 repair
    -> (start, end) span -> missing-text ratio -> 'NA' fill -> rename."""
    n = tb.news(spark, sf)
    rp = n.select("doc_id", _fmt(F.col("date"), F.col("doc_id") % 6).alias("s_str"),
                  _fmt(F.date_add("date", 6), (F.col("doc_id") + 1) % 6).alias("e_str"), "summary")
    mr = rp.agg((F.avg(F.nullif("summary", F.lit("")).isNull().cast("double")) * F.lit(100.0)).alias("missing_ratio"))
    out = rp.crossJoin(F.broadcast(mr)).select(
        "doc_id", cl.clean_date_multi("s_str").alias("start_date"), cl.clean_date_multi("e_str").alias("end_date"),
        cl.fill_text_null("summary", "NA").alias("summary"), "missing_ratio")
    return rounded(out.withColumnRenamed("summary", "final_sum"))
