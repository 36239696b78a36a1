"""Queries: the UDF / UDAF surface and model-based forecasters
(SURVEY §2.11; dmd_forecast and ets_compose_forecast of §2.8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators import clean as cl
from tsq.operators import features as fe
from tsq.operators import metrics as me
from tsq.operators import similarity as si
from tsq.operators import spectral as sp
from tsq.operators import windows as wo
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rounded
from tsq.session import materialize
from tsq.sources import tables as tb


def apply_per_series(df, key: str, fn, schema: str):
    """User pandas callable per series group (groupBy.applyInPandas); use
    on bounded groups (samples / windows), not on whole long series."""
    return df.groupBy(key).applyInPandas(fn, schema=schema)


def _minmax(pdf: pd.DataFrame) -> pd.DataFrame:
    v = pdf["value"].astype(float)
    z = (v - v.min()) / (v.max() - v.min() + me.FLOAT_EPS)
    return pd.DataFrame({"sample_id": pdf["sample_id"], "t": pdf["t"], "z": z})


@query("udf_series_apply", f"""
WITH s AS ({S.SEQUENCES}), st AS (SELECT sample_id, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1)
SELECT sample_id, t, {r(f'(value - lo) / (hi - lo + {dbl(me.FLOAT_EPS)})')} AS z FROM s JOIN st USING (sample_id)
""")
def q_udf_series_apply(spark, sf):
    """A pandas callable applied per sample (per-sample min-max) through
    groupBy.applyInPandas; each group is one bounded sample."""
    s = tb.sequences(spark, sf).select("sample_id", "t", "value")
    return rounded(apply_per_series(s, "sample_id", _minmax, "sample_id long, t int, z double"))


def batch_predict(df, model_factory, in_col: str, out_schema: str, keep: list[str]):
    """Arrow-batched inference: the model is built once per task and
    applied to every batch of the partition (mapInPandas)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in it:
            X = np.stack([np.asarray(v, dtype=float) for v in pdf[in_col]]) if len(pdf) else np.zeros((0, 1))
            out = pdf[keep].copy()
            for k, v in model(X).items():
                out[k] = v
            yield out
    return df.mapInPandas(run, schema=out_schema)


@query("batch_inference", f"""
WITH s AS ({S.SEQUENCES}), c AS (SELECT label, t, avg(value) AS cv FROM s GROUP BY 1, 2),
sc AS (SELECT s.sample_id, c.label AS cls, sum((s.value - c.cv) * (s.value - c.cv)) AS d2 FROM s JOIN c USING (t) GROUP BY 1, 2),
m AS (SELECT sample_id, min(d2) AS md FROM sc GROUP BY 1)
SELECT sample_id, min(CASE WHEN d2 = md THEN cls END) AS pred_class FROM sc JOIN m USING (sample_id) GROUP BY sample_id
""")
def q_batch_inference(spark, sf):
    """A nearest-centroid model (one row per class: a table bounded by the
    class count) built once per task and applied to Arrow batches."""
    s = tb.sequences(spark, sf)
    cen = s.groupBy("label", "t").agg(F.avg("value").alias("cv"))
    rows = sorted(cen.collect(), key=lambda x: (x["label"], x["t"]))  # classes x dims, bounded
    labels = sorted({x["label"] for x in rows})
    C = np.array([[x["cv"] for x in rows if x["label"] == lb] for lb in labels])
    lab = np.array(labels)

    def factory():
        def model(X):
            d2 = ((X[:, None, :] - C[None, :, :]) ** 2).sum(-1)
            return {"pred_class": lab[np.argmin(d2, axis=1)].astype("int32")}
        return model

    arr = si.spread(si.sample_arrays(s, "sample_id", "t", "value"), "sample_id")
    return batch_predict(arr, factory, "x", "sample_id long, pred_class int", ["sample_id"])


TEXT_DIMS = 64


@query("text_vectorizer", f"""
WITH tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda s: s <> '') AS toks FROM documents),
h AS (SELECT doc_id, len(toks) AS n, CAST(('0x' || substr(md5(u.tok), 1, 8)) AS UBIGINT) AS h FROM tk, unnest(toks) AS u(tok))
SELECT doc_id, CAST(h % {TEXT_DIMS} AS INTEGER) AS dim,
       {r(f'sum(CASE WHEN (h // {TEXT_DIMS}) % 2 = 0 THEN 1.0 ELSE -1.0 END) / max(n)')} AS value
FROM h GROUP BY doc_id, h % {TEXT_DIMS}
""")
def q_text_vectorizer(spark, sf):
    """Document vectors by signed feature hashing of all word tokens (the
    hash gives place and sign), divided by the number of tokens.  Needs no
    vocabulary, so nothing is held on the driver or broadcast."""
    tokens = cl.tokenize_truncate("text", None)
    d = tb.read(spark, sf, "documents").select("doc_id", tokens.alias("toks")) \
        .select("doc_id", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    d = d.withColumn("h", F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("long"))
    sign = F.when(F.shiftright("h", TEXT_DIMS.bit_length() - 1) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    v = d.groupBy("doc_id", (F.col("h") % TEXT_DIMS).cast("int").alias("dim")).agg((F.sum(sign) / F.max("n")).alias("value"))
    return rounded(v)


SEG, DMD_STEPS = 8, 2


def dmd_kernel(x: np.ndarray) -> np.ndarray:
    """Cut the window into segments (front-padded with its own tail),
    least-squares one-step operator K between consecutive segments, roll
    forward; a non-finite K falls back to the identity."""
    L = len(x)
    pad = (-L) % SEG
    xs = np.concatenate((x[L - pad:], x)) if pad else x
    segs = xs.reshape(-1, SEG)
    X, Y = segs[:-1], segs[1:]
    K = np.linalg.lstsq(X, Y, rcond=None)[0]
    if not np.all(np.isfinite(K)):
        K = np.eye(SEG)
    out, cur = [], segs[-1]
    for _ in range(DMD_STEPS):
        cur = cur @ K
        out.append(cur)
    return np.concatenate(out)


@query("dmd_forecast")
def q_dmd(spark, sf):
    """DMD-style linear forecast of 2 segments (16 points) per sample."""
    arr = si.spread(tb.sequence_arrays(spark, sf), "sample_id")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def f(x: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, dmd_kernel(np.asarray(v, dtype=float)))) for v in x])

    out = arr.select("sample_id", F.posexplode(f("x")).alias("h0", "value"))
    return rounded(out.select("sample_id", (F.col("h0") + 1).alias("h"), "value"))


ETS_K, ETS_H, ALPHA, BETA, PHI = 3, 16, 0.5, 0.5, 0.9


def _ets_sql():
    from tsq.plans.spectral import SPEC_SQL, _idft_sql
    a, b = dbl(ALPHA), dbl(BETA)
    ra, rb = dbl(1.0 - ALPHA), dbl(1.0 - BETA)
    return f"""
WITH RECURSIVE {SPEC_SQL},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amp DESC, k) AS rk FROM sa
        WHERE k > 0 AND NOT (L % 2 = 0 AND k * 2 = L)) WHERE rk <= {ETS_K}),
tg AS (SELECT ln.sample_id, tt.t FROM ln CROSS JOIN unnest(range(0, ln.L + {ETS_H})) AS tt(t)),
se AS ({_idft_sql('top', 'tg', 'season')}),
dd AS (SELECT s.sample_id, s.t, s.value - se.season AS d FROM s JOIN se USING (sample_id, t)),
lv(sample_id, t, level) AS (SELECT sample_id, t, d FROM dd WHERE t = 0
   UNION ALL SELECT dd.sample_id, dd.t, {ra} * lv.level + {a} * dd.d FROM lv JOIN dd ON dd.sample_id = lv.sample_id AND dd.t = lv.t + 1),
gr AS (SELECT x.sample_id, x.t - 1 AS t, x.level - y.level AS g FROM lv x JOIN lv y ON y.sample_id = x.sample_id AND y.t = x.t - 1),
gs(sample_id, t, growth) AS (SELECT sample_id, t, g FROM gr WHERE t = 0
   UNION ALL SELECT gr.sample_id, gr.t, {rb} * gs.growth + {b} * gr.g FROM gs JOIN gr ON gr.sample_id = gs.sample_id AND gr.t = gs.t + 1),
last AS (SELECT ln.sample_id, ln.L, lv.level, gs.growth FROM ln JOIN lv ON lv.sample_id = ln.sample_id AND lv.t = ln.L - 1
         JOIN gs ON gs.sample_id = ln.sample_id AND gs.t = ln.L - 2)
SELECT last.sample_id, CAST(hh.h AS INTEGER) AS h,
       {r(f"level + growth * ({dbl(PHI)} * (1.0 - pow({dbl(PHI)}, hh.h)) / {dbl(1.0 - PHI)}) + se.season")} AS y_hat
FROM last CROSS JOIN range(1, {ETS_H + 1}) hh(h) JOIN se ON se.sample_id = last.sample_id AND se.t = last.L - 1 + hh.h
"""


@query("ets_compose_forecast", _ets_sql())
def q_ets(spark, sf):
    """Level + damped growth + extrapolated season: season = top-3 Fourier
    terms continued past the window; exponential smoothing of the
    de-seasonalised level and of its first differences; forecast
    h = level_last + growth_last * sum_{j<=h} phi^j + season(L-1+h)."""
    s = tb.sequences(spark, sf).select("sample_id", "t", "value")
    spec = sp.dft(s, "sample_id", "t", "value")
    top = sp.rank_freqs(spec, "sample_id", ETS_K, skip_nyquist=True)
    n = s.groupBy("sample_id").agg(F.count(F.lit(1)).alias("L"))
    grid = n.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("L") + F.lit(ETS_H - 1))).alias("t"))
    # the spectrum and the smoothing are read several times below
    season = materialize(sp.idft(top, grid, "sample_id", "t", "season"), "season")
    d = s.join(season.hint("merge"), ["sample_id", "t"]).withColumn("d", F.col("value") - F.col("season"))
    lv = materialize(wo.smoothing(d, "sample_id", "t", "d", 1.0 - ALPHA, out="level"), "level")
    gr = fe.with_features(lv, "sample_id", "t", lambda w: [fe.first_diff("level", w).alias("g")], back=1)
    gr = gr.filter(F.col("g").isNotNull()).withColumn("t1", F.col("t") - 1)
    gs = wo.smoothing(gr.drop("t").withColumnRenamed("t1", "t"), "sample_id", "t", "g", 1.0 - BETA, out="growth")
    last_l = lv.join(n, "sample_id").filter(F.col("t") == F.col("L") - 1).select("sample_id", "L", "level")
    last_g = gs.join(n, "sample_id").filter(F.col("t") == F.col("L") - 2).select("sample_id", "growth")
    f = last_l.join(last_g, "sample_id").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(ETS_H))))
    f = f.withColumn("_st", F.col("L") - 1 + F.col("h"))
    f = f.join(season.select("sample_id", F.col("t").alias("_st"), "season").hint("merge"), ["sample_id", "_st"])
    damp = F.lit(PHI) * (F.lit(1.0) - F.pow(F.lit(PHI), F.col("h"))) / F.lit(1.0 - PHI)
    return rounded(f.select("sample_id", "h", (F.col("level") + F.col("growth") * damp + F.col("season")).alias("y_hat")))
