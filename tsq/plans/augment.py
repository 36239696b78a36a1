"""Queries: seeded augmentation.

Relational augmentations have SQL twins built from the same parameters
and the same hash random numbers; spline and DTW-guided warps run per
sample / per pair in pandas UDFs (rows-only check, numpy tests).
"""

from __future__ import annotations

from tsq.functions import rng
from tsq.operators import augment as au
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rounded
from tsq.sources import tables as tb

SEED = 2021
N_ROUNDS = 2
D = str(au.DIM)


def _seq(spark, sf):
    return tb.sequences(spark, sf).select(*au.COLS)


def _out(df):
    return rounded(df.select(*[c for c in df.columns]))


# ---- SQL twins: each returns a SELECT over relation `src` ----
def sql_jitter(src, sigma=0.03, seed=0):
    z = rng.sql_normal("sample_id", D, "t", "'jitter'", str(seed), sd=sigma)
    return f"SELECT sample_id, label, t, value + {z} AS value FROM {src}"


def sql_scaling(src, sigma=0.1, seed=0):
    f = rng.sql_normal("sample_id", D, "'scaling'", str(seed), mean=1.0, sd=sigma)
    return f"SELECT sample_id, label, t, value * {f} AS value FROM {src}"


def sql_rotation(src, seed=0):
    u = rng.sql_uniform("sample_id", D, "'flip'", str(seed))
    return f"SELECT sample_id, label, t, value * (CASE WHEN {u} < 0.5 THEN -1.0 ELSE 1.0 END) AS value FROM {src}"


def sql_permutation(src, max_segments=5, seed=0):
    u = rng.sql_uniform("sample_id", "'nseg'", str(seed))
    up = rng.sql_uniform("sample_id", "_seg", "'perm'", str(seed))
    return f"""SELECT sample_id, label, CAST(_off + _pos AS INTEGER) AS t, value FROM (
  WITH a AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS L,
                    CAST(1 + floor({u} * {max_segments - 1}) AS BIGINT) AS _n FROM {src}),
  b AS (SELECT *, L // _n AS q, L % _n AS r FROM a),
  c AS (SELECT *, CAST(CASE WHEN t < r * (q + 1) THEN floor(t / (q + 1)) ELSE r + floor((t - r * (q + 1)) / q) END AS BIGINT) AS _seg FROM b),
  d AS (SELECT *, t - CASE WHEN _seg < r THEN _seg * (q + 1) ELSE r * (q + 1) + (_seg - r) * q END AS _pos FROM c),
  sg AS (SELECT DISTINCT sample_id, _seg, q + CASE WHEN _seg < r THEN 1 ELSE 0 END AS _size FROM d),
  so AS (SELECT sample_id, _seg, coalesce(sum(_size) OVER (PARTITION BY sample_id ORDER BY {up}, _seg
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off FROM sg)
  SELECT d.*, so._off FROM d JOIN so USING (sample_id, _seg))"""


def sql_window_slice(src, ratio=0.9, seed=0):
    u = rng.sql_uniform("sample_id", "'slice'", str(seed))
    return f"""SELECT * FROM (
  WITH n AS (SELECT sample_id, any_value(label) AS label, count(*) AS L FROM {src} GROUP BY 1),
  m AS (SELECT *, CAST(ceil({dbl(ratio)} * L) AS BIGINT) AS _tg FROM n),
  s AS (SELECT *, CAST(floor({u} * (L - _tg)) AS BIGINT) AS _st FROM m),
  o AS (SELECT s.*, kk.k, CASE WHEN kk.k = L - 1 THEN CAST(_tg AS DOUBLE) ELSE CAST(kk.k AS DOUBLE) * (CAST(_tg AS DOUBLE) / CAST(L - 1 AS DOUBLE)) END AS _p
        FROM s CROSS JOIN unnest(range(0, L)) AS kk(k) WHERE _tg < L),
  o2 AS (SELECT *, CAST(least(floor(_p), _tg - 1) AS BIGINT) AS _lo FROM o),
  v AS (SELECT o2.sample_id, o2.label, CAST(o2.k AS INTEGER) AS t,
               CASE WHEN _p < CAST(_tg - 1 AS DOUBLE) THEN a.value + (b.value - a.value) / 1.0 * (_p - _lo) ELSE a.value END AS value
        FROM o2 JOIN {src} a ON a.sample_id = o2.sample_id AND a.t = o2._st + o2._lo
        LEFT JOIN {src} b ON b.sample_id = o2.sample_id AND b.t = o2._st + o2._lo + 1)
  SELECT * FROM v
  UNION ALL SELECT x.sample_id, x.label, x.t, x.value FROM {src} x JOIN m ON m.sample_id = x.sample_id WHERE m._tg >= m.L)"""


def sql_shift(src, sigma=0.2, seed=0):
    sc = rng.sql_normal(D, "'tscale'", str(seed), mean=1.0, sd=sigma)
    sh = rng.sql_normal(D, "'tshift'", str(seed), sd=sigma)
    jt = rng.sql_normal("sample_id", D, "t", "'tjitter'", str(seed), sd=sigma)
    return f"SELECT sample_id, label, t, value * {sc} + {sh} + {jt} AS value FROM {src}"


SQL_OPS = {"jitter": sql_jitter, "scaling": sql_scaling, "rotation": sql_rotation,
           "permutation": sql_permutation, "windowslice": sql_window_slice}


def _final(rel, extra=""):
    return f"SELECT sample_id, label, t, {r('value')} AS value{extra} FROM {rel}"


def _single(name, spark_op, sql_op):
    sql = f"WITH s0 AS ({S.SEQUENCES}), s1 AS ({sql_op('s0', seed=SEED)}) {_final('s1')}"

    def fn(spark, sf):
        return rounded(spark_op(_seq(spark, sf), seed=SEED).select(*au.COLS))
    query(name, sql)(fn)


_single("aug_jitter", au.jitter, sql_jitter)
_single("aug_scaling", au.scaling, sql_scaling)
_single("aug_rotation", au.rotation, sql_rotation)
_single("aug_permutation", au.permutation, sql_permutation)
_single("aug_window_slice", au.window_slice, sql_window_slice)
_single("aug_shift", au.shift_transform, sql_shift)

ENABLED = ["jitter", "scaling", "permutation", "windowslice"]


def _rounds_sql(enabled, n_rounds):
    ctes = [f"s0 AS ({S.SEQUENCES})"]
    parts = ["SELECT sample_id, label, t, value, 0 AS round, '' AS tag FROM s0"]
    for rd in range(1, n_rounds + 1):
        seed = SEED * 1000 + rd
        prev, tag = "s0", ""
        for i, name in enumerate([n for n in au.PIPELINE_ORDER if n in enabled]):
            cur = f"r{rd}_{i}"
            ctes.append(f"{cur} AS ({SQL_OPS[name](prev, seed=seed)})")
            prev, tag = cur, tag + au.TAGS[name]
        parts.append(f"SELECT sample_id, label, t, value, {rd} AS round, '{n_rounds}{tag}' AS tag FROM {prev}")
    return ctes, parts


def _rounds_query(name, enabled, n_rounds, last_only=False):
    ctes, parts = _rounds_sql(enabled, n_rounds)
    body = parts[-1] if last_only else " UNION ALL ".join(parts)
    sql = f"WITH {', '.join(ctes)}, u AS ({body}) SELECT sample_id, label, t, {r('value')} AS value, round, tag FROM u"

    def fn(spark, sf):
        out = au.rounds(_seq(spark, sf), enabled, n_rounds, SEED)
        if last_only:
            from pyspark.sql import functions as F
            out = out.filter(F.col("round") == n_rounds)
        return rounded(out)
    query(name, sql)(fn)


# enabled switches applied in the fixed order, N rounds appended to the data
_rounds_query("aug_pipeline", ENABLED, N_ROUNDS)
# per-sample variant: every round restarts from the original; the last wins
_rounds_query("aug_single", ENABLED, N_ROUNDS, last_only=True)
# original rows plus N jittered rounds, labels carried along
_rounds_query("union_augmented", ["jitter"], N_ROUNDS)
