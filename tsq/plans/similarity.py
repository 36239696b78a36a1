"""Queries: DTW family and ADF statistics.

Pairs are (sample, one random partner of the same class) or (sample, class
medoid); DTW kernels run per pair in Arrow-batched pandas UDFs.  The DTW
queries have no SQL oracle (tests compare them with a brute-force numpy
reference); ADF is exact SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tsq.operators import align as al
from tsq.operators import lagged
from tsq.operators import similarity as si
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rounded
from tsq.plans.windows import EVENTS_SQL, indexed_events
from tsq.sources import tables as tb

PARTNER_SEED = 3
SYM_WINDOW = 0.1  # band = ceil(L / 10), as the augmentations use


def pairs(spark, sf):
    """(vec_id, partner_id, x, y): every sample with one same-class partner."""
    e = tb.read(spark, sf, "embeddings").select("vec_id", "label")
    pr = al.pick_partner(e, "label", "vec_id", PARTNER_SEED)
    arr = tb.sequence_arrays(spark, sf)
    a = arr.select(F.col("sample_id").alias("vec_id"), F.col("x"))
    b = arr.select(F.col("sample_id").alias("partner_id"), F.col("x").alias("y"))
    return si.spread(pr.join(a, "vec_id").join(b, "partner_id"), "vec_id")


@query("dtw_distance")
def q_dtw_distance(spark, sf):
    """DTW value per pair: asymmetric slope, no band (the default) and
    symmetric slope with band ceil(L/10)."""
    p = pairs(spark, sf)
    return rounded(p.select("vec_id", "partner_id", si.dtw_udf("asymmetric")("x", "y").alias("dtw_asym"),
                            si.dtw_udf("symmetric", SYM_WINDOW)("x", "y").alias("dtw_sym")))


@query("dtw_path")
def q_dtw_path(spark, sf):
    """Alignment path per pair (symmetric, band ceil(L/10)), one row per step."""
    p = pairs(spark, sf)
    path = p.select("vec_id", "partner_id", si.dtw_path_udf("symmetric", SYM_WINDOW)("x", "y").alias("path"))
    return path.select("vec_id", "partner_id", F.posexplode("path").alias("step", "ij")) \
        .select("vec_id", "partner_id", "step", "ij.i", "ij.j")


@query("shape_dtw_distance")
def q_shape_dtw(spark, sf):
    """shapeDTW: DTW over edge-padded local descriptors (5 % of the length,
    clipped to [5, 100])."""
    p = pairs(spark, sf)
    return rounded(p.select("vec_id", "partner_id", si.shape_dtw_udf()("x", "y").alias("shape_dtw")))


@query("dtw_generic")
def q_dtw_generic(spark, sf):
    """DTW with a pluggable distance (Euclidean), one-step warp, no band,
    off-diagonal weight 1."""
    p = pairs(spark, sf)
    return rounded(p.select("vec_id", "partner_id", si.general_dtw_udf("euclidean")("x", "y").alias("dtw")))


@query("dtw_accelerated")
def q_dtw_fast(spark, sf):
    """Unbanded DTW over a vectorised pairwise cost matrix (city block)."""
    p = pairs(spark, sf)
    return rounded(p.select("vec_id", "partner_id", si.general_dtw_udf("cityblock")("x", "y").alias("dtw")))


@query("udf_distance")
def q_udf_distance(spark, sf):
    """The distance is a parameter of the DTW UDF (here Chebyshev, band 8,
    off-diagonal weight 1.5)."""
    p = pairs(spark, sf)
    return rounded(p.select("vec_id", "partner_id", si.general_dtw_udf("chebyshev", 1, 8, 1.5)("x", "y").alias("dtw")))


@query("dtw_to_medoid")
def q_dtw_to_medoid(spark, sf):
    """DTW of every sample to its class medoid (exact medoid under summed
    squared distance), one pair per sample."""
    from tsq.plans.misc import q_class_medoid
    med = q_class_medoid(spark, sf).select("label", "medoid_id")
    arr = tb.sequence_arrays(spark, sf)
    m = arr.join(med, "label")
    y = arr.select(F.col("sample_id").alias("medoid_id"), F.col("x").alias("y"))
    j = si.spread(m.join(y, "medoid_id"), "sample_id")
    return rounded(j.select(F.col("sample_id").alias("vec_id"), "label", "medoid_id",
                            si.dtw_udf("symmetric", SYM_WINDOW)("x", "y").alias("dtw")))


BATCH, BATCH_SEED = 6, 7


def batches(spark, sf):
    """A batch of up to 6 samples of each class with its distance matrix."""
    b = si.class_batches(tb.sequence_arrays(spark, sf), "label", "sample_id", "x", BATCH, BATCH_SEED)
    return b.withColumn("m", si.distances_udf(SYM_WINDOW)("xs"))


@query("dtw_matrix")
def q_dtw_matrix(spark, sf):
    """The DTW matrix of every class (symmetric step, band ceil(L/10)): all
    pairs of its samples, in tiles of two blocks of them."""
    return rounded(si.class_distances(tb.sequence_arrays(spark, sf), "label", "sample_id", "x", SYM_WINDOW))


@query("medoid")
def q_medoid(spark, sf):
    """Each class batch's medoid by DTW (rank 0) and the other members by
    their distance to it."""
    return rounded(si.nearest_order(batches(spark, sf), "label", "ids", "m").withColumnRenamed("ids", "sample_id"))


ADF_REL = f"""{EVENTS_SQL},
lg AS (SELECT series_id, lag(value) OVER w AS L, value - lag(value) OVER w AS Y,
              lag(value) OVER w - lag(value, 2) OVER w AS D FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY t))"""


@query("adf_stat", f"WITH {ADF_REL}, a AS ({si.adf_sql('lg', 'series_id')}) SELECT series_id, {r('adf')} AS adf, lag FROM a")
def q_adf(spark, sf):
    """Augmented Dickey-Fuller t statistic per series (constant, maxlag 1,
    lag chosen by AIC on the common sample, chosen model refitted)."""
    e = indexed_events(spark, sf)
    return rounded(si.adf_spark(e, "series_id", "t", "value"))


ADF_SEARCH_SQL = f"""
WITH RECURSIVE {EVENTS_SQL},
c AS (SELECT series_id, count(*) AS n, arg_min(value, t) AS x0 FROM ev GROUP BY 1),
p AS (SELECT *, greatest(least(CAST(ceil(12.0 * pow(n / 100.0, 0.25)) AS INTEGER), greatest((n - 1) // 2 - 1, 0) - 1), 0) AS p FROM c),
dy AS (SELECT series_id, t, lag(value) OVER w - x0 AS l, value - lag(value) OVER w AS y, n, p FROM ev JOIN p USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY t)),
df AS (SELECT *, list(y) OVER (PARTITION BY series_id ORDER BY t DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS past FROM dy WHERE y IS NOT NULL),
r1 AS (SELECT series_id, list_concat([1.0::DOUBLE, l], coalesce(past[1:p], []), [y]) AS v FROM df WHERE t >= p + 1),
g1 AS {S.gram('r1', 'series_id')},
s1 AS (
  SELECT series_id, 1 AS k, m, m AS g FROM g1
  UNION ALL
  SELECT series_id, k + 1, {S.SWEPT}, g FROM s1 WHERE k < len(m)),
best AS (
  SELECT s1.series_id, arg_min(s1.k - 3, (CASE WHEN m[-1][-1] <= 1e-12 * greatest(g[-1][-1], 1e-300) THEN -1e300
           ELSE round((p.n - p.p - 1) * ln(m[-1][-1] / (p.n - p.p - 1)) + 2 * (s1.k - 3), 9) END, s1.k)) AS lag
  FROM s1 JOIN p USING (series_id) WHERE s1.k >= 3 GROUP BY 1),
r2 AS (SELECT series_id, lag, list_concat([1.0::DOUBLE, l], coalesce(past[1:lag], []), [y]) AS v FROM df JOIN best USING (series_id) WHERE t >= lag + 1),
g2 AS {S.gram('r2', 'series_id')},
s2 AS (
  SELECT series_id, 1 AS k, m, m AS g FROM g2
  UNION ALL
  SELECT series_id, k + 1, {S.SWEPT}, g FROM s2 WHERE k < len(m)),
a AS (
  SELECT best.series_id, best.lag, CASE WHEN p.n - 1 - lag - (lag + 2) > 0 AND m[-1][-1] > 1e-12 * greatest(g[-1][-1], 1e-300) AND g[2][2] > 0 AND m[2][2] > 0
         THEN m[2][len(m)] / sqrt(m[-1][-1] / (p.n - 1 - lag - (lag + 2)) * m[2][2]) END AS adf
  FROM s2 JOIN best USING (series_id) JOIN p USING (series_id) WHERE k = len(m))"""


@query("adf_mean", f"""{ADF_SEARCH_SQL}
SELECT {r('avg(adf)')} AS adf_mean, {r('avg(CAST(lag AS DOUBLE)) FILTER (WHERE adf IS NOT NULL)')} AS lag_mean, count(adf) AS n FROM a
""")
def q_adf_mean(spark, sf):
    """Mean Dickey-Fuller statistic over all series, each with the number of
    lags that a search by AIC finds (default bound of lags for its length)."""
    a = lagged.adf_searched(indexed_events(spark, sf), "series_id", "t", "value")
    return rounded(a.agg(F.avg("adf").alias("adf_mean"), F.avg("lag").alias("lag_mean"), F.count("adf").alias("n")))


# ---------------------------------------------------------- SQL oracles
from tsq.functions import rng as _rng  # noqa: E402

PAIRS_SQL = f"""k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rk,
                  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
pp AS (SELECT *, (rk + 1 + floor({_rng.sql_uniform('label', 'vec_id', "'partner'", str(PARTNER_SEED))} * (n - 1))) % n AS pr FROM k WHERE n > 1),
ar AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
pairs AS (SELECT pp.vec_id AS a_id, o.vec_id AS b_id, xa.x AS x, xb.x AS y
          FROM pp JOIN k o ON o.label = pp.label AND o.rk = pp.pr JOIN ar xa ON xa.vec_id = pp.vec_id JOIN ar xb ON xb.vec_id = o.vec_id)"""

INF = "CAST('inf' AS DOUBLE)"


def dtw_sql(name: str, pairs: str, slope: str, band: str, cost: str | None = None, weight: float = 1.0) -> str:
    """Recursive CTE ``name``(a_id, b_id, i, row): row i of the accumulated
    cost (list index j+1 holds D[i, j]); ``band`` is an SQL expression of
    len(x)/len(y) giving the window."""
    w = band
    c = cost or "abs(p.x[d.i + 1] - p.y[j])"
    lo, hi = f"greatest(1, d.i + 1 - ({w}))", f"least(len(p.y), d.i + 1 + ({w}))"
    if slope == "symmetric" and weight != 1.0:
        # D_j = c_j + min(a_j, s D_{j-1}); with E_j = D_j / s^j the row is
        # E = C' + running min(a' - C'_prev) over the scaled costs
        sw = dbl(weight)
        step = f"""SELECT a_id, b_id, i + 1, [{INF}] || [CASE WHEN j BETWEEN lo AND hi THEN (cs[j] + list_min(list_slice(g, lo, j))) * pow({sw}, j) ELSE {INF} END
                        FOR j IN range(1, len(y) + 1)]
            FROM (SELECT *, [m[k] - (cs[k] - cc[k]) FOR k IN range(1, len(y) + 1)] AS g FROM (
              SELECT *, [CASE WHEN j BETWEEN lo AND hi THEN list_sum(list_slice(cc, lo, j)) ELSE 0.0 END FOR j IN range(1, len(y) + 1)] AS cs FROM (
                SELECT d.a_id, d.b_id, d.i, p.y, {lo} AS lo, {hi} AS hi,
                       [({c}) / pow({sw}, j) FOR j IN range(1, len(p.y) + 1)] AS cc,
                       [least(d.row[j], {sw} * d.row[j + 1]) / pow({sw}, j) FOR j IN range(1, len(p.y) + 1)] AS m
                FROM {name} d JOIN {pairs} p USING (a_id, b_id) WHERE d.i < len(p.x))))"""
    elif slope == "symmetric":
        step = f"""SELECT a_id, b_id, i + 1, [{INF}] || [CASE WHEN j BETWEEN lo AND hi THEN cs[j] + list_min(list_slice(g, lo, j)) ELSE {INF} END
                        FOR j IN range(1, len(y) + 1)]
            FROM (SELECT *, [m[k] - (cs[k] - cc[k]) FOR k IN range(1, len(y) + 1)] AS g FROM (
              SELECT *, [CASE WHEN j BETWEEN lo AND hi THEN list_sum(list_slice(cc, lo, j)) ELSE 0.0 END FOR j IN range(1, len(y) + 1)] AS cs FROM (
                SELECT d.a_id, d.b_id, d.i, p.y, {lo} AS lo, {hi} AS hi,
                       [{c} FOR j IN range(1, len(p.y) + 1)] AS cc,
                       [least(d.row[j], d.row[j + 1]) FOR j IN range(1, len(p.y) + 1)] AS m
                FROM {name} d JOIN {pairs} p USING (a_id, b_id) WHERE d.i < len(p.x))))"""
    else:
        step = f"""SELECT d.a_id, d.b_id, d.i + 1, [{INF}] || [CASE
                WHEN j = 1 THEN (CASE WHEN d.i + 1 <= ({w}) + 1 THEN {c} + least(d.row[1], d.row[2]) ELSE {INF} END)
                WHEN j BETWEEN greatest(2, d.i + 1 - ({w})) AND least(len(p.y), d.i + 1 + ({w}))
                  THEN {c} + least(d.row[j - 1], d.row[j], d.row[j + 1])
                ELSE {INF} END FOR j IN range(1, len(p.y) + 1)]
            FROM {name} d JOIN {pairs} p USING (a_id, b_id) WHERE d.i < len(p.x)"""
    base = f"SELECT a_id, b_id, 0, [0.0] || [{INF} FOR j IN range(1, len(y) + 1)] FROM {pairs}"
    return f"{name}(a_id, b_id, i, row) AS ({base} UNION ALL {step})"


def _final(name, pairs):
    return (f"SELECT d.a_id, d.b_id, d.row[len(p.y) + 1] AS v FROM {name} d JOIN {pairs} p USING (a_id, b_id) "
            f"WHERE d.i = len(p.x)")


SYM_BAND = "CAST(ceil(len(p.y) / 10.0) AS BIGINT)"
FULL_BAND = "len(p.y)"

ORACLE_DTW_DISTANCE = f"""WITH RECURSIVE {PAIRS_SQL},
{dtw_sql('da', 'pairs', 'asymmetric', FULL_BAND)}, {dtw_sql('ds', 'pairs', 'symmetric', SYM_BAND)},
fa AS ({_final('da', 'pairs')}), fs AS ({_final('ds', 'pairs')})
SELECT fa.a_id AS vec_id, fa.b_id AS partner_id, {r('fa.v')} AS dtw_asym, {r('fs.v')} AS dtw_sym
FROM fa JOIN fs USING (a_id, b_id)"""

ORACLE_DTW_FULL = f"""WITH RECURSIVE {PAIRS_SQL}, {dtw_sql('dg', 'pairs', 'symmetric', FULL_BAND)}, f AS ({_final('dg', 'pairs')})
SELECT a_id AS vec_id, b_id AS partner_id, {r('v')} AS dtw FROM f"""

from tsq.plans import sqlparts as S
from tsq.plans.registry import ORACLES as _ORACLES  # noqa: E402

_ORACLES["dtw_distance"] = ORACLE_DTW_DISTANCE
_ORACLES["dtw_generic"] = ORACLE_DTW_FULL
_ORACLES["dtw_accelerated"] = ORACLE_DTW_FULL

_ORACLES["dtw_to_medoid"] = f"""WITH RECURSIVE s AS (SELECT vec_id AS sample_id, label, CAST(u.pos - 1 AS INTEGER) AS t, CAST(u.v AS DOUBLE) AS value
   FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
c AS (SELECT label, t, avg(value) AS cv FROM s GROUP BY 1, 2),
dd AS (SELECT s.sample_id, s.label, sum((s.value - c.cv) * (s.value - c.cv)) AS d2 FROM s JOIN c USING (label, t) GROUP BY 1, 2),
med AS (SELECT label, arg_min(sample_id, (d2, sample_id)) AS medoid_id FROM dd GROUP BY label),
ar AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
mp AS (SELECT ar.vec_id AS a_id, med.medoid_id AS b_id, ar.label, ar.x, am.x AS y FROM ar JOIN med USING (label) JOIN ar am ON am.vec_id = med.medoid_id),
{dtw_sql('dm', 'mp', 'symmetric', SYM_BAND)}, f AS ({_final('dm', 'mp')})
SELECT f.a_id AS vec_id, mp.label, f.b_id AS medoid_id, {r('f.v')} AS dtw FROM f JOIN mp USING (a_id, b_id)"""


_CUT_SQL = f"""
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_rng.sql_uniform('label', 'vec_id', "'batch'", str(BATCH_SEED))}, vec_id) <= {BATCH}"""


def _matrix_sql(cut: str = "") -> str:
    return f"""WITH RECURSIVE bt AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings{cut}),
bp AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label, a.x, b.x AS y FROM bt a JOIN bt b ON a.label = b.label AND a.vec_id < b.vec_id),
{dtw_sql('db', 'bp', 'symmetric', SYM_BAND)}, bf AS ({_final('db', 'bp')}),
mx AS (SELECT bp.label, bf.a_id, bf.b_id, bf.v AS dtw FROM bf JOIN bp USING (a_id, b_id)
       UNION ALL SELECT bp.label, bf.b_id, bf.a_id, bf.v FROM bf JOIN bp USING (a_id, b_id)
       UNION ALL SELECT label, vec_id, vec_id, 0.0 FROM bt)"""


_ORACLES["dtw_matrix"] = f"""{_matrix_sql()} SELECT label, a_id, b_id, {r('dtw')} AS dtw FROM mx"""

_ORACLES["medoid"] = f"""{_matrix_sql(_CUT_SQL)},
best AS (SELECT label, arg_min(a_id, (round(total, 9), a_id)) AS medoid FROM (SELECT label, a_id, sum(dtw) AS total FROM mx GROUP BY ALL) GROUP BY label)
SELECT mx.label, CAST(row_number() OVER (PARTITION BY mx.label ORDER BY mx.b_id <> medoid, dtw, mx.b_id) - 1 AS INTEGER) AS rank,
       mx.b_id AS sample_id, {r('dtw')} AS distance FROM mx JOIN best ON best.label = mx.label AND best.medoid = mx.a_id"""


# shapeDTW: edge-padded descriptors of n = clip(round_half_even(0.05 L), 5, 100)
_SHAPE_PAIRS = f"""{PAIRS_SQL},
sz AS (SELECT a_id, b_id, x, y, CAST(greatest(5, least(100, round_even(len(x) * 0.05, 0))) AS BIGINT) AS n FROM pairs),
spairs AS (SELECT a_id, b_id, x, y, n,
  list_concat([x[1] FOR k IN range(0, CAST(ceil(n / 2.0) AS BIGINT))], x, [x[len(x)] FOR k IN range(0, n // 2)]) AS xp,
  list_concat([y[1] FOR k IN range(0, CAST(ceil(n / 2.0) AS BIGINT))], y, [y[len(y)] FOR k IN range(0, n // 2)]) AS yp FROM sz)"""
_SHAPE_COST = "sqrt(list_sum([(p.xp[d.i + 1 + kk] - p.yp[j + kk]) * (p.xp[d.i + 1 + kk] - p.yp[j + kk]) FOR kk IN range(0, p.n)]))"

_ORACLES["shape_dtw_distance"] = f"""WITH RECURSIVE {_SHAPE_PAIRS},
{dtw_sql('dsh', 'spairs', 'asymmetric', FULL_BAND, cost=_SHAPE_COST)}, f AS ({_final('dsh', 'spairs')})
SELECT a_id AS vec_id, b_id AS partner_id, {r('v')} AS shape_dtw FROM f"""

_ORACLES["udf_distance"] = f"""WITH RECURSIVE {PAIRS_SQL},
{dtw_sql('du', 'pairs', 'symmetric', '8', weight=1.5)}, f AS ({_final('du', 'pairs')})
SELECT a_id AS vec_id, b_id AS partner_id, {r('v')} AS dtw FROM f"""

# alignment path: walk back from (P, S) through the stored accumulated rows,
# choosing the first minimum of (diagonal, up, left) as argmin does
_ORACLES["dtw_path"] = f"""WITH RECURSIVE {PAIRS_SQL},
{dtw_sql('dp', 'pairs', 'symmetric', SYM_BAND)},
fin AS (SELECT a_id, b_id, len(x) AS P, len(y) AS S FROM pairs),
tb(a_id, b_id, n, i, j) AS (
  SELECT a_id, b_id, 0, P, S FROM fin
  UNION ALL
  SELECT t.a_id, t.b_id, t.n + 1,
         CASE WHEN c.k = 0 THEN t.i - 1 WHEN c.k = 1 THEN t.i - 1 ELSE t.i END,
         CASE WHEN c.k = 0 THEN t.j - 1 WHEN c.k = 1 THEN t.j ELSE t.j - 1 END
  FROM tb t JOIN dp r1 ON r1.a_id = t.a_id AND r1.b_id = t.b_id AND r1.i = t.i - 1
       JOIN dp r0 ON r0.a_id = t.a_id AND r0.b_id = t.b_id AND r0.i = t.i,
  LATERAL (SELECT CASE WHEN r1.row[t.j] <= r1.row[t.j + 1] AND r1.row[t.j] <= r0.row[t.j] THEN 0
                       WHEN r1.row[t.j + 1] <= r0.row[t.j] THEN 1 ELSE 2 END AS k) c
  WHERE t.i > 1 OR t.j > 1),
st AS (SELECT a_id, b_id, n, i, j, max(n) OVER (PARTITION BY a_id, b_id) AS nmax FROM tb)
SELECT a_id AS vec_id, b_id AS partner_id, CAST(nmax - n AS INTEGER) AS step, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j FROM st"""
