"""Queries: spline and DTW-guided augmentations, all samples
of an Arrow batch in one kernel call, and switches on several channels.  Random draws are hashes
of the sample key computed in Spark and passed in, so results do not
depend on partitioning.  Rows-only checks; numpy tests in tests/."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tsq.functions import rng
from tsq.operators import augment as au
from tsq.operators import multichannel as mc
from tsq.operators import similarity as si
from tsq.plans.registry import query, r, rounded
from tsq.sources import tables as tb

SEED = 2021
KNOTS = mc.KNOTS


def _samples(spark, sf):
    return si.spread(mc.one_channel(tb.sequence_arrays(spark, sf)), "sample_id")


def _single(name, switch, doc):
    """Query of one kernel switch over samples of one channel."""
    def fn(spark, sf):
        return rounded(mc.long_form(switch(_samples(spark, sf), SEED), channel=False))
    fn.__doc__ = doc
    query(name)(fn)


_single("aug_magnitude_warp", mc.magnitude_warp, "x times a not-a-knot cubic spline through knot+2 values ~ N(1, 0.2).")
_single("aug_time_warp", mc.time_warp, "Resample along a random smooth time map (spline through knots).")
_single("aug_window_warp", mc.window_warp, "A 10 % window stretched x2 or squeezed x0.5, resampled to length.")
_single("aug_spawner", mc.spawner, """Average with a same-class partner along the DTW paths of two halves split
at a random point, then jitter (sigma 0.05).  No partner: the sample itself, jittered.""")
_single("aug_guided_warp", mc.guided_warp, "Warp onto a random same-class prototype by DTW (symmetric, band L/10).")
_single("aug_guided_warp_shape", lambda d, s: mc.guided_warp(d, s, True), "As aug_guided_warp with the shapeDTW path.")
_single("aug_wdba", mc.wdba, "Weighted DTW barycentre of a batch of up to 6 same-class samples (hash-random batch per sample).")
_single("aug_discriminative_warp", mc.discriminative_warp, """Prototype maximising (negative - positive) mean DTW among 3 positive and 3
negative candidates, warp, then a slice of 90-100 % by the warp amount relative to the largest one.""")
_single("aug_discriminative_warp_shape", lambda d, s: mc.discriminative_warp(d, s, True), "The same with shapeDTW.")

# three channels of a sample: its first, second and third run of 20 values
WIDE, RUN = 3, 20


def wide_samples(spark, sf):
    s = tb.sequence_arrays(spark, sf)
    return si.spread(s.select("sample_id", "label", F.array(*[F.slice("x", d * RUN + 1, RUN) for d in range(WIDE)]).alias("x")), "sample_id")


_WIDE_SQL = f"""w AS (SELECT vec_id AS sample_id, label, d.d AS channel, CAST(u.pos - 1 AS INTEGER) AS t, CAST(u.v AS DOUBLE) AS value
  FROM embeddings, range(0, {WIDE}) d(d), unnest(embedding[d.d * {RUN} + 1:(d.d + 1) * {RUN}]) WITH ORDINALITY AS u(v, pos))"""


@query("aug_rotation_channels", f"""
WITH {_WIDE_SQL},
ax AS (SELECT d, row_number() OVER (ORDER BY {rng.sql_uniform('d', "'axis'", str(SEED))}, d) - 1 AS channel FROM range(0, {WIDE}) r(d))
SELECT sample_id, label, CAST(ax.channel AS INTEGER) AS channel, t,
       {r(f"value * (CASE WHEN {rng.sql_uniform('sample_id', 'ax.channel', "'flip'", str(SEED))} < 0.5 THEN -1.0 ELSE 1.0 END)")} AS value
FROM w JOIN ax ON ax.d = w.channel
""")
def q_rotation_channels(spark, sf):
    """Sign flips per (sample, channel) and one shuffle of the channels for
    all samples, on samples of three channels."""
    return rounded(mc.long_form(mc.rotation(wide_samples(spark, sf), SEED)))


@query("aug_random_permutation", f"""
WITH {_WIDE_SQL},
n AS (SELECT DISTINCT sample_id, CAST(1 + floor({rng.sql_uniform('sample_id', "'nseg'", str(SEED))} * 4) AS BIGINT) AS m FROM w),
p AS (SELECT sample_id, m, i, row_number() OVER (PARTITION BY sample_id ORDER BY {rng.sql_uniform('sample_id', 'i', "'cut'", str(SEED))}, i) AS rk
      FROM n, range(0, {RUN - 2}) r(i)),
cut AS (SELECT sample_id, list_concat([0], coalesce(list(i ORDER BY i) FILTER (WHERE rk < m), []), [{RUN}]) AS pts FROM p GROUP BY 1),
sg AS (SELECT sample_id, k, pts[k + 1] AS a, pts[k + 2] AS b FROM cut, unnest(range(0, len(pts) - 1)) x(k)),
so AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY sample_id ORDER BY {rng.sql_uniform('sample_id', 'k', "'perm'", str(SEED))}, k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM sg)
SELECT w.sample_id, w.label, CAST(w.channel AS INTEGER) AS channel, CAST(so.shift + w.t - so.a AS INTEGER) AS t, {r('w.value')} AS value
FROM w JOIN so ON so.sample_id = w.sample_id AND w.t >= so.a AND w.t < so.b
""")
def q_random_permutation(spark, sf):
    """Segments cut at random points in a hash order, the same for all three
    channels of a sample."""
    return rounded(mc.long_form(mc.permutation(wide_samples(spark, sf), SEED, random_points=True)))


@query("aug_pipeline_all")
def q_pipeline_all(spark, sf):
    """All fifteen switches one after the other on samples of three channels
    (no SQL: every switch is tested against plain numpy)."""
    out, tag = mc.pipeline(wide_samples(spark, sf), au.PIPELINE_ORDER, SEED)
    return rounded(mc.long_form(out).withColumn("tag", F.lit(tag)))


def _window_warp_sql() -> str:
    """SQL twin of the window warp: both np.interp calls on regular grids."""
    from tsq.plans.registry import ORACLES, dbl, r
    u1 = rng.sql_uniform("sample_id", "'wwstart'", str(SEED))
    u2 = rng.sql_uniform("sample_id", "'wwscale'", str(SEED))
    return f"""
WITH s AS (SELECT vec_id AS sample_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
a AS (SELECT *, len(x) AS L, CAST(ceil({dbl(0.1)} * len(x)) AS BIGINT) AS ws FROM s),
b AS (SELECT *, CAST(1 + floor({u1} * (L - ws - 2)) AS BIGINT) AS st,
             CASE WHEN {u2} < 0.5 THEN {dbl(0.5)} ELSE {dbl(2.0)} END AS sc FROM a),
c AS (SELECT *, CAST(floor(ws * sc) AS BIGINT) AS nw FROM b),
d AS (SELECT *, CAST(ws - 1 AS DOUBLE) / CAST(nw - 1 AS DOUBLE) AS qs FROM c),
e AS (SELECT *, list_concat(list_slice(x, 1, st),
        [CASE WHEN k = nw - 1 THEN x[st + ws] ELSE
           x[st + 1 + CAST(floor(k * qs) AS BIGINT)] + (x[st + 2 + CAST(floor(k * qs) AS BIGINT)] - x[st + 1 + CAST(floor(k * qs) AS BIGINT)])
             / 1.0 * (k * qs - floor(k * qs)) END FOR k IN range(0, nw)],
        list_slice(x, st + ws + 1, L)) AS wp FROM d),
f AS (SELECT *, len(wp) AS M, CAST(L - 1 AS DOUBLE) / CAST(len(wp) - 1 AS DOUBLE) AS gs FROM e),
g AS (SELECT sample_id, label, st, sc, L, M, gs, wp, unnest(range(0, L)) AS t FROM f),
h AS (SELECT *, least(CAST(floor(t / gs) AS BIGINT), M - 2) AS jj FROM g)
SELECT sample_id, label, CAST(t AS INTEGER) AS t,
       {r("CASE WHEN t = L - 1 THEN wp[M] ELSE wp[jj + 1] + (wp[jj + 2] - wp[jj + 1]) / (CASE WHEN jj + 1 = M - 1 THEN CAST(L - 1 AS DOUBLE) ELSE (jj + 1) * gs END - jj * gs) * (t - jj * gs) END")} AS value
FROM h"""


from tsq.plans.registry import ORACLES as _OR  # noqa: E402

_OR["aug_window_warp"] = _window_warp_sql()


def _magwarp_sql() -> str:
    """SQL twin of the magnitude warp.  The knots are equally spaced, so the
    not-a-knot system is h * A0 with a constant A0: the knot second
    derivatives are m = 6/h^2 * inv(A0) @ (0, second differences, 0)."""
    from tsq.plans.registry import dbl, r
    n = KNOTS + 2
    A0 = np.zeros((n, n))
    A0[0, :3] = [1.0, -2.0, 1.0]
    A0[-1, -3:] = [1.0, -2.0, 1.0]
    for i in range(1, n - 1):
        A0[i, i - 1:i + 2] = [1.0, 4.0, 1.0]
    inv = np.linalg.inv(A0)
    ys = [rng.sql_normal("sample_id", str(au.DIM), str(j), "'magwarp'", str(SEED), mean=1.0, sd=0.2) for j in range(n)]
    d2 = {rr: f"(y{rr + 1} - 2.0 * y{rr} + y{rr - 1})" for rr in range(1, n - 1)}
    ms = [" + ".join(f"{dbl(inv[k, rr])} * {d2[rr]}" for rr in range(1, n - 1)) for k in range(n)]
    seg_y = lambda off: "CASE " + " ".join(f"WHEN sg = {k} THEN y{k + off}" for k in range(n - 1)) + " END"
    seg_m = lambda off: "CASE " + " ".join(f"WHEN sg = {k} THEN m{k + off}" for k in range(n - 1)) + " END"
    return f"""
WITH s AS (SELECT vec_id AS sample_id, label, CAST(u.pos - 1 AS INTEGER) AS t, CAST(u.v AS DOUBLE) AS value, len(embedding) AS L
           FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
k AS (SELECT sample_id, any_value(L) AS L, {', '.join(f'{ys[j]} AS y{j}' for j in range(n))} FROM s GROUP BY sample_id),
h AS (SELECT *, CAST(L - 1 AS DOUBLE) / {float(n - 1)!r} AS hh FROM k),
m AS (SELECT *, {', '.join(f'(6.0 / (hh * hh)) * ({ms[j]}) AS m{j}' for j in range(n))} FROM h),
e AS (SELECT s.sample_id, s.label, s.t, s.value, m.*, least(CAST(floor(s.t / m.hh) AS BIGINT), {n - 2}) AS sg
      FROM s JOIN m USING (sample_id)),
f AS (SELECT *, ((sg + 1) * hh - t) / hh AS a, (t - sg * hh) / hh AS c FROM e)
SELECT sample_id, label, t,
       {r(f"value * (a * ({seg_y(0)}) + c * ({seg_y(1)}) + ((a * a * a - a) * ({seg_m(0)}) + (c * c * c - c) * ({seg_m(1)})) * hh * hh / 6.0)")} AS value
FROM f"""


_OR["aug_magnitude_warp"] = _magwarp_sql()


def _guided_sql(shape: bool) -> str:
    """SQL twin of the guided warp: DTW(prototype, sample) rows (symmetric,
    band ceil(L/10)), traceback, warped = sample[path], then np.interp onto
    L points."""
    from tsq.plans import similarity as sq
    from tsq.plans.registry import r
    band = "CAST(ceil(len(p.y) / 10.0) AS BIGINT)"
    if shape:
        pairs = f"""gp AS (SELECT sample_id AS a_id, proto AS x, pat AS y, label,
            CAST(greatest(5, least(100, round_even(len(pat) * 0.05, 0))) AS BIGINT) AS n FROM gx),
          gq AS (SELECT *, list_concat([x[1] FOR k IN range(0, CAST(ceil(n / 2.0) AS BIGINT))], x, [x[len(x)] FOR k IN range(0, n // 2)]) AS xp,
                 list_concat([y[1] FOR k IN range(0, CAST(ceil(n / 2.0) AS BIGINT))], y, [y[len(y)] FOR k IN range(0, n // 2)]) AS yp,
                 0 AS b_id FROM gp)"""
        rel, cost = "gq", ("sqrt(list_sum([(p.xp[d.i + 1 + kk] - p.yp[j + kk]) * (p.xp[d.i + 1 + kk] - p.yp[j + kk]) "
                            "FOR kk IN range(0, p.n)]))")
        # shape DTW band is end-exclusive: |j - i| < w on the low side too
        dtw = sq.dtw_sql("dg", rel, "symmetric", band, cost=cost)
        dtw = dtw.replace("least(len(p.y), d.i + 1 + (", "least(len(p.y), d.i + (")
    else:
        pairs = "gq AS (SELECT sample_id AS a_id, 0 AS b_id, proto AS x, pat AS y, label FROM gx)"
        rel, dtw = "gq", sq.dtw_sql("dg", "gq", "symmetric", band)
    from tsq.plans.similarity import PARTNER_SEED
    part = "CAST('partner' AS VARCHAR) || '|' || CAST({} AS VARCHAR)"
    assert part.format(PARTNER_SEED) in sq.PAIRS_SQL
    pairs_sql = sq.PAIRS_SQL.replace(part.format(PARTNER_SEED), part.format(SEED))
    return f"""
WITH RECURSIVE {pairs_sql},
gx AS (SELECT pairs.a_id AS sample_id, pairs.y AS proto, pairs.x AS pat, e.label FROM pairs JOIN embeddings e ON e.vec_id = pairs.a_id),
{pairs},
{dtw},
fin AS (SELECT a_id, b_id, len(x) AS P, len(y) AS S FROM {rel}),
tb(a_id, b_id, n, i, j) AS (
  SELECT a_id, b_id, 0, P, S FROM fin
  UNION ALL
  SELECT t.a_id, t.b_id, t.n + 1,
         CASE WHEN c.k = 0 THEN t.i - 1 WHEN c.k = 1 THEN t.i - 1 ELSE t.i END,
         CASE WHEN c.k = 0 THEN t.j - 1 WHEN c.k = 1 THEN t.j ELSE t.j - 1 END
  FROM tb t JOIN dg r1 ON r1.a_id = t.a_id AND r1.b_id = t.b_id AND r1.i = t.i - 1
       JOIN dg r0 ON r0.a_id = t.a_id AND r0.b_id = t.b_id AND r0.i = t.i,
  LATERAL (SELECT CASE WHEN r1.row[t.j] <= r1.row[t.j + 1] AND r1.row[t.j] <= r0.row[t.j] THEN 0
                       WHEN r1.row[t.j + 1] <= r0.row[t.j] THEN 1 ELSE 2 END AS k) c
  WHERE t.i > 1 OR t.j > 1),
wp AS (SELECT tb.a_id, list(q.y[tb.j] ORDER BY tb.n DESC) AS wp, any_value(q.label) AS label, any_value(len(q.y)) AS L
       FROM tb JOIN {rel} q ON q.a_id = tb.a_id GROUP BY tb.a_id),
f AS (SELECT *, len(wp) AS M, CAST(L - 1 AS DOUBLE) / CAST(len(wp) - 1 AS DOUBLE) AS gs FROM wp),
g AS (SELECT a_id, label, L, M, gs, wp, unnest(range(0, L)) AS t FROM f),
h AS (SELECT *, least(CAST(floor(t / gs) AS BIGINT), M - 2) AS jj FROM g)
SELECT a_id AS sample_id, label, CAST(t AS INTEGER) AS t,
       {r("CASE WHEN t = L - 1 THEN wp[M] ELSE wp[jj + 1] + (wp[jj + 2] - wp[jj + 1]) / (CASE WHEN jj + 1 = M - 1 THEN CAST(L - 1 AS DOUBLE) ELSE (jj + 1) * gs END - jj * gs) * (t - jj * gs) END")} AS value
FROM h"""


_OR["aug_guided_warp"] = _guided_sql(False)
_OR["aug_guided_warp_shape"] = _guided_sql(True)


def _spawner_sql() -> str:
    """SQL twin of SPAWNER: DTW paths of the two halves (split at the hashed
    cut, band from the full length), mean along the joined path, resampled
    to L points, then the hashed jitter (sigma 0.05)."""
    from tsq.plans import similarity as sq
    from tsq.plans.registry import r
    from tsq.plans.similarity import PARTNER_SEED
    part = "CAST('partner' AS VARCHAR) || '|' || CAST({} AS VARCHAR)"
    pairs_sql = sq.PAIRS_SQL.replace(part.format(PARTNER_SEED), part.format(SEED))
    u = rng.sql_uniform("sample_id", "'cut'", str(SEED))
    jit = rng.sql_normal("sample_id", str(au.DIM), "t", "'jitter'", str(SEED), sd=0.05)
    band = "CAST(ceil(p.Lf / 10.0) AS BIGINT)"
    return f"""
WITH RECURSIVE {pairs_sql},
sx AS (SELECT pairs.a_id AS sample_id, pairs.x AS pat, pairs.y AS proto, e.label, len(pairs.x) AS Lf
       FROM pairs JOIN embeddings e ON e.vec_id = pairs.a_id),
sc AS (SELECT *, CAST(1 + floor({u} * (Lf - 2)) AS BIGINT) AS cut FROM sx),
hv AS (SELECT sample_id AS a_id, 1 AS b_id, list_slice(pat, 1, cut) AS x, list_slice(proto, 1, cut) AS y, Lf, cut, 0 AS off FROM sc
       UNION ALL
       SELECT sample_id, 2, list_slice(pat, cut + 1, Lf), list_slice(proto, cut + 1, Lf), Lf, cut, cut FROM sc),
{sq.dtw_sql('dh', 'hv', 'symmetric', band)},
fin AS (SELECT a_id, b_id, len(x) AS P, len(y) AS S FROM hv),
tb(a_id, b_id, n, i, j) AS (
  SELECT a_id, b_id, 0, P, S FROM fin
  UNION ALL
  SELECT t.a_id, t.b_id, t.n + 1,
         CASE WHEN c.k = 0 THEN t.i - 1 WHEN c.k = 1 THEN t.i - 1 ELSE t.i END,
         CASE WHEN c.k = 0 THEN t.j - 1 WHEN c.k = 1 THEN t.j ELSE t.j - 1 END
  FROM tb t JOIN dh r1 ON r1.a_id = t.a_id AND r1.b_id = t.b_id AND r1.i = t.i - 1
       JOIN dh r0 ON r0.a_id = t.a_id AND r0.b_id = t.b_id AND r0.i = t.i,
  LATERAL (SELECT CASE WHEN r1.row[t.j] <= r1.row[t.j + 1] AND r1.row[t.j] <= r0.row[t.j] THEN 0
                       WHEN r1.row[t.j + 1] <= r0.row[t.j] THEN 1 ELSE 2 END AS k) c
  WHERE t.i > 1 OR t.j > 1),
mp AS (SELECT tb.a_id AS sample_id, list((s.pat[tb.i + h.off] + s.proto[tb.j + h.off]) / 2.0 ORDER BY tb.b_id, tb.n DESC) AS wp,
              any_value(s.label) AS label, any_value(s.Lf) AS L
       FROM tb JOIN hv h ON h.a_id = tb.a_id AND h.b_id = tb.b_id JOIN sc s ON s.sample_id = tb.a_id GROUP BY tb.a_id),
f AS (SELECT *, len(wp) AS M, CAST(L - 1 AS DOUBLE) / CAST(len(wp) - 1 AS DOUBLE) AS gs FROM mp),
g AS (SELECT sample_id, label, L, M, gs, wp, unnest(range(0, L)) AS t FROM f),
h AS (SELECT *, least(CAST(floor(t / gs) AS BIGINT), M - 2) AS jj FROM g),
v AS (SELECT sample_id, label, CAST(t AS INTEGER) AS t,
        CASE WHEN t = L - 1 THEN wp[M] ELSE wp[jj + 1] + (wp[jj + 2] - wp[jj + 1]) / (CASE WHEN jj + 1 = M - 1 THEN CAST(L - 1 AS DOUBLE) ELSE (jj + 1) * gs END - jj * gs) * (t - jj * gs) END AS value FROM h)
SELECT sample_id, label, t, {r(f'value + {jit}')} AS value FROM v"""


_OR["aug_spawner"] = _spawner_sql()
