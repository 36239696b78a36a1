"""Queries: calendar, date, masking and reshaping functions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsq.functions import calendar as cal
from tsq.functions import rng
from tsq.operators import metrics as me
from tsq.operators import reshape as rs
from tsq.operators import windows as wo
from tsq.operators.index import series_index
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rounded
from tsq.plans.windows import DAILY_SQL, EVENTS_SQL, indexed_daily, indexed_events
from tsq.sources import tables as tb

CHANNELS = ["click", "error", "purchase", "signup", "view"]

# ------------------------------------------------------------- calendar
TF_SQL = {
    "tf_second": "second(ts) / 59.0 - 0.5",
    "tf_minute": "minute(ts) / 59.0 - 0.5",
    "tf_hour": "hour(ts) / 23.0 - 0.5",
    "tf_dow": "(isodow(ts) - 1) / 6.0 - 0.5",
    "tf_dom": "(day(ts) - 1) / 30.0 - 0.5",
    "tf_doy": "(dayofyear(ts) - 1) / 365.0 - 0.5",
    "tf_month": "(month(ts) - 1) / 11.0 - 0.5",
    "tf_week": "(week(ts) - 1) / 52.0 - 0.5",
}
TF_SPARK = {"tf_second": cal.tf_second, "tf_minute": cal.tf_minute, "tf_hour": cal.tf_hour, "tf_dow": cal.tf_dow,
            "tf_dom": cal.tf_dom, "tf_doy": cal.tf_doy, "tf_month": cal.tf_month, "tf_week": cal.tf_week}


def _tf(name):
    def fn(spark, sf):
        e = tb.read(spark, sf, "events")
        return rounded(e.select("event_id", TF_SPARK[name]("ts").alias(name)))
    query(name, f"SELECT event_id, {r(TF_SQL[name])} AS {name} FROM events")(fn)


for _n in TF_SQL:
    _tf(_n)

_FEAT_SQL = {"hour_of_day": TF_SQL["tf_hour"], "day_of_week": TF_SQL["tf_dow"],
             "day_of_month": TF_SQL["tf_dom"], "day_of_year": TF_SQL["tf_doy"]}


@query("time_features", "SELECT event_id, " + ", ".join(f"{r(v)} AS {k}" for k, v in _FEAT_SQL.items()) + " FROM events")
def q_time_features(spark, sf):
    e = tb.read(spark, sf, "events")
    return rounded(e.select("event_id", *cal.time_features("ts", "h")))


@query("time_features_raw", """
SELECT event_id, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS weekday, hour(ts) AS hour FROM events
""")
def q_time_features_raw(spark, sf):
    e = tb.read(spark, sf, "events")
    return e.select("event_id", *cal.time_features_raw("ts"))


@query("month_period", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_period FROM orders")
def q_month_period(spark, sf):
    o = tb.read(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month_period"))


@query("date_to_string", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_str FROM orders")
def q_date_to_string(spark, sf):
    o = tb.read(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_str"))


def _dnn_sql(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN (CASE WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) ELSE 0.0 END) ELSE ({a}) / ({b}) END)"


@query("divide_no_nan", f"""
SELECT l_orderkey, l_linenumber, {r(_dnn_sql('l_discount - 0.05', 'l_tax'))} AS q FROM lineitem
""")
def q_divide_no_nan(spark, sf):
    li = tb.read(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber",
                             me.divide_no_nan(F.col("l_discount") - F.lit(0.05), "l_tax").alias("q")))


_DIVS = ", ".join(f"({i}, {dbl(math.exp(-(i - i % 2) * math.log(10000.0) / 16))})" for i in range(16))


@query("sinusoid_encoding", f"""
SELECT e.event_id, CAST(k.i AS INTEGER) AS dim,
       {r("CASE WHEN k.i % 2 = 0 THEN sin(hour(e.ts) * k.dv) ELSE cos(hour(e.ts) * k.dv) END")} AS value
FROM events e CROSS JOIN (VALUES {_DIVS}) k(i, dv)
""")
def q_sinusoid(spark, sf):
    """Sinusoid code (d=16) of each event's hour-of-day calendar code."""
    e = tb.read(spark, sf, "events")
    d = e.select("event_id", F.inline(rs.sinusoid(F.hour("ts"), 16)))
    return rounded(d)


# ---------------------------------------------------------------- hourly
def hourly_long(spark, sf):
    """Hour x channel matrix in long form, t = hour position, NULL -> 0
    (numpy nan_to_num)."""
    h = tb.hourly_matrix(spark, sf).withColumn("_k", F.lit(0))
    h = series_index(h, "_k", "ts").drop("_k")
    lg = h.unpivot(["ts", "t"], CHANNELS, "channel", "value")
    return lg.withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))


HOURLY_SQL = f"""h AS ({S.HOURLY}), ht AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t FROM h),
hl AS ({' UNION ALL '.join(f"SELECT ts, t, '{c}' AS channel, coalesce(\"{c}\", 0.0) AS value FROM ht" for c in CHANNELS)})"""

MASK_RATE, MASK_SEED = 0.125, 11
_U = rng.sql_uniform("ts", "channel", "'mask'", str(MASK_SEED))


def masked(spark, sf):
    hl = hourly_long(spark, sf)
    m = (rng.uniform("ts", "channel", F.lit("mask"), F.lit(MASK_SEED)) > F.lit(MASK_RATE)).cast("int")
    return hl.withColumn("mask", m)


@query("random_mask", f"""
WITH {HOURLY_SQL}
SELECT ts, channel, {r('value')} AS value, CAST({_U} > {dbl(MASK_RATE)} AS INTEGER) AS mask,
       {r(f'value * CAST({_U} > {dbl(MASK_RATE)} AS INTEGER)')} AS x_masked FROM hl
""")
def q_random_mask(spark, sf):
    d = masked(spark, sf)
    return rounded(d.select("ts", "channel", "value", "mask", (F.col("value") * F.col("mask")).alias("x_masked")))


@query("mask_fill", f"""
WITH {HOURLY_SQL}, m AS (SELECT *, CAST({_U} > {dbl(MASK_RATE)} AS INTEGER) AS mask FROM hl),
p AS (SELECT channel, avg(value) FILTER (WHERE mask = 1) AS pred FROM m GROUP BY 1)
SELECT ts, channel, {r('value * mask + pred * (1 - mask)')} AS filled FROM m JOIN p USING (channel)
""")
def q_mask_fill(spark, sf):
    """observed * mask + predicted * (1 - mask), prediction = the channel
    mean of observed cells."""
    d = masked(spark, sf)
    p = d.filter(F.col("mask") == 1).groupBy("channel").agg(F.avg("value").alias("pred"))
    d = d.join(p, "channel")
    return rounded(d.select("ts", "channel", (F.col("value") * F.col("mask") + F.col("pred") * (F.lit(1) - F.col("mask"))).alias("filled")))


@query("instance_norm", f"""
WITH {HOURLY_SQL}, mc AS (SELECT channel, avg(value) AS m FROM hl GROUP BY 1),
c AS (SELECT hl.ts, hl.channel, hl.value - mc.m AS x FROM hl JOIN mc USING (channel)),
sd AS (SELECT ts, sqrt(var_pop(x) + 1e-5) AS s FROM c GROUP BY 1)
SELECT ts, channel, {r('x / s')} AS z FROM c JOIN sd USING (ts)
""")
def q_instance_norm(spark, sf):
    """Centre each channel by its mean over time, scale each time step by
    the population std across channels (+1e-5)."""
    hl = hourly_long(spark, sf)
    mc = hl.groupBy("channel").agg(F.avg("value").alias("m"))
    c = hl.join(mc, "channel").withColumn("x", F.col("value") - F.col("m"))
    sd = c.groupBy("ts").agg(F.sqrt(F.var_pop("x") + F.lit(1e-5)).alias("s"))
    return rounded(c.join(sd, "ts").select("ts", "channel", (F.col("x") / F.col("s")).alias("z")))


POOL_W, POOL_LEVELS = 4, 2


def _pool_sql(fn):
    l1 = f"SELECT channel, CAST(floor(t / {POOL_W}) AS BIGINT) AS t, {fn}(value) AS value FROM hl WHERE t < (SELECT floor(count(*) / {POOL_W}) * {POOL_W} FROM ht) GROUP BY 1, 2"
    return f"""WITH {HOURLY_SQL}, l1 AS ({l1}),
l2 AS (SELECT channel, CAST(floor(t / {POOL_W}) AS BIGINT) AS t, {fn}(value) AS value FROM l1
       WHERE t < (SELECT floor(count(*) / {POOL_W}) * {POOL_W} FROM l1 WHERE channel = 'click') GROUP BY 1, 2)
SELECT channel, 0 AS level, t, {r('value')} AS value FROM hl
UNION ALL SELECT channel, 1, t, {r('value')} FROM l1
UNION ALL SELECT channel, 2, t, {r('value')} FROM l2"""


@query("downsample_avg", _pool_sql("avg"))
def q_down_avg(spark, sf):
    hl = hourly_long(spark, sf)
    return rounded(rs.pool_levels(hl, "channel", "t", "value", POOL_W, POOL_LEVELS, "avg").select("channel", "level", "t", "value"))


@query("downsample_max", _pool_sql("max"))
def q_down_max(spark, sf):
    hl = hourly_long(spark, sf)
    return rounded(rs.pool_levels(hl, "channel", "t", "value", POOL_W, POOL_LEVELS, "max").select("channel", "level", "t", "value"))


ENERGY_K = 5


def energy(spark, sf):
    """Reconstruction energy per hour: mean over channels of the squared
    error of a centred moving-average reconstruction (kernel 5)."""
    hl = hourly_long(spark, sf)
    dec = wo.decompose(hl, "channel", "t", "value", [ENERGY_K], trend="rec", seasonal="res")
    return dec.groupBy("ts", "t").agg(F.avg(F.col("res") * F.col("res")).alias("energy"))


ENERGY_SQL = f"""{HOURLY_SQL},
rc AS (SELECT ts, t, channel, value, (sum(value) OVER w
        + (2 - count(*) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)) * first_value(value) OVER wa
        + (2 - count(*) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) * last_value(value) OVER wa) / 5.0 AS rec
       FROM hl WINDOW w AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
                     wa AS (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
en AS (SELECT ts, t, avg((value - rec) * (value - rec)) AS energy FROM rc GROUP BY 1, 2)"""


@query("reconstruction_energy", f"WITH {ENERGY_SQL} SELECT ts, {r('energy')} AS energy FROM en")
def q_energy(spark, sf):
    return rounded(energy(spark, sf).select("ts", "energy"))


ANOMALY_RATIO = 1.0


@query("percentile_threshold", f"WITH {ENERGY_SQL} SELECT {r(f'quantile_cont(energy, {dbl(1 - ANOMALY_RATIO / 100)})', 4)} AS threshold FROM en")
def q_percentile(spark, sf):
    e = energy(spark, sf)
    return rounded(me.exact_percentile(e, "energy", 1 - ANOMALY_RATIO / 100).withColumnRenamed("percentile", "threshold"), 4)


@query("union_scores", f"""
WITH {ENERGY_SQL}
SELECT 'train' AS split, ts, {r('energy')} AS energy FROM en WHERE t < 360
UNION ALL SELECT 'test' AS split, ts, {r('energy')} AS energy FROM en WHERE t >= 360
""")
def q_union_scores(spark, sf):
    e = energy(spark, sf)
    tr = e.filter(F.col("t") < 360).select(F.lit("train").alias("split"), "ts", "energy")
    te = e.filter(F.col("t") >= 360).select(F.lit("test").alias("split"), "ts", "energy")
    return rounded(tr.unionByName(te))


# ------------------------------------------------------------ daily reshapes
@query("maxpool_overlap", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
x AS (SELECT CAST((d.t - k.k) / 2 AS BIGINT) AS t, max(d.OT) AS value FROM d CROSS JOIN c CROSS JOIN (VALUES (-1), (0), (1)) k(k)
      WHERE (d.t - k.k) % 2 = 0 AND d.t - k.k >= 0 AND (d.t - k.k) / 2 <= floor((c.n - 1) / 2) GROUP BY 1)
SELECT t, {r('value')} AS value FROM x
""")
def q_maxpool(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(rs.maxpool_overlap(d, "series_id", "t", "OT").select("t", F.col("OT").alias("value")))


CHUNK = 24


@query("chunk_continuous", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d)
SELECT CAST(floor(t / {CHUNK}) AS BIGINT) AS chunk, CAST(t % {CHUNK} AS BIGINT) AS pos, {r('OT')} AS value
FROM d CROSS JOIN c WHERE t < floor(n / {CHUNK}) * {CHUNK}
""")
def q_chunk_cont(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(rs.chunks(d, "series_id", "t", CHUNK, "continuous").select("chunk", "pos", F.col("OT").alias("value")))


@query("chunk_interval", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n, CAST(floor(count(*) / {CHUNK}) AS BIGINT) AS nc FROM d)
SELECT CAST(t % nc AS BIGINT) AS chunk, CAST(floor(t / nc) AS BIGINT) AS pos, {r('OT')} AS value
FROM d CROSS JOIN c WHERE t < nc * {CHUNK}
""")
def q_chunk_int(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(rs.chunks(d, "series_id", "t", CHUNK, "interval").select("chunk", "pos", F.col("OT").alias("value")))


PATCH_LEN, PATCH_STRIDE = 16, 8

PADDED_SQL = f"""{DAILY_SQL}, lst AS (SELECT max(t) AS tl, arg_max(OT, t) AS vl FROM d),
pd AS (SELECT t, OT FROM d UNION ALL SELECT tl + k.k AS t, vl AS OT FROM lst CROSS JOIN range(1, {PATCH_STRIDE + 1}) k(k)),
pc AS (SELECT count(*) AS n FROM pd)"""


@query("patches", f"""
WITH {PADDED_SQL}
SELECT CAST(floor((pd.t - k.k) / {PATCH_STRIDE}) AS BIGINT) AS patch_id, CAST(k.k AS INTEGER) AS pos, {r('pd.OT')} AS value
FROM pd CROSS JOIN pc CROSS JOIN range(0, {PATCH_LEN}) k(k)
WHERE pd.t - k.k >= 0 AND (pd.t - k.k) % {PATCH_STRIDE} = 0
  AND (pd.t - k.k) / {PATCH_STRIDE} <= floor((pc.n - {PATCH_LEN}) / {PATCH_STRIDE})
""")
def q_patches(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(rs.patches(d, "series_id", "t", "OT", PATCH_LEN, PATCH_STRIDE).select("patch_id", "pos", F.col("OT").alias("value")))


SEG_LEN = 12
SEG_SQL = f"""{DAILY_SQL}, lst AS (SELECT max(t) AS tl, arg_max(OT, t) AS vl, count(*) AS n FROM d),
sp AS (SELECT t, OT FROM d UNION ALL
       SELECT tl + k.k, vl FROM lst CROSS JOIN range(1, {SEG_LEN}) k(k) WHERE k.k <= ceil(n / {SEG_LEN}) * {SEG_LEN} - n),
sg AS (SELECT CAST(floor(t / {SEG_LEN}) AS BIGINT) AS segment_id, CAST(t % {SEG_LEN} AS INTEGER) AS pos, OT FROM sp)"""


@query("segments", f"WITH {SEG_SQL} SELECT segment_id, pos, {r('OT')} AS value FROM sg")
def q_segments(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(rs.segments(d, "series_id", "t", "OT", SEG_LEN).select("segment_id", "pos", F.col("OT").alias("value")))


@query("segment_merge", f"""
WITH {SEG_SQL}, c AS (SELECT max(segment_id) + 1 AS ns FROM sg),
pz AS (SELECT ns, CAST(ceil(ns / 2) * 2 - ns AS BIGINT) AS pad FROM c),
sl AS (SELECT segment_id AS slot, pos, OT FROM sg
       UNION ALL SELECT segment_id + pad, pos, OT FROM sg CROSS JOIN pz WHERE segment_id >= ns - pad AND pad > 0)
SELECT CAST(floor(slot / 2) AS BIGINT) AS merged_id, CAST((slot % 2) * {SEG_LEN} + pos AS INTEGER) AS pos, {r('OT')} AS value FROM sl
""")
def q_segment_merge(spark, sf):
    d = indexed_daily(spark, sf)
    seg = rs.segments(d, "series_id", "t", "OT", SEG_LEN)
    return rounded(rs.segment_merge(seg, "series_id", 2).select("merged_id", "pos", F.col("OT").alias("value")))


PERIOD = 7


@query("pad_to_multiple", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
pp AS (SELECT t, OT FROM d UNION ALL SELECT k.k, 0.0 FROM c CROSS JOIN range(0, 100000) k(k)
       WHERE k.k >= c.n AND k.k < ceil(c.n / {PERIOD}) * {PERIOD})
SELECT CAST(floor(t / {PERIOD}) AS BIGINT) AS cycle, CAST(t % {PERIOD} AS INTEGER) AS phase, {r('OT')} AS value FROM pp
""")
def q_pad_multiple(spark, sf):
    d = indexed_daily(spark, sf)
    return rounded(rs.pad_to_multiple(d, "series_id", "t", "OT", PERIOD).select("cycle", "phase", F.col("OT").alias("value")))


PYR = (4, 4)


@query("pyramid_index", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
a AS (SELECT t, least(floor(t / 4), floor(n / 4) - 1) AS l1, floor(floor(n / 4) / 4) AS s2 FROM d CROSS JOIN c)
SELECT t, CAST(l1 AS BIGINT) AS level_1, CAST(least(floor(l1 / 4), s2 - 1) AS BIGINT) AS level_2 FROM a
""")
def q_pyramid(spark, sf):
    d = indexed_daily(spark, sf)
    return rs.pyramid_index(d, "series_id", "t", PYR).select("t", "level_1", "level_2")


# ---------------------------------------------------------- event series
MAX_LEN = 64


@query("pad_clip_mask", f"""
WITH {EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1)
SELECT series_id, t, {r('value')} AS value, 1 AS mask FROM ev WHERE t < {MAX_LEN}
UNION ALL
SELECT series_id, k.k AS t, 0.0 AS value, 0 AS mask FROM c CROSS JOIN range(0, {MAX_LEN}) k(k) WHERE k.k >= c.n
""")
def q_pad_clip(spark, sf):
    e = indexed_events(spark, sf)
    return rounded(rs.pad_clip(e, "series_id", "t", "value", MAX_LEN))


@query("subsample_factor", f"""
WITH {EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1)
SELECT series_id, CASE WHEN n > {MAX_LEN} THEN CAST(t / 2 AS BIGINT) ELSE t END AS t, {r('value')} AS value
FROM ev JOIN c USING (series_id) WHERE n <= {MAX_LEN} OR t % 2 = 0
""")
def q_subsample(spark, sf):
    e = indexed_events(spark, sf)
    return rounded(rs.subsample(e, "series_id", "t", MAX_LEN, 2).select("series_id", "t", "value"))


MS_H = 8


@query("multiscale_lookback", f"""
WITH {EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1)
SELECT ev.series_id, s.m AS scale, CAST(ev.t - (c.n - s.m * {MS_H}) AS INTEGER) AS pos, {r('ev.value')} AS value
FROM ev JOIN c USING (series_id) CROSS JOIN (VALUES (1), (2), (4)) s(m) WHERE ev.t >= c.n - s.m * {MS_H}
""")
def q_multiscale(spark, sf):
    """Look-backs of 1, 2 and 4 horizons ending at each series' last point."""
    e = wo.with_count(indexed_events(spark, sf), "series_id")
    e = e.withColumn("scale", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    e = e.filter(F.col("t") >= F.col("_n") - F.col("scale") * F.lit(MS_H))
    return rounded(e.select("series_id", "scale", (F.col("t") - (F.col("_n") - F.col("scale") * F.lit(MS_H))).cast("int").alias("pos"), "value"))


@query("flatten_samples", f"WITH s AS ({S.SEQUENCES}) SELECT sample_id, t, {r('value')} AS value FROM s")
def q_flatten(spark, sf):
    return rounded(tb.sequences(spark, sf).select("sample_id", "t", "value"))
