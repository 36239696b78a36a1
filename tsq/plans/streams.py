"""Queries: streaming versions of the core operators.

Each query drains a file stream of the events table with availableNow and
returns the upserted result table; the oracle is the equivalent batch SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tsq.operators import features as fe
from tsq.operators import metrics as me
from tsq.plans.registry import dbl, query, r, rounded
from tsq.session import scratch_path
from tsq.sources import tables as tb
from tsq.streaming import features as st

ROLL_W, EMA_SPAN = 5, 12
SESSION_GAP = "30 minutes"
ANOM_Q = 0.99


def _delay(spark, sf):
    """Watermark at which the files as they lie have no late row."""
    return st.disorder(spark, st.table_path(sf, "events"))


@query("st_tumbling", f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
       count(*) AS n, {r('sum(value)')} AS value_sum FROM events GROUP BY 1, 2, 3
""")
def q_st_tumbling(spark, sf):
    """Hourly tumbling windows per event type (watermark 2 hours)."""
    s = st.windowed_counts(st.event_stream(spark, sf), "1 hour", watermark=_delay(spark, sf))
    path = st.run_to_table(spark, st.flatten_window(s), "st_tumbling")
    return rounded(st.latest(spark, path, ["window_start", "window_end", "event_type"]))


@query("st_sliding", f"""
WITH k AS (SELECT date_trunc('hour', ts) - INTERVAL (h.h) HOUR AS window_start, event_type, value
           FROM events CROSS JOIN (VALUES (0), (1)) h(h))
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n, {r('sum(value)')} AS value_sum
FROM k GROUP BY 1, 2, 3
""")
def q_st_sliding(spark, sf):
    """Two-hour windows sliding by one hour per event type."""
    s = st.windowed_counts(st.event_stream(spark, sf), "2 hours", "1 hour", watermark=_delay(spark, sf))
    path = st.run_to_table(spark, st.flatten_window(s), "st_sliding")
    return rounded(st.latest(spark, path, ["window_start", "window_end", "event_type"]))


@query("st_session", f"""
WITH o AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
             OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, {r('sum(value)')} AS value_sum
FROM s GROUP BY user_id, sid
""")
def q_st_session(spark, sf):
    """Per-user sessions with a 30-minute inactivity gap, emitted once the
    watermark closes them (append mode; state bounded by the watermark)."""
    delay = _delay(spark, sf)
    build = st.Rebuild(st.event_stream(spark, sf), lambda e: st.flatten_window(st.session_counts(e, SESSION_GAP, delay)))
    path = st.run_to_table(spark, None, "st_session", mode="append", rebuild=build)
    return rounded(st.latest(spark, path, ["window_start", "window_end", "user_id"]))


def _rolling(spark, sf):
    delay = _delay(spark, sf)
    build = st.Rebuild(st.event_stream(spark, sf), lambda e: st.rolling_state(e, ROLL_W, EMA_SPAN, delay))
    path = st.run_to_table(spark, None, "st_rolling", mode="append", rebuild=build)
    return st.latest(spark, path, ["event_id"])


@query("st_rolling_state", f"""
SELECT event_id, user_id, {r('value')} AS value,
       {r(f'avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {ROLL_W} PRECEDING AND 1 PRECEDING)')} AS roll_mean
FROM events
""")
def q_st_rolling(spark, sf):
    """Trailing mean of the previous 5 values per user, from per-key state."""
    return rounded(_rolling(spark, sf).select("event_id", "user_id", "value", "roll_mean"))


@query("st_ema", f"""
WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
e(user_id, t, ema) AS (SELECT user_id, t, value FROM o WHERE t = 0
  UNION ALL SELECT o.user_id, o.t, {dbl(1 - fe.ema_alpha(EMA_SPAN))} * e.ema + {dbl(fe.ema_alpha(EMA_SPAN))} * o.value
  FROM e JOIN o ON o.user_id = e.user_id AND o.t = e.t + 1)
SELECT o.event_id, o.user_id, {r('e.ema', 4)} AS ema FROM o JOIN e USING (user_id, t)
""")
def q_st_ema(spark, sf):
    """EMA (span 12, adjust=False) per user carried in per-key state."""
    return rounded(_rolling(spark, sf).select("event_id", "user_id", "ema"), 4)


def _anomaly_static(spark, sf):
    ev = tb.read(spark, sf, "events")
    stats = ev.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("_sd")) \
        .select("user_id", "mean", F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd")).alias("std"))
    e = ev.join(stats, "user_id").select((((F.col("value") - F.col("mean")) / F.col("std")) ** 2).alias("energy"))
    thr = me.exact_percentile(e, "energy", ANOM_Q).select(F.col("percentile").alias("threshold"))
    return stats, thr


@query("st_anomaly_score", f"""
WITH s AS (SELECT user_id, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS std FROM events GROUP BY 1),
z AS (SELECT e.event_id, e.user_id, (e.value - s.mean) / s.std AS z FROM events e JOIN s USING (user_id)),
t AS (SELECT quantile_cont(z * z, {dbl(ANOM_Q)}) AS threshold FROM z)
SELECT event_id, user_id, {r('z')} AS z, z * z > threshold AS anomaly FROM z CROSS JOIN t
""")
def q_st_anomaly(spark, sf):
    """Stream-static join with per-user statistics and a broadcast
    one-row threshold fitted on the static table."""
    stats, thr = _anomaly_static(spark, sf)
    s = st.anomaly_scores(st.event_stream(spark, sf), stats, thr)
    path = st.run_to_table(spark, s, "st_anomaly", mode="append")
    return rounded(st.latest(spark, path, ["event_id"]))


@query("st_dedup_late", """
SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events
""")
def q_st_dedup(spark, sf):
    """Duplicate (user, type, minute) events within the watermark dropped."""
    s = st.dedup_keys(st.event_stream(spark, sf), _delay(spark, sf))
    path = st.run_to_table(spark, s, "st_dedup", mode="append")
    return st.latest(spark, path, ["user_id", "event_type", "minute"])


LATE_FILES, LATE_DELAY = 6, "1 hour"
# every tenth event comes two days after its time
LATE_ID, LATE_BY = 3, 2 * 86_400


@query("st_late_rows", f"""
WITH a AS (SELECT event_id, ts, user_id, event_type, date_trunc('minute', ts) AS minute,
                  epoch_us(ts) + CASE WHEN event_id % 10 = {LATE_ID} THEN {LATE_BY * 1_000_000} ELSE 0 END AS arrival FROM events),
f AS (SELECT *, CAST(floor((arrival - min(arrival) OVER ()) * {LATE_FILES} / (max(arrival) OVER () - min(arrival) OVER () + 1)) AS INTEGER) AS file FROM a),
top AS (SELECT file, max(ts) AS top FROM f GROUP BY 1),
wm AS (SELECT x.file, max(y.top) - INTERVAL 1 HOUR AS wm FROM top x LEFT JOIN top y ON y.file < x.file GROUP BY 1),
r AS (SELECT f.*, coalesce(f.ts <= wm.wm, false) AS late FROM f JOIN wm USING (file))
SELECT event_id, ts, user_id, event_type, minute, CASE WHEN late THEN 'late'
       WHEN row_number() OVER (PARTITION BY late, user_id, event_type, minute ORDER BY file, ts, event_id) = 1 THEN 'kept' ELSE 'duplicate' END AS route FROM r
""")
def q_st_late(spark, sf):
    """Events that arrive out of order, with a fixed watermark: rows kept,
    duplicates within the watermark, and late rows on a side output."""
    e = tb.read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 10 == LATE_ID, F.lit(LATE_BY * 1_000_000)).otherwise(F.lit(0))
    out, ckpt = scratch_path(spark, "st_late"), scratch_path(spark, "st_late-ckpt")
    for folder in st.arrivals(spark, e.withColumn("arrival", at), "arrival", LATE_FILES, "arrivals"):
        # all that has come is one batch; the query goes on from its checkpoint
        s = st.event_stream(spark, folder, max_files=1_000_000).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
        path = st.run_routed(spark, s, ["user_id", "event_type", "minute"], LATE_DELAY, "st_late", ckpt, out)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "minute", "route")
