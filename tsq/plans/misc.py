"""Queries: sort / limit / ranking, set operations and remaining window
operators (SURVEY §2.4 attention pooling, §2.5, §2.6, §2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsq.functions import rng
from tsq.operators import windows as wo
from tsq.operators.index import fill_forward, running_sum, series_index, _fill
from tsq.plans import sqlparts as S
from tsq.plans.metrics import M4_META, m4_frame
from tsq.plans.registry import dbl, query, r, rounded
from tsq.plans.windows import DAILY_SQL, EVENTS_SQL, LABEL_LEN, PRED_LEN, SEQ_LEN, indexed_daily
from tsq.sources import tables as tb


@query("sort_panel", f"WITH panel AS ({S.PANEL}) SELECT ticker, date, close FROM panel ORDER BY ticker, date")
def q_sort_panel(spark, sf):
    """Panel sorted by (ticker, date): a range-partitioned global sort."""
    return tb.ticker_panel(spark, sf).select("ticker", "date", "close").orderBy("ticker", "date")


HEAD_N = 10


@query("head_n", f"WITH panel AS ({S.PANEL}) SELECT ticker, date, close FROM panel ORDER BY ticker, date LIMIT {HEAD_N}")
def q_head_n(spark, sf):
    """First n rows in (ticker, date) order (the limit is the operator)."""
    return tb.ticker_panel(spark, sf).select("ticker", "date", "close").orderBy("ticker", "date").limit(HEAD_N)


@query("distinct_values", "SELECT DISTINCT c_mktsegment AS ticker FROM customer")
def q_distinct(spark, sf):
    return tb.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("ticker")).distinct()


@query("duplicate_column_drop", f"""
WITH panel AS ({S.PANEL}) SELECT ticker, date, close, volume FROM panel
""")
def q_dup_cols(spark, sf):
    """A join leaves duplicate column names; the first of each is kept
    (positional, deterministic)."""
    p = tb.ticker_panel(spark, sf)
    a = p.select("ticker", "date", "close", "volume")
    b = p.select("ticker", "date", (F.col("close") * 2).alias("close"), F.col("high").alias("volume"))
    j = a.join(b, ["ticker", "date"])  # columns: ticker, date, close, volume, close, volume
    names = j.columns
    tmp = j.toDF(*[f"_c{i}" for i in range(len(names))])
    first = {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
    return tmp.select(*[F.col(f"_c{i}").alias(n) for n, i in first.items()])


PATIENCE = 7


@query("streak_since_best", f"""
WITH {DAILY_SQL},
b AS (SELECT date, t, OT, min(OT) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM d),
i AS (SELECT *, CASE WHEN prev_best IS NULL OR OT < prev_best THEN t END AS imp FROM b),
s AS (SELECT *, max(imp) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM i)
SELECT date, {r('least(coalesce(prev_best, OT), OT)')} AS best, t - last_imp AS streak, t - last_imp >= {PATIENCE} AS stop FROM s
""")
def q_streak(spark, sf):
    """Early stopping on any metric series (lower is better): running best,
    rows since the last strict improvement, patience flag.  The running
    minimum uses block minima + a prefix over blocks, no whole-series window."""
    d = indexed_daily(spark, sf)
    block = 4096
    d = d.withColumn("_b", F.floor(F.col("t") / F.lit(block)))
    bm = d.groupBy("series_id", "_b").agg(F.min("OT").alias("_bm"))
    wb = Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = bm.select("series_id", "_b", F.min("_bm").over(wb).alias("_carry"))
    d = d.join(carry, ["series_id", "_b"])
    wi = Window.partitionBy("series_id", "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.least(F.min("OT").over(wi), F.col("_carry"))  # least skips NULLs
    d = d.withColumn("prev_best", prev)
    d = d.withColumn("imp", F.when(F.col("prev_best").isNull() | (F.col("OT") < F.col("prev_best")), F.col("t")))
    d = fill_forward(d, "series_id", "t", ["imp"])
    return rounded(d.select("date", F.least(F.coalesce("prev_best", "OT"), F.col("OT")).alias("best"),
                            (F.col("t") - F.col("imp")).alias("streak"),
                            (F.col("t") - F.col("imp") >= PATIENCE).alias("stop")))


@query("class_medoid", f"""
WITH s AS ({S.SEQUENCES}), c AS (SELECT label, t, avg(value) AS cv FROM s GROUP BY 1, 2),
d AS (SELECT s.sample_id, s.label, sum((s.value - c.cv) * (s.value - c.cv)) AS d2 FROM s JOIN c USING (label, t) GROUP BY 1, 2)
SELECT label, arg_min(sample_id, (d2, sample_id)) AS medoid_id, count(*) AS n FROM d GROUP BY label
""")
def q_class_medoid(spark, sf):
    """Class medoid under summed squared Euclidean distance, exact without
    pairs: sum_j |x_i - x_j|^2 = n |x_i - mean|^2 + const, so the medoid is
    the member closest to the class mean (ties: smallest id)."""
    s = tb.sequences(spark, sf)
    c = s.groupBy("label", "t").agg(F.avg("value").alias("cv"))
    d = s.join(c, ["label", "t"]).groupBy("sample_id", "label").agg(F.sum((F.col("value") - F.col("cv")) ** 2).alias("d2"))
    return d.groupBy("label").agg(F.min_by("sample_id", F.struct("d2", "sample_id")).alias("medoid_id"),
                                  F.count(F.lit(1)).alias("n"))


MN_RATE, MN_SEED = 0.2, 13


@query("masked_norm", f"""
WITH {DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
m AS (SELECT *, CAST({rng.sql_uniform('t', "'mnorm'", str(MN_SEED))} > {dbl(MN_RATE)} AS INTEGER) AS mask FROM d),
w AS (SELECT m.t - k.k AS window_id, CAST(k.k AS INTEGER) AS step, m.OT AS value, m.mask FROM m CROSS JOIN c CROSS JOIN range(0, {SEQ_LEN}) k(k)
      WHERE m.t - k.k >= 0 AND m.t - k.k <= c.n - {SEQ_LEN + PRED_LEN}),
st AS (SELECT window_id, sum(value * mask) / nullif(sum(mask), 0) AS mm FROM w GROUP BY 1),
x AS (SELECT w.*, CASE WHEN mask = 1 THEN value - mm ELSE 0.0 END AS xc FROM w JOIN st USING (window_id)),
sd AS (SELECT window_id, sqrt(sum(xc * xc) / nullif(sum(mask), 0) + 1e-5) AS ms FROM x GROUP BY 1)
SELECT window_id, step, {r('xc / ms')} AS x_norm FROM x JOIN sd USING (window_id)
""")
def q_masked_norm(spark, sf):
    """Per-window normalisation with statistics of observed (mask = 1)
    cells only; masked cells become 0 (look-back part of each window)."""
    d = indexed_daily(spark, sf).withColumn("mask", (rng.uniform("t", F.lit("mnorm"), F.lit(MN_SEED)) > F.lit(MN_RATE)).cast("int"))
    w = wo.sliding_windows(d, "series_id", "t", SEQ_LEN, LABEL_LEN, PRED_LEN).filter(F.col("in_x"))
    w = w.withColumnRenamed("OT", "value")
    return rounded(wo.masked_norm(w, "series_id", "value", "mask").select("window_id", "step", "x_norm"))


CUT_SEED = 17
# fixed values: horizons of history that a cut may reach back, by seasonal group
HISTORY_SIZE = {"Yearly": 1.5, "Quarterly": 1.5, "Monthly": 1.5, "Weekly": 10.0, "Daily": 10.0, "Hourly": 10.0}


@query("random_cut_window", f"""
WITH {EVENTS_SQL},
meta AS (SELECT * FROM (VALUES {', '.join(f"('{g}', {h}, {HISTORY_SIZE[g]})" for g, f, h in M4_META)}) m(grp, horizon, hs)),
sr AS (SELECT series_id, any_value(grp) AS grp, count(*) AS n FROM ev GROUP BY 1),
cu AS (SELECT sr.*, meta.horizon, greatest(1, n - CAST(floor(hs * horizon) AS BIGINT)) AS lo FROM sr JOIN meta USING (grp)),
ct AS (SELECT *, lo + CAST(floor({rng.sql_uniform('series_id', "'cut'", str(CUT_SEED))} * (n - lo)) AS BIGINT) AS cut FROM cu),
pos AS (SELECT series_id, 'in' AS part, CAST(k.k AS INTEGER) AS pos, cut - 2 * horizon + k.k AS src, n FROM ct CROSS JOIN range(0, 200) k(k) WHERE k.k < 2 * horizon
        UNION ALL
        SELECT series_id, 'out', CAST(k.k AS INTEGER), greatest(cut - horizon, 0) + k.k, n FROM ct CROSS JOIN range(0, 200) k(k) WHERE k.k < 2 * horizon)
SELECT pos.series_id, part, pos, {r('coalesce(ev.value, 0.0)')} AS value, CAST(ev.value IS NOT NULL AS INTEGER) AS mask
FROM pos LEFT JOIN ev ON ev.series_id = pos.series_id AND ev.t = pos.src AND pos.src >= 0 AND pos.src < pos.n
""")
def q_random_cut(spark, sf):
    """Training sample per series: hash-random cut point in
    [max(1, n - history*h), n); in-sample = 2h points before the cut
    (zero-padded, mask 0), out-sample = h label + h horizon points from
    cut - h (start clamped at 0, mask 0 past the end)."""
    e = m4_frame(spark, sf)
    hs = F.create_map(*[x for g, v in HISTORY_SIZE.items() for x in (F.lit(g), F.lit(v))])
    sr = e.groupBy("series_id", "grp", "horizon").agg(F.count(F.lit(1)).alias("n"))
    sr = sr.withColumn("lo", F.greatest(F.lit(1), F.col("n") - F.floor(hs[F.col("grp")] * F.col("horizon")).cast("long")))
    sr = sr.withColumn("cut", F.col("lo") + F.floor(rng.uniform("series_id", F.lit("cut"), F.lit(CUT_SEED)) * (F.col("n") - F.col("lo"))).cast("long"))
    sr = sr.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("horizon") * 2 - 1)))
    ins = sr.select("series_id", F.lit("in").alias("part"), "pos", (F.col("cut") - F.col("horizon") * 2 + F.col("pos")).alias("src"), "n")
    outs = sr.select("series_id", F.lit("out").alias("part"), "pos",
                     (F.greatest(F.col("cut") - F.col("horizon"), F.lit(0)) + F.col("pos")).alias("src"), "n")
    p = ins.unionByName(outs)
    v = e.select(F.col("series_id").alias("_s"), F.col("t").alias("_t"), "value")
    j = p.join(v, (F.col("series_id") == F.col("_s")) & (F.col("src") == F.col("_t")), "left")
    return rounded(j.select("series_id", "part", F.col("pos").cast("int").alias("pos"),
                            F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().cast("int").alias("mask")))


@query("vector_pool_attention", f"""
WITH s AS ({S.SEQUENCES}),
q AS (SELECT t, avg(value) AS qv FROM s GROUP BY t),
qn AS (SELECT sqrt(sum(qv * qv)) AS qn FROM q),
vn AS (SELECT sample_id, sqrt(sum(value * value)) AS vn FROM s GROUP BY 1),
sc AS (SELECT s.sample_id, any_value(s.label) AS label, sum(s.value * q.qv) / (any_value(vn.vn) * any_value(qn.qn)) AS score
       FROM s JOIN q USING (t) JOIN vn USING (sample_id) CROSS JOIN qn GROUP BY s.sample_id),
mx AS (SELECT label, max(score) AS m FROM sc GROUP BY 1),
wt AS (SELECT sc.sample_id, sc.label, exp(score - m) AS e FROM sc JOIN mx USING (label)),
z AS (SELECT label, sum(e) AS z FROM wt GROUP BY 1)
SELECT s.label, s.t AS dim, {r('sum(s.value * wt.e / z.z)')} AS value
FROM s JOIN wt USING (sample_id) JOIN z ON z.label = wt.label GROUP BY s.label, s.t
""")
def q_attention_pool(spark, sf):
    """Attention pooling of the token vectors of each text (text = class):
    score = cosine(token, query) with the global mean vector as query,
    softmax over the text's tokens, weighted sum of the raw vectors."""
    s = tb.sequences(spark, sf)
    q = s.groupBy("t").agg(F.avg("value").alias("qv"))
    qn = q.agg(F.sqrt(F.sum(F.col("qv") ** 2)).alias("qn"))
    vn = s.groupBy("sample_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("vn"))
    sc = s.join(q, "t").groupBy("sample_id", "label").agg(F.sum(F.col("value") * F.col("qv")).alias("dot"))
    sc = sc.join(vn, "sample_id").crossJoin(F.broadcast(qn)).withColumn("score", F.col("dot") / (F.col("vn") * F.col("qn")))
    mx = sc.groupBy("label").agg(F.max("score").alias("m"))
    wt = sc.join(mx, "label").withColumn("e", F.exp(F.col("score") - F.col("m")))
    z = wt.groupBy("label").agg(F.sum("e").alias("z"))
    wt = wt.join(z, "label").select("sample_id", (F.col("e") / F.col("z")).alias("w"))
    out = s.join(wt, "sample_id").groupBy("label", F.col("t").alias("dim")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return rounded(out)
