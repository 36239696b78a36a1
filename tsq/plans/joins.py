"""Queries: joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsq.functions import rng
from tsq.operators import align as al
from tsq.operators import clean as cl
from tsq.operators import features as fe
from tsq.operators import windows as wo
from tsq.operators.index import series_index, series_index_ranged
from tsq.plans import sqlparts as S
from tsq.plans.metrics import M4_SQL, m4_forecasts, m4_frame
from tsq.plans.registry import query, r, rounded
from tsq.plans.windows import DAILY_SQL, EVENTS_SQL, LABEL_LEN, PRED_LEN, SEQ_LEN, indexed_daily
from tsq.session import materialize
from tsq.sources import tables as tb

EMB_DIM = 64


def global_vector(spark, sf):
    """Mean of all embedding vectors as one row news_0..news_63."""
    e = tb.read(spark, sf, "embeddings").select(F.posexplode("embedding").alias("d", "v"))
    g = e.groupBy("d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return g.groupBy().pivot("d", list(range(EMB_DIM))).agg(F.first("v")) \
        .select(*[F.col(str(i)).alias(f"news_{i}") for i in range(EMB_DIM)])


@query("join_global_vector", f"""
WITH panel AS ({S.PANEL}),
g AS (SELECT {', '.join(f'avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS news_{i}' for i in range(EMB_DIM))} FROM embeddings)
SELECT ticker, date, close, {', '.join(f"{r(f'news_{i}')} AS news_{i}" for i in range(EMB_DIM))} FROM panel CROSS JOIN g
""")
def q_join_global_vector(spark, sf):
    p = tb.ticker_panel(spark, sf).select("ticker", "date", "close")
    # one row (64 values): broadcast has a fixed size bound
    return rounded(p.crossJoin(F.broadcast(global_vector(spark, sf))))


@query("join_group_meta", f"""
WITH {M4_SQL} SELECT DISTINCT series_id, grp, freq, horizon, n_in + horizon AS n FROM s
""")
def q_join_group_meta(spark, sf):
    e = m4_frame(spark, sf)
    return e.select("series_id", "grp", "freq", "horizon", "n").distinct()


@query("join_forecast_truth", f"""
WITH {M4_SQL} SELECT series_id, h, {r('y')} AS y, {r('f_snaive')} AS f_snaive, {r('f_naive')} AS f_naive FROM fc
""")
def q_join_forecast_truth(spark, sf):
    return rounded(m4_forecasts(spark, sf).select("series_id", "h", "y", "f_snaive", "f_naive"))


@query("attach_generated_text", f"""
WITH {DAILY_SQL},
g AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)
SELECT d.date, coalesce(g.text, '') AS text FROM d LEFT JOIN g ON g.i = d.t
""")
def q_attach_text(spark, sf):
    """i-th text (all turns in order) to the i-th row of the
    daily series; extra texts are ignored, missing ones are ''."""
    d = indexed_daily(spark, sf)
    g = tb.read(spark, sf, "conversations").withColumn("_k", F.lit(0))
    g = series_index(g, "_k", ["conv_id", "turn"], out="i", bucket=F.floor(F.col("conv_id") / F.lit(4096)))
    j = d.join(g.select("i", "text"), d.t == g.i, "left")
    return j.select("date", F.coalesce("text", F.lit("")).alias("text"))


def daily_text(spark, sf):
    """Report texts by date: one row per headline of the day."""
    return tb.news(spark, sf).select("date", "doc_id", F.col("headline").alias("text"))


DTEXT_SQL = f"nw AS ({S.NEWS}), dt AS (SELECT date, doc_id, headline AS text FROM nw)"


@query("join_text_at_origin", f"""
WITH {DAILY_SQL}, {DTEXT_SQL}, c AS (SELECT count(*) AS n FROM d)
SELECT d.t - {SEQ_LEN} AS window_id, d.date AS origin_date, dt.doc_id, dt.text
FROM d CROSS JOIN c LEFT JOIN dt ON dt.date = d.date
WHERE d.t - {SEQ_LEN} >= 0 AND d.t - {SEQ_LEN} <= c.n - {SEQ_LEN + PRED_LEN}
""")
def q_text_at_origin(spark, sf):
    """Every headline of a window's origin day (the row after its look-back)."""
    d = wo.with_count(indexed_daily(spark, sf), "series_id")
    w = d.withColumn("window_id", F.col("t") - SEQ_LEN).where((F.col("window_id") >= 0) & (F.col("window_id") <= F.col("_n") - (SEQ_LEN + PRED_LEN)))
    return w.join(daily_text(spark, sf), "date", "left").select("window_id", F.col("date").alias("origin_date"), "doc_id", "text")


def daily_prior(spark, sf):
    d = indexed_daily(spark, sf)
    return fe.with_features(d, "series_id", "t", lambda w: [fe.trailing_mean("OT", 30, w).alias("prior")], back=30)


PRIOR_SQL = f"""{DAILY_SQL}, c AS (SELECT count(*) AS n FROM d),
dp AS (SELECT *, avg(OT) OVER (ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prior FROM d),
w AS (SELECT dp.t - k.k AS window_id, CAST(k.k AS INTEGER) AS step, dp.* FROM dp CROSS JOIN c CROSS JOIN range(0, {SEQ_LEN + PRED_LEN}) k(k)
      WHERE dp.t - k.k >= 0 AND dp.t - k.k <= c.n - {SEQ_LEN + PRED_LEN})"""


@query("join_prior_slice", f"WITH {PRIOR_SQL} SELECT window_id, step, {r('prior', 9)} AS prior FROM w WHERE step >= {SEQ_LEN}")
def q_prior_slice(spark, sf):
    """The prior of every horizon step of every window: a row is exploded into
    the windows whose horizon holds it, no other steps are made."""
    d = wo.with_count(daily_prior(spark, sf), "series_id")
    d = d.withColumn("step", F.explode(F.sequence(F.lit(SEQ_LEN), F.lit(SEQ_LEN + PRED_LEN - 1)))).withColumn("window_id", F.col("t") - F.col("step"))
    w = d.where((F.col("window_id") >= 0) & (F.col("window_id") <= F.col("_n") - F.lit(SEQ_LEN + PRED_LEN)))
    return rounded(w.select("window_id", "step", "prior"), 9)


@query("join_date_slice", f"""
WITH {PRIOR_SQL} SELECT window_id, step, date AS start_date, CAST(date + INTERVAL 6 DAY AS DATE) AS end_date FROM w WHERE step < {SEQ_LEN}
""")
def q_date_slice(spark, sf):
    d = indexed_daily(spark, sf)
    w = wo.sliding_windows(d, "series_id", "t", SEQ_LEN, LABEL_LEN, PRED_LEN).filter(F.col("in_x"))
    return w.select("window_id", "step", F.col("date").alias("start_date"), F.date_add("date", 6).alias("end_date"))


ASOF_K = 2


@query("asof_text_k", f"""
WITH panel AS ({S.PANEL}), nw AS ({S.NEWS}),
rep AS (SELECT ticker, doc_id, headline, CAST(date + INTERVAL 6 DAY AS DATE) AS end_date FROM nw),
m AS (SELECT p.ticker, p.date, rep.headline, rep.end_date, rep.doc_id,
             row_number() OVER (PARTITION BY p.ticker, p.date ORDER BY rep.end_date DESC, rep.doc_id DESC) AS rk
      FROM panel p JOIN rep ON rep.ticker = p.ticker AND rep.end_date < p.date),
agg AS (SELECT ticker, date, string_agg(headline, ' ' ORDER BY end_date, doc_id) AS txt, count(*) AS n
        FROM m WHERE rk <= {ASOF_K} GROUP BY 1, 2)
SELECT p.ticker, p.date, agg.txt AS Final_Search_{ASOF_K}, coalesce(agg.n, 0) AS text_len
FROM panel p LEFT JOIN agg USING (ticker, date)
""")
def q_asof_text(spark, sf):
    """Last k reports whose span ended before each panel date (exact as-of
    join via ranks; no interval join)."""
    p = materialize(tb.ticker_panel(spark, sf).select("ticker", "date"))
    rep = tb.news(spark, sf).select("ticker", "doc_id", "headline", F.date_add("date", 6).alias("end_date"))
    m = al.asof_last_k(p, rep, "ticker", "date", "end_date", ASOF_K, right_order=["doc_id"])
    item = F.when(F.col("match_rank").isNotNull(), F.struct(-F.col("match_rank"), F.col("headline")))
    g = m.groupBy("ticker", "date").agg(F.array_sort(F.collect_list(item)).alias("_l"), F.count("match_rank").alias("text_len"))
    return g.select("ticker", "date",
                    F.when(F.col("text_len") > 0, F.array_join(F.transform("_l", lambda x: x["headline"]), " ")).alias(f"Final_Search_{ASOF_K}"),
                    "text_len")


@query("join_news_panel", f"""
WITH panel AS ({S.PANEL}), nw AS ({S.NEWS}),
a AS (SELECT ticker, date, count(*) AS n_news, arg_min(headline, doc_id) AS first_headline FROM nw GROUP BY 1, 2)
SELECT p.ticker, p.date, p.close, coalesce(a.n_news, 0) AS n_news, a.first_headline FROM panel p LEFT JOIN a USING (ticker, date)
""")
def q_news_panel(spark, sf):
    p = tb.ticker_panel(spark, sf).select("ticker", "date", "close")
    a = tb.news(spark, sf).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_news"),
                                                        F.min_by("headline", "doc_id").alias("first_headline"))
    return p.join(a, ["ticker", "date"], "left").select("ticker", "date", "close", F.coalesce("n_news", F.lit(0)).alias("n_news"),
                                                        "first_headline")


@query("token_embedding_lookup", f"""
WITH tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda s: s <> '') AS toks FROM documents),
t AS (SELECT doc_id, CAST(u.pos - 1 AS INTEGER) AS pos, u.tok AS token FROM tk, unnest(toks) WITH ORDINALITY AS u(tok, pos)),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM t)),
er AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, row_number() OVER (ORDER BY vec_id) - 1 AS er FROM embeddings),
ne AS (SELECT count(*) AS n FROM embeddings)
SELECT t.doc_id, t.pos, t.token, vocab.token_id, er.vec_id, {r('er.e0')} AS e0
FROM t JOIN vocab USING (token) CROSS JOIN ne JOIN er ON er.er = vocab.token_id % ne.n
""")
def q_token_lookup(spark, sf):
    """Token -> vector row lookup: the vocabulary (distinct tokens, ranked)
    maps token id t to embedding row t mod |embeddings|."""
    d = tb.read(spark, sf, "documents")
    t = d.select("doc_id", F.posexplode(cl.tokenize_truncate("text", None)).alias("pos", "token"))
    v = t.select("token").distinct().withColumn("_k", F.lit(0))
    v = series_index_ranged(v, "_k", "token", out="token_id").drop("_k")
    e = tb.read(spark, sf, "embeddings").withColumn("_k", F.lit(0))
    e = series_index(e, "_k", "vec_id", out="er", bucket=F.floor(F.col("vec_id") / F.lit(65536))).drop("_k")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    tv = t.join(v, "token").crossJoin(F.broadcast(n)).withColumn("er", F.col("token_id") % F.col("n"))
    out = tv.join(e.select("er", "vec_id", F.col("embedding")[0].cast("double").alias("e0")), "er")
    return rounded(out.select("doc_id", "pos", "token", "token_id", "vec_id", "e0"))


PARTNER_SEED = 3


@query("pairwise_intra_class", f"""
WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rk,
                  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
p AS (SELECT *, (rk + 1 + floor({rng.sql_uniform('label', 'vec_id', "'partner'", str(PARTNER_SEED))} * (n - 1))) % n AS pr FROM k WHERE n > 1)
SELECT p.vec_id, p.label, o.vec_id AS partner_id FROM p JOIN k o ON o.label = p.label AND o.rk = p.pr
""")
def q_pairwise(spark, sf):
    """A random other member of the same class for every sample (the
    reference draws one prototype from the same class)."""
    e = tb.read(spark, sf, "embeddings").select("vec_id", "label")
    return al.pick_partner(e, "label", "vec_id", PARTNER_SEED)


PRED_LENS = [12, 24, 36, 48]
SEEDS = [2021]


@query("grid_cross", f"""
WITH panel AS ({S.PANEL})
SELECT ticker, p.pred_len, s.seed FROM (SELECT DISTINCT ticker FROM panel)
CROSS JOIN (VALUES {', '.join(f'({x})' for x in PRED_LENS)}) p(pred_len) CROSS JOIN (VALUES {', '.join(f'({x})' for x in SEEDS)}) s(seed)
""")
def q_grid(spark, sf):
    """Experiment grid series x horizon x seed (explode of fixed lists)."""
    t = tb.ticker_panel(spark, sf).select("ticker").distinct()
    return t.select("ticker", F.explode(F.array(*[F.lit(x) for x in PRED_LENS])).alias("pred_len")) \
        .select("ticker", "pred_len", F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("seed"))


@query("ticker_year_grid", f"""
WITH panel AS ({S.PANEL}), y AS (SELECT ticker, year(min(date)) AS lo, year(max(date)) AS hi FROM panel GROUP BY 1)
SELECT ticker, CAST(k.k AS INTEGER) AS year FROM y CROSS JOIN range(1900, 2200) k(k) WHERE k.k BETWEEN lo AND hi
""")
def q_ticker_year(spark, sf):
    y = tb.ticker_panel(spark, sf).groupBy("ticker").agg(F.year(F.min("date")).alias("lo"), F.year(F.max("date")).alias("hi"))
    return y.select("ticker", F.explode(F.sequence("lo", "hi")).alias("year"))
