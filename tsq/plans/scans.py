"""Queries: scans, sources, sinks and profiles.

File formats are exercised for real: each query writes a table derived
from the input tables to a fresh folder under the shared checkpoint folder
and reads it back through the reader under test; the oracle computes the
same rows directly from the parquet tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators import features as fe
from tsq.operators import metrics as me
from tsq.plans import sqlparts as S
from tsq.plans.evals import FC_SQL, model_forecasts, scaled_daily, BL
from tsq.plans.functions import CHANNELS
from tsq.plans.metrics import M4_SQL, M4_META, m4_forecasts, m4_frame
from tsq.plans.registry import query, r, rounded
from tsq.plans.windows import DAILY_SQL, EVENTS_SQL, SEQ_LEN, LABEL_LEN, indexed_daily
from tsq.session import scratch_path
from tsq.sources import files as fl
from tsq.sources import tables as tb
from tsq.operators.index import series_index


# ------------------------------------------------------------- wide CSV
WIDE_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("n_orders", T.DoubleType()),
    T.StructField("avg_price", T.DoubleType()), T.StructField("OT", T.DoubleType()),
    T.StructField("prior_history_avg", T.DoubleType()), T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
])


@query("scan_wide_csv", f"""
WITH {DAILY_SQL}
SELECT date, n_orders, {r('avg_price', 4)} AS avg_price, {r('OT')} AS OT,
       {r('avg(OT) OVER (ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)', 9)} AS prior_history_avg,
       date AS start_date, CAST(date + INTERVAL 6 DAY AS DATE) AS end_date FROM d
""")
def q_scan_wide_csv(spark, sf):
    """Write the daily wide series as CSV, read it back with an explicit
    schema, project date/features/target/prior/span (+ text if present)."""
    d = indexed_daily(spark, sf)
    d = fe.with_features(d, "series_id", "t", lambda w: [fe.trailing_mean("OT", 30, w).alias("prior_history_avg")], back=30)
    d = d.select("date", "n_orders", "avg_price", "OT", "prior_history_avg", F.col("date").alias("start_date"),
                 F.date_add("date", 6).alias("end_date"))
    path = scratch_path(spark, "wide_csv")
    d.write.option("header", True).csv(path)
    out = fl.read_wide_csv(spark, path, WIDE_SCHEMA, "OT")
    return rounded(out, avg_price=4, prior_history_avg=9)


# ------------------------------------------------------------ JSON lines
def _news_records(spark, sf):
    n = tb.news(spark, sf)
    return n.select(F.col("ticker").alias("ticker_main"), F.date_format("date", "yyyyMMdd'T'000000").alias("time_published"),
                    "headline", "summary", "source", F.col("lang").alias("topic"),
                    F.lit("N/A").alias("overall_sentiment"), "doc_id")


NEWS_REC_SQL = f"""nw AS ({S.NEWS}),
rec AS (SELECT ticker AS ticker_main, strftime(date, '%Y%m%dT000000') AS time_published, headline, summary, source,
               lang AS topic, 'N/A' AS overall_sentiment, doc_id FROM nw)"""


@query("scan_news_jsonl", f"WITH {NEWS_REC_SQL} SELECT * FROM rec")
def q_scan_news_jsonl(spark, sf):
    """News records written as JSON lines next to a file of free-text
    (malformed) lines -- the conversation turns; the reader drops the
    malformed lines."""
    path = scratch_path(spark, "news_jsonl")
    _news_records(spark, sf).write.json(path + "/good")
    tb.read(spark, sf, "conversations").select("text").write.text(path + "/bad")
    return fl.read_jsonl(spark, path + "/*", fl.NEWS_SCHEMA).select(*[f.name for f in fl.NEWS_SCHEMA.fields])


@query("sink_jsonl", f"WITH {NEWS_REC_SQL} SELECT doc_id, ticker_main, headline FROM rec")
def q_sink_jsonl(spark, sf):
    path = scratch_path(spark, "sink_jsonl")
    _news_records(spark, sf).write.mode("overwrite").json(path)
    return spark.read.schema(fl.NEWS_SCHEMA).json(path).select("doc_id", "ticker_main", "headline")


@query("sink_csv", f"WITH panel AS ({S.PANEL}) SELECT ticker, strftime(date, '%Y-%m-%d') AS date, close FROM panel")
def q_sink_csv(spark, sf):
    path = scratch_path(spark, "sink_csv")
    tb.ticker_panel(spark, sf).select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), "close") \
        .write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema("ticker string, date string, close double").option("header", True).csv(path)


# ----------------------------------------------------------- nested feeds
@query("flatten_feed", f"""
WITH nw AS ({S.NEWS})
SELECT ticker AS ticker_main, strftime(date, '%Y%m%dT000000') AS time_published, headline, summary, source,
       CASE WHEN summary = '' THEN 'N/A' ELSE lang END AS topic,
       CASE WHEN length(headline) % 2 = 1 THEN 'N/A' ELSE source END AS overall_sentiment FROM nw
""")
def q_flatten_feed(spark, sf):
    """Feed items as nested JSON (topics array empty for items without a
    summary, sentiment label missing on odd-length titles) -> flat rows."""
    n = tb.news(spark, sf)
    item = F.to_json(F.struct(
        F.col("headline").alias("title"), "summary", "source",
        F.date_format("date", "yyyyMMdd'T'000000").alias("time_published"),
        F.when(F.col("summary") == "", F.array().cast("array<struct<topic:string>>"))
         .otherwise(F.array(F.struct(F.col("lang").alias("topic")))).alias("topics"),
        F.when(F.length("headline") % 2 == 0, F.col("source")).alias("overall_sentiment_label")))
    return fl.flatten_feed(n.select("ticker", item.alias("raw")), "raw", "ticker")


@query("flatten_articles", f"""
WITH nw AS ({S.NEWS})
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, headline, summary, source FROM nw WHERE summary <> ''
""")
def q_flatten_articles(spark, sf):
    """Per (ticker, year) result lists: items without a summary arrive as
    bare strings (invalid entries) and are skipped; date = pubDate[:10]."""
    n = tb.news(spark, sf)
    obj = F.to_json(F.struct(F.col("headline").alias("title"), F.nullif("summary", F.lit("")).alias("description"),
                             F.col("source").alias("source_id"),
                             F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("pubDate")))
    raw = F.when(F.col("summary") == "", F.to_json(F.array("headline"))).otherwise(obj)
    return fl.flatten_articles(n.select("ticker", raw.alias("raw")), "raw", "ticker")


# --------------------------------------------------- wide multi-ticker frame
FIELDS = ["Open", "High", "Low", "Close", "Volume"]


@query("flatten_multiindex_download", f"""
WITH panel AS ({S.PANEL}), ds AS (SELECT DISTINCT date FROM panel), tk AS (SELECT DISTINCT ticker FROM panel)
SELECT tk.ticker, ds.date, p.open, p.high, p.low, p.close, p.volume FROM ds CROSS JOIN tk
LEFT JOIN panel p ON p.ticker = tk.ticker AND p.date = ds.date
""")
def q_flatten_multiindex(spark, sf):
    """Ticker-grouped wide download (one column per ticker x field) back to
    a long panel; field names standardised by prefix; tickers with no data
    at all skipped."""
    p = tb.ticker_panel(spark, sf)
    tickers = [r_["ticker"] for r_ in p.select("ticker").distinct().collect()]  # column names of the wide frame
    wide = p.groupBy("date").pivot("ticker", tickers).agg(
        *[F.first(f.lower()).alias(f) for f in FIELDS])
    items = [F.struct(F.lit(tk).alias("ticker"), *[F.col(f"{tk}_{f}").alias(f) for f in FIELDS]) for tk in tickers]
    long_ = wide.select("date", F.inline(F.array(*items)))
    ren = {f: ("open" if f.lower().startswith("open") else "high" if f.lower().startswith("high") else
               "low" if f.lower().startswith("low") else "close" if f.lower().startswith("close") else "volume")
           for f in FIELDS}
    long_ = long_.withColumnsRenamed(ren)
    has = long_.groupBy("ticker").agg(F.count("close").alias("_n")).filter("_n > 0").select("ticker")
    return long_.join(has, "ticker", "left_semi").select("ticker", "date", "open", "high", "low", "close", "volume")


# -------------------------------------------------------------- .ts text
@query("scan_ts_text", f"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS sample_id FROM embeddings)
SELECT sample_id, 0 AS dim, CAST(u.pos - 1 AS INTEGER) AS t, {r('CAST(u.v AS DOUBLE)')} AS value, CAST(label AS VARCHAR) AS label
FROM e, unnest(embedding) WITH ORDINALITY AS u(v, pos)
""")
def q_scan_ts_text(spark, sf):
    """Embeddings written as a labelled .ts text file (header + one line per
    sample, in vec_id order), parsed back to long rows."""
    e = tb.read(spark, sf, "embeddings")
    line = F.concat(F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ","),
                    F.lit(":"), F.col("label").cast("string"))
    header = spark.createDataFrame([("@problemName embeddings",), ("@timeStamps false",), ("@univariate true",),
                                    ("@classLabel true",), ("@data",)], "line string")
    path = scratch_path(spark, "ts_text")
    # range-sorted body: part files follow vec_id order; the header is its
    # own (first) part file, skipped by the reader wherever it is
    body = e.orderBy("vec_id").select(line.alias("line"))
    header.unionByName(body).write.text(path)
    out = fl.read_ts_text(spark, path)
    return rounded(out.select("sample_id", "dim", F.col("t").cast("int").alias("t"), "value", "label"))


# ------------------------------------------------------- ragged collection
@query("scan_m4_collection", f"""
WITH {M4_SQL} SELECT series_id, grp, freq, horizon, t, {r('value')} AS value,
       CASE WHEN t < n_in THEN 'train' ELSE 'test' END AS part FROM s
""")
def q_scan_m4(spark, sf):
    e = m4_frame(spark, sf)
    return rounded(e.select("series_id", "grp", "freq", "horizon", "t", "value",
                            F.when(F.col("t") < F.col("n_in"), "train").otherwise("test").alias("part")))


@query("filter_group_collect", f"""
WITH {EVENTS_SQL} SELECT series_id, t, {r('value')} AS value FROM ev WHERE grp = 'Monthly' AND value IS NOT NULL AND NOT isnan(value)
""")
def q_filter_group(spark, sf):
    from tsq.plans.windows import indexed_events
    e = indexed_events(spark, sf)
    return rounded(e.filter((F.col("grp") == "Monthly") & F.col("value").isNotNull() & ~F.isnan("value"))
                   .select("series_id", "t", "value"))


# ---------------------------------------------------------- sensor files
@query("scan_sensor_matrix", f"""
WITH h AS ({S.HOURLY}), ht AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS g, count(*) OVER () AS n FROM h),
sp AS (SELECT *, CASE WHEN g < n / 2 THEN 'train' ELSE 'test' END AS split FROM ht)
SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY ts) - 1 AS BIGINT) AS t,
       {', '.join(f"{r(f'coalesce(\"{c}\", 0.0)')} AS \"{c}\"" for c in CHANNELS)} FROM sp
""")
def q_scan_sensor(spark, sf):
    """Hour x channel matrix written as train/test CSV files whose first
    column is the timestamp; read back, first column dropped, NaN -> 0."""
    from tsq.operators.clean import nan_to_num
    h = tb.hourly_matrix(spark, sf).withColumn("_k", F.lit(0))
    h = series_index(h, "_k", "ts", out="g").drop("_k")
    n = h.agg(F.count(F.lit(1)).alias("n"))
    h = h.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("g") < F.col("n") / 2, "train").otherwise("test"))
    path = scratch_path(spark, "sensor")
    h.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *CHANNELS, "split") \
        .write.partitionBy("split").option("header", True).csv(path)
    schema = "timestamp string, " + ", ".join(f"{c} double" for c in CHANNELS) + ", split string"
    back = spark.read.schema(schema).option("header", True).csv(path)
    back = series_index(back.withColumn("_ts", F.to_timestamp("timestamp")), "split", "_ts")
    cols = back.columns[1:]  # drop the first (timestamp) column
    back = back.select(*cols)
    return rounded(back.select("split", "t", *[nan_to_num(c).alias(c) for c in CHANNELS]))


# ---------------------------------------------------------------- unions
@query("union_panel", f"""
WITH panel AS ({S.PANEL})
SELECT ticker, date, close, CASE WHEN ticker = 'BUILDING' THEN volume END AS volume,
       CASE WHEN ticker = 'MACHINERY' THEN high END AS high FROM panel
""")
def q_union_panel(spark, sf):
    """Per-ticker frames whose columns differ, concatenated by name."""
    p = tb.ticker_panel(spark, sf)
    parts = [p.filter(F.col("ticker") == "BUILDING").select("ticker", "date", "close", "volume"),
             p.filter(F.col("ticker") == "MACHINERY").select("ticker", "date", "close", "high"),
             p.filter(~F.col("ticker").isin("BUILDING", "MACHINERY")).select("ticker", "date", "close")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


@query("header_complete_order", f"""
WITH panel AS ({S.PANEL})
SELECT {', '.join(
    ["strftime(date, '%Y-%m') AS Month" if c == "Month" else "strftime(date, '%Y-%m-%d') AS date" if c == "date"
     else f'CAST(NULL AS VARCHAR) AS "{c}"' if c in ("start_date", "end_date", "Final_Search_2", "Final_Search_4", "Final_Search_6")
     else f'CAST(NULL AS DOUBLE) AS "{c}"' for c in fe.PANEL_HEADER]
    + ["ticker", "open", "high", "low", "close", "CAST(NULL AS DOUBLE) AS adj_close", "close AS close_used", "volume",
       "CAST(NULL AS DOUBLE) AS log_return", "CAST(NULL AS DOUBLE) AS pct_change"])} FROM panel
""")
def q_header_complete(spark, sf):
    """Missing header columns added as NULL, columns ordered: fixed header,
    stock columns, then the sorted extras (none here)."""
    p = tb.ticker_panel(spark, sf).withColumn("close_used", F.col("close")) \
        .withColumn("Month", F.date_format("date", "yyyy-MM")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    strings = {"start_date", "end_date", "Final_Search_2", "Final_Search_4", "Final_Search_6"}
    for c in fe.PANEL_HEADER + fe.STOCK_COLUMNS:
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("string" if c in strings else "double"))
    extra = sorted(c for c in p.columns if c not in fe.PANEL_HEADER + fe.STOCK_COLUMNS)
    return p.select(*fe.PANEL_HEADER, *fe.STOCK_COLUMNS, *extra)


# ----------------------------------------------------------------- sinks
H_MAX = max(h for _, _, h in M4_META)


@query("sink_m4_forecast", f"""
WITH {M4_SQL}
SELECT series_id, grp, {', '.join(f"{r(f'max(CASE WHEN h = {k} THEN f_snaive END)')} AS V{k}" for k in range(1, H_MAX + 1))}
FROM fc GROUP BY series_id, grp
""")
def q_sink_m4(spark, sf):
    """Forecasts pivoted to V1..Vh per series, written as one folder per
    seasonal group and read back."""
    f = m4_forecasts(spark, sf)
    wide = f.groupBy("series_id", "grp").pivot("h", list(range(1, H_MAX + 1))).agg(F.first("f_snaive"))
    wide = wide.select("series_id", "grp", *[F.col(str(k)).alias(f"V{k}") for k in range(1, H_MAX + 1)])
    path = scratch_path(spark, "m4_forecast")
    wide.write.partitionBy("grp").parquet(path)
    return rounded(spark.read.parquet(path))


RESULT_COLS = ["mse", "mae", "rmse", "mape", "mspe"]


def _eval_metrics(spark, sf):
    from tsq.operators import forecast as fc
    from tsq.plans.evals import EVAL_PREDS, PROMPT_WEIGHT
    z = scaled_daily(spark, sf).withColumn("_lo", F.col("_n") - F.col("n_test") - F.lit(SEQ_LEN))
    m = model_forecasts(z, SEQ_LEN, EVAL_PREDS, lo="_lo", hi="_n")
    m = m.withColumn("yb", fc.blend_prior(F.col("yhat"), F.col("pz"), PROMPT_WEIGHT))
    return m.groupBy("model", "pred_len").agg(*me.metric_bundle("y", "yb"))


EVAL_SQL = f"""{FC_SQL}, ev AS (SELECT model, pred_len, avg(({BL} - y) * ({BL} - y)) AS mse, avg(abs({BL} - y)) AS mae,
    sqrt(avg(({BL} - y) * ({BL} - y))) AS rmse, avg(abs(({BL} - y) / nullif(y, 0))) AS mape,
    avg((({BL} - y) / nullif(y, 0)) * (({BL} - y) / nullif(y, 0))) AS mspe FROM m GROUP BY model, pred_len)"""


@query("sink_results", f"""
WITH {EVAL_SQL}
SELECT 'long_term_forecast' AS task, model, pred_len, {', '.join(f'{r(c)} AS {c}' for c in RESULT_COLS)} FROM ev
""")
def q_sink_results(spark, sf):
    """Metric rows appended to a results table partitioned by task, read back."""
    res = _eval_metrics(spark, sf).withColumn("task", F.lit("long_term_forecast"))
    path = scratch_path(spark, "results")
    res.write.mode("append").partitionBy("task").parquet(path)
    return rounded(spark.read.parquet(path).select("task", "model", "pred_len", *RESULT_COLS))


@query("parse_run_log", f"""
WITH {EVAL_SQL}
SELECT 'long_term_forecast' AS task, 'Daily' AS dataset, model, {SEQ_LEN} AS seq_len, {LABEL_LEN} AS label_len, pred_len,
       {', '.join(f'{r(c)} AS {c}' for c in RESULT_COLS)},
       CAST(rank() OVER (PARTITION BY pred_len ORDER BY mse) AS INTEGER) AS rank_mse FROM ev
""")
def q_parse_run_log(spark, sf):
    """Run log written in the reference's format (setting line ending in two
    spaces, metrics line, blank line) and parsed back into a leaderboard."""
    res = _eval_metrics(spark, sf)
    setting = F.concat_ws("_", F.lit("long_term_forecast"), F.lit("Daily"), "model",
                          F.lit(f"sl{SEQ_LEN}"), F.lit(f"ll{LABEL_LEN}"), F.concat(F.lit("pl"), F.col("pred_len").cast("string")))
    metrics = F.concat_ws(", ", *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in RESULT_COLS])
    rec = F.concat(setting, F.lit("  \n"), metrics, F.lit("\n"))
    path = scratch_path(spark, "run_log")
    res.select(rec.alias("value")).write.text(path)
    p = fl.parse_run_log(spark, path)
    parts = F.split("setting", "_")
    p = p.select(F.lit("long_term_forecast").alias("task"), F.element_at(parts, 4).alias("dataset"),
                 F.regexp_extract("setting", r"^long_term_forecast_Daily_(.+)_sl\d+_ll\d+_pl\d+$", 1).alias("model"),
                 F.regexp_extract("setting", r"_sl(\d+)_", 1).cast("int").alias("seq_len"),
                 F.regexp_extract("setting", r"_ll(\d+)_", 1).cast("int").alias("label_len"),
                 F.regexp_extract("setting", r"_pl(\d+)$", 1).cast("int").alias("pred_len"), *RESULT_COLS)
    # leaderboard: rank inside a horizon (one row per model: a small group)
    from pyspark.sql import Window
    p = p.withColumn("rank_mse", F.rank().over(Window.partitionBy("pred_len").orderBy("mse")))
    return rounded(p)


# -------------------------------------------------------------- profiles
_PROFILE_TYPES = [("ticker", "string"), ("date", "date"), ("open", "double"), ("high", "double"),
                  ("low", "double"), ("close", "double"), ("volume", "double")]


@query("column_profile", f"""
WITH panel AS ({S.PANEL})
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n, count(*) - count({c}) AS nulls FROM panel" for c, t in _PROFILE_TYPES)})
""")
def q_column_profile(spark, sf):
    return fl.column_profile(tb.ticker_panel(spark, sf))


@query("non_numeric_profile", """
WITH pg AS (SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS tail,
                   regexp_extract(url, '^https?://([^/]*)/', 1) AS host,
                   regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1) AS lang FROM pages),
l AS (SELECT page_id, 'tail' AS "column", tail AS value FROM pg UNION ALL SELECT page_id, 'host', host FROM pg
      UNION ALL SELECT page_id, 'lang', lang FROM pg),
b AS (SELECT "column", value, min(page_id) AS first_seen FROM l WHERE value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL
      GROUP BY 1, 2)
SELECT "column", value, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first_seen, value) AS rk FROM b)
WHERE rk <= 20
""")
def q_non_numeric(spark, sf):
    """Columns of the page table parsed from URLs that hold non-numeric
    values: up to 20 distinct bad values each, in order of first appearance."""
    p = tb.read(spark, sf, "pages")
    pg = p.select("page_id", F.regexp_extract("url", r"/([^/]*)$", 1).alias("tail"),
                  F.regexp_extract("url", r"^https?://([^/]*)/", 1).alias("host"),
                  F.regexp_extract("url", r"^https?://[^/]*/([^/]*)/", 1).alias("lang"))
    return fl.non_numeric_profile(pg, "page_id", ["tail", "host", "lang"], 20)
