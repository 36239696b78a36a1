"""Queries: projections, filters, cleaning and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsq.operators import clean as cl
from tsq.operators import features as fe
from tsq.operators.index import series_index, series_index_ranged
from tsq.plans import sqlparts as S
from tsq.plans.features import _stock, _stock_sql
from tsq.plans.functions import CHANNELS, HOURLY_SQL, hourly_long
from tsq.plans.registry import dbl, query, r, rounded
from tsq.plans.windows import PANEL_SQL, indexed_panel
from tsq.session import materialize
from tsq.sources import tables as tb

KEEP_TICKERS = ["BUILDING", "MACHINERY"]


@query("filter_isin", f"""
WITH panel AS ({S.PANEL}) SELECT ticker, date, close FROM panel WHERE ticker IN ('BUILDING', 'MACHINERY')
""")
def q_filter_isin(spark, sf):
    return tb.ticker_panel(spark, sf).filter(F.col("ticker").isin(KEEP_TICKERS)).select("ticker", "date", "close")


URL_TAIL = r"/([^/]*)$"


@query("coerce_numeric", """
SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS raw,
       TRY_CAST(regexp_extract(url, '/([^/]*)$', 1) AS DOUBLE) AS num FROM pages
""")
def q_coerce_numeric(spark, sf):
    """Last URL path segment as a number, NULL when not numeric."""
    p = tb.read(spark, sf, "pages")
    raw = F.regexp_extract("url", URL_TAIL, 1)
    return p.select("page_id", raw.alias("raw"), raw.try_cast("double").alias("num"))


# date strings derived from order dates in the report formats the
# reference cleans (one format per order key, plus day-0 and junk cases)
def date_strings(spark, sf):
    o = tb.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 7
    s = (F.when(k == 0, F.date_format("d", "yyyy-MM-dd"))
         .when(k == 1, F.date_format("d", "yyyy MM/dd"))
         .when(k == 2, F.date_format("d", "yyyy/MM/dd"))
         .when(k == 3, F.date_format("d", "yyyyMMdd"))
         .when(k == 4, F.concat(F.date_format("d", "yyyy-MM"), F.lit("-0")))
         .when(k == 5, F.concat_ws("-", F.year("d").cast("string"), F.month("d").cast("string"), F.dayofmonth("d").cast("string")))
         .otherwise(F.lit("n/a")))
    return o.select("o_orderkey", s.alias("date_str"))


DATES_SQL = """ds AS (SELECT o_orderkey, CASE o_orderkey % 7
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y %m/%d')
    WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d')
    WHEN 4 THEN strftime(o_orderdate, '%Y-%m') || '-0'
    WHEN 5 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR)
    ELSE 'n/a' END AS date_str FROM orders)"""

CLEAN_DATE_SQL = """CAST(coalesce(try_strptime(date_str, '%Y-%m-%d'), try_strptime(date_str, '%Y %m/%d'),
    try_strptime(date_str, '%Y/%m/%d'), try_strptime(date_str, '%Y%m%d'),
    CASE WHEN len(string_split(replace(replace(date_str, '/', '-'), ' ', '-'), '-')) >= 3
          AND string_split(replace(replace(date_str, '/', '-'), ' ', '-'), '-')[3] = '0'
         THEN try_strptime(array_to_string(list_concat(string_split(replace(replace(date_str, '/', '-'), ' ', '-'), '-')[1:2], ['01'],
                  string_split(replace(replace(date_str, '/', '-'), ' ', '-'), '-')[4:]), '-'), '%Y-%m-%d') END) AS DATE)"""


@query("clean_date_multi", f"WITH {DATES_SQL} SELECT o_orderkey, date_str, {CLEAN_DATE_SQL} AS date FROM ds")
def q_clean_date(spark, sf):
    d = date_strings(spark, sf)
    return d.select("o_orderkey", "date_str", cl.clean_date_multi("date_str").alias("date"))


@query("coerce_date_drop", f"""
WITH {DATES_SQL} SELECT o_orderkey, CAST(try_strptime(date_str, '%Y-%m-%d') AS DATE) AS date FROM ds
WHERE try_strptime(date_str, '%Y-%m-%d') IS NOT NULL
""")
def q_coerce_date_drop(spark, sf):
    """Unparsable dates -> NULL, rows dropped (single ISO format)."""
    d = date_strings(spark, sf).select("o_orderkey", F.to_date(F.try_to_timestamp("date_str", F.lit("y-M-d"))).alias("date"))
    return d.dropna(subset=["date"])


RATIO_SQL = """(CASE WHEN l_tax <> 0 THEN l_discount / l_tax WHEN l_discount > 0 THEN CAST('inf' AS DOUBLE)
                WHEN l_discount < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END)"""


@query("inf_to_null", f"""
SELECT l_orderkey, l_linenumber, {r(f"CASE WHEN isfinite({RATIO_SQL}) THEN {RATIO_SQL} END")} AS ratio FROM lineitem
""")
def q_inf_to_null(spark, sf):
    li = tb.read(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", cl.inf_to_null(cl.ieee_divide("l_discount", "l_tax")).alias("ratio")))


@query("nan_to_num", f"""
SELECT l_orderkey, l_linenumber, {r(f"CASE WHEN isnan({RATIO_SQL}) THEN 0.0 WHEN {RATIO_SQL} = CAST('inf' AS DOUBLE) THEN {dbl(cl.MAX_DOUBLE)} WHEN {RATIO_SQL} = CAST('-inf' AS DOUBLE) THEN {dbl(-cl.MAX_DOUBLE)} ELSE {RATIO_SQL} END")} AS ratio
FROM lineitem
""")
def q_nan_to_num(spark, sf):
    li = tb.read(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", cl.nan_to_num(cl.ieee_divide("l_discount", "l_tax")).alias("ratio")))


@query("dropna_subset", f"""
SELECT ticker, date, log_return, his_avg_1 FROM ({_stock_sql()}) WHERE log_return IS NOT NULL AND isfinite(log_return)
  AND his_avg_1 IS NOT NULL AND isfinite(his_avg_1)
""")
def q_dropna(spark, sf):
    f = _stock(spark, sf).select("ticker", "date", "log_return", "his_avg_1")
    return cl.dropna_finite(f, ["log_return", "his_avg_1"])


@query("coalesce_price", f"""
WITH panel AS ({S.PANEL}), c AS (SELECT ticker FROM panel GROUP BY ticker HAVING count(close) > 0)
SELECT ticker, date, {r('close')} AS close_used FROM panel WHERE ticker IN (SELECT ticker FROM c)
""")
def q_coalesce_price(spark, sf):
    """close_used = adjusted close when present else close; series without
    any usable price are skipped (the panel has no adjusted close)."""
    p = tb.ticker_panel(spark, sf).withColumn("adj_close", F.lit(None).cast("double"))
    p = p.withColumn("close_used", F.coalesce("adj_close", "close"))
    ok = p.groupBy("ticker").agg(F.count("close_used").alias("n")).filter("n > 0").select("ticker")
    return rounded(p.join(ok, "ticker", "left_semi").select("ticker", "date", "close_used"))


def _numeric_feature_columns():
    """Numeric columns of the feature table in its output order."""
    extra = sorted([f"lag_{k}" for k in range(1, 8)] + [f"rolling_mean_{n}" for n in range(1, 8)]
                   + [f"rolling_std_{n}" for n in range(1, 8)] + [f"sma_{s}" for s in fe.SMA_SPANS]
                   + ["rsi_14", "macd", "macd_signal", "macd_hist", "bb_sma20", "bb_std20", "bb_upper",
                      "bb_lower", "volatility_20_ann"])
    strings = {"Month", "start_date", "date", "end_date", "Final_Search_2", "Final_Search_4", "Final_Search_6", "ticker"}
    return [c for c in fe.PANEL_HEADER + fe.STOCK_COLUMNS + extra if c not in strings and c != "close_used"]


_NUM = _numeric_feature_columns()


@query("select_numeric_features", f"""
WITH s AS ({_stock_sql()}),
u AS (UNPIVOT s ON {', '.join(f'"{c}"' for c in _NUM)} INTO NAME "column" VALUE v),
p AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(_NUM))}) x("column", pos))
SELECT u."column", p.pos FROM u JOIN p USING ("column") WHERE isfinite(v)
GROUP BY u."column", p.pos HAVING count(v) > 0 AND stddev_pop(v) <> 0
""")
def q_select_numeric(spark, sf):
    """Kept feature columns of the panel feature table (not all-null, not
    constant), target excluded."""
    f = _stock(spark, sf).drop("close_used")
    return cl.select_numeric_features(f, exclude=["target"])


@query("impute_mean", f"""
WITH h AS ({S.HOURLY})
SELECT ts, {', '.join(f'{r(f"coalesce({c}, (SELECT avg({c}) FROM h), 0.0)")} AS {c}' if c != 'view' else f'{r("coalesce(\"view\", (SELECT avg(\"view\") FROM h), 0.0)")} AS "view"' for c in CHANNELS)}
FROM h
""")
def q_impute_mean(spark, sf):
    h = tb.hourly_matrix(spark, sf)
    return rounded(cl.impute_mean(h, CHANNELS))


def hourly_gappy(spark, sf):
    """Hour x channel long form with the natural NULL cells kept."""
    h = tb.hourly_matrix(spark, sf).withColumn("_k", F.lit(0))
    h = series_index(h, "_k", "ts").drop("_k")
    return h.unpivot(["ts", "t"], CHANNELS, "channel", "value")


GAPPY_SQL = f"""h AS ({S.HOURLY}), ht AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t FROM h),
hg AS ({' UNION ALL '.join(f"SELECT ts, t, '{c}' AS channel, \"{c}\" AS value FROM ht" for c in CHANNELS)})"""


@query("impute_ffill_bfill", f"""
WITH {GAPPY_SQL},
f AS (SELECT ts, t, channel, coalesce(value,
        last_value(value IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM hg)
SELECT ts, channel, {r('coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS value FROM f
""")
def q_ffill_bfill(spark, sf):
    g = hourly_gappy(spark, sf)
    return rounded(cl.impute_ffill_bfill(g, "channel", "t", ["value"]).select("ts", "channel", "value"))


@query("impute_linear", f"""
WITH {GAPPY_SQL},
a AS (SELECT ts, t, channel, value,
        last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
        last_value(value IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
        first_value(value IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM hg)
SELECT ts, channel, {r('CASE WHEN value IS NOT NULL THEN value WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END')} AS value FROM a
""")
def q_impute_linear(spark, sf):
    g = hourly_gappy(spark, sf)
    return rounded(cl.impute_linear(g, "channel", "t", ["value"]).select("ts", "channel", "value"))


NEWS_SQL = f"nw AS ({S.NEWS})"


@query("fill_text_null", f"WITH {NEWS_SQL} SELECT doc_id, coalesce(nullif(summary, ''), 'null') AS summary FROM nw")
def q_fill_text_null(spark, sf):
    n = tb.news(spark, sf)
    return n.select("doc_id", cl.fill_text_null("summary").alias("summary"))


@query("missing_ratio", f"WITH {NEWS_SQL} SELECT {r('avg(CAST(nullif(summary, \'\') IS NULL AS DOUBLE)) * 100.0')} AS missing_ratio FROM nw")
def q_missing_ratio(spark, sf):
    n = tb.news(spark, sf)
    return rounded(n.agg((F.avg(F.nullif("summary", F.lit("")).isNull().cast("double")) * F.lit(100.0)).alias("missing_ratio")))


@query("rename_column", f"WITH {NEWS_SQL} SELECT doc_id, summary AS final_sum FROM nw")
def q_rename(spark, sf):
    return tb.news(spark, sf).select("doc_id", "summary").withColumnRenamed("summary", "final_sum")


@query("add_date_span", f"""
WITH panel AS ({S.PANEL}) SELECT ticker, date, date AS start_date, CAST(date + INTERVAL 6 DAY AS DATE) AS end_date FROM panel
""")
def q_add_date_span(spark, sf):
    p = tb.ticker_panel(spark, sf)
    return p.select("ticker", "date", F.col("date").alias("start_date"), F.date_add("date", 6).alias("end_date"))


@query("clean_tickers", "SELECT page_id, translate(url, '.', '-') AS url_clean FROM pages")
def q_clean_tickers(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", cl.clean_tickers("url").alias("url_clean"))


@query("compose_text", f"""
WITH {NEWS_SQL} SELECT doc_id, trim(coalesce(headline, '') || ' ' || coalesce(summary, '')) AS text FROM nw
WHERE trim(coalesce(headline, '') || ' ' || coalesce(summary, '')) <> ''
""")
def q_compose_text(spark, sf):
    n = tb.news(spark, sf).select("doc_id", cl.compose_text("headline", "summary").alias("text"))
    return n.filter(F.col("text") != "")


# Fixed prompt wording of the reference (forecast prompt wrapper)
PROMPT_START = "<|start_prompt|Make predictions about the future based on the following information: "
PROMPT_END = "<|<end_prompt>|>"


@query("prompt_template", f"""
SELECT conv_id, turn, '{PROMPT_START}' || text || '{PROMPT_END}' AS prompt FROM conversations
""")
def q_prompt(spark, sf):
    c = tb.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit(PROMPT_START), "text", F.lit(PROMPT_END)).alias("prompt"))


TOKEN_MAX = 64


@query("tokenize_truncate", f"""
WITH tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda s: s <> '') AS toks FROM documents)
SELECT doc_id, CAST(u.pos - 1 AS INTEGER) AS pos, u.tok AS token
FROM tk, unnest(list_slice(toks, 1, {TOKEN_MAX})) WITH ORDINALITY AS u(tok, pos)
""")
def q_tokenize(spark, sf):
    d = tb.read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(cl.tokenize_truncate("text", TOKEN_MAX)).alias("pos", "token"))


LIMIT_SAMPLES = 100


@query("limit_samples", f"""
WITH s AS ({S.SEQUENCES}), ids AS (SELECT DISTINCT sample_id FROM s ORDER BY sample_id LIMIT {LIMIT_SAMPLES})
SELECT sample_id, t, {r('value')} AS value FROM s WHERE sample_id IN (SELECT sample_id FROM ids)
""")
def q_limit_samples(spark, sf):
    """First n samples with all their rows (the sampling operator itself)."""
    s = tb.sequences(spark, sf)
    ids = s.select("sample_id").distinct().orderBy("sample_id").limit(LIMIT_SAMPLES)
    return rounded(s.join(ids, "sample_id", "left_semi").select("sample_id", "t", "value"))


LIMIT_SHARE = 0.15


def first_samples(df, key, limit):
    """The rows of the first samples in order of ``key``: ``limit`` of them if
    it is over 1, else that share of all samples (rounded down).  The samples
    are ranked by a ranged sort, whatever their number."""
    ids = series_index_ranged(df.select(key).distinct().withColumn("_all", F.lit(0)), "_all", key, "_rank")
    most = F.lit(int(limit)) if limit > 1 else F.floor(F.lit(float(limit)) * F.col("_n"))
    n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))  # one row
    return df.join(ids.crossJoin(F.broadcast(n)).where(F.col("_rank") < most).select(key), key, "left_semi")


@query("limit_samples_share", f"""
WITH s AS ({S.SEQUENCES}), ids AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM s))
SELECT sample_id, t, {r('value')} AS value FROM s WHERE sample_id IN (SELECT sample_id FROM ids WHERE rk <= floor({LIMIT_SHARE}::DOUBLE * n))
""")
def q_limit_samples_share(spark, sf):
    """The first share of the samples with all their rows."""
    return rounded(first_samples(tb.sequences(spark, sf), "sample_id", LIMIT_SHARE).select("sample_id", "t", "value"))


@query("channels_to_rows", f"""
WITH {GAPPY_SQL} SELECT ts, channel, {r('value')} AS value FROM hg
""")
def q_channels_to_rows(spark, sf):
    return rounded(hourly_gappy(spark, sf).select("ts", "channel", "value"))


@query("rows_to_channels", f"""
WITH {GAPPY_SQL} SELECT ts, {', '.join(f"{r(f'max(value) FILTER (WHERE channel = {chr(39)}{c}{chr(39)})')} AS \"{c}\"" for c in CHANNELS)} FROM hg GROUP BY ts
""")
def q_rows_to_channels(spark, sf):
    g = hourly_gappy(spark, sf)
    return rounded(g.groupBy("ts").pivot("channel", CHANNELS).agg(F.max("value")))
