"""File sources and sinks: CSV / JSON lines / nested feeds / .ts text /
run logs, plus column profiles.

Readers take explicit schemas (no inference pass over large inputs) and
keep the reference's tolerance rules: malformed JSON lines are dropped,
non-object feed entries are skipped, missing text becomes ''.  Line order,
where the format depends on it (.ts samples, run logs), comes from the
file-ordered scan id turned into dense positions with the distributed
index, never from a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators.index import series_index


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType, target: str,
                  text_cols: Sequence[str] = ("Final_Search_2", "Final_Search_4", "Final_Search_6", "Final_Output"),
                  text_len: int = 2) -> DataFrame:
    """Wide series CSV: date, features, target, prior_history_avg,
    start/end dates, and the text column ``Final_Search_{text_len}`` only
    when the file has it."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    feats = [c for c in df.columns if c not in ("date", target, "prior_history_avg", "start_date", "end_date")
             and c not in text_cols]
    cols = ["date", *feats, target, "prior_history_avg", "start_date", "end_date"]
    tname = f"Final_Search_{text_len}"
    if tname in df.columns:
        cols.append(tname)
    return df.select(*cols)


NEWS_SCHEMA = T.StructType([
    T.StructField("ticker_main", T.StringType()), T.StructField("time_published", T.StringType()),
    T.StructField("headline", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("topic", T.StringType()),
    T.StructField("overall_sentiment", T.StringType()), T.StructField("doc_id", T.LongType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with malformed lines silently dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


FEED_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("time_published", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StructType([T.StructField("topic", T.StringType())]))),
    T.StructField("overall_sentiment_label", T.StringType()),
])


def flatten_feed(raw: DataFrame, json_col: str, ticker_col: str) -> DataFrame:
    """Nested feed item -> flat news record: first topic or 'N/A',
    title -> headline, sentiment label default 'N/A'."""
    it = F.from_json(F.col(json_col), FEED_SCHEMA)
    d = raw.select(F.col(ticker_col).alias("ticker_main"), it.alias("it"))
    return d.select("ticker_main", F.col("it.time_published").alias("time_published"),
                    F.col("it.title").alias("headline"), F.col("it.summary").alias("summary"),
                    F.col("it.source").alias("source"),
                    F.coalesce(F.get(F.col("it.topics"), 0)["topic"], F.lit("N/A")).alias("topic"),
                    F.coalesce(F.col("it.overall_sentiment_label"), F.lit("N/A")).alias("overall_sentiment"))


ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("source_id", T.StringType()), T.StructField("pubDate", T.StringType()),
])


def flatten_articles(raw: DataFrame, json_col: str, ticker_col: str) -> DataFrame:
    """Article entries: non-object entries skipped, date = first 10
    characters of pubDate, missing text fields -> ''."""
    objs = raw.filter(F.substring(F.ltrim(F.col(json_col)), 1, 1) == "{")
    a = F.from_json(F.col(json_col), ARTICLE_SCHEMA)
    d = objs.select(F.col(ticker_col).alias("ticker"), a.alias("a"))
    return d.select("ticker", F.coalesce(F.substring("a.pubDate", 1, 10), F.lit("")).alias("date"),
                    F.coalesce("a.title", F.lit("")).alias("headline"),
                    F.coalesce("a.description", F.lit("")).alias("summary"),
                    F.coalesce("a.source_id", F.lit("")).alias("source"))


def ordered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Text lines with their 0-based position in file order (the scan id
    is file-ordered; dense positions come from the distributed index)."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    text = reader.text(path)
    if not text.inputFiles():
        raise FileNotFoundError(f"no file in {path} matches {pattern or '*'}")
    lines = text.withColumn("_id", F.monotonically_increasing_id()) \
        .withColumn("_f", F.input_file_name())
    return series_index(lines, "_f", "_id", out="line_no",
                        bucket=F.shiftright(F.col("_id"), 33)).drop("_id")


def read_ts_text(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Labelled multivariate .ts text: '@' header lines skipped, each data
    line 'v1,v2,...:w1,w2,...:label' (dimensions, then the label) -> long rows
    (sample_id, dim, t, value, label); '?' or unparsable values -> NULL.
    ``pattern`` (a glob) chooses files by name; no match is an error."""
    ln = ordered_lines(spark, path, pattern)
    data = ln.filter((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("@"))
    # samples are numbered across part files in (file name, line) order
    data = series_index(data, None, ["_f", "line_no"], out="sample_id",
                        bucket=F.struct(F.col("_f"), F.floor(F.col("line_no") / F.lit(65536))))
    parts = F.split("value", ":")
    dims = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return data.select("sample_id", F.element_at(parts, -1).alias("label"), F.posexplode(dims).alias("dim", "line")) \
        .select("sample_id", "label", "dim", F.posexplode(F.split("line", ",")).alias("t", "raw")) \
        .select("sample_id", "dim", "t", F.col("raw").try_cast("double").alias("value"), "label")


# run log: setting line, metrics line, blank line
_METRIC_RE = r"mse:([^,]+), mae:([^,]+), rmse:([^,]+), mape:([^,]+), mspe:(.+)"


def parse_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run-result log -> table; a metrics line belongs to the line before
    it (equi-join on line_no - 1, no window over the file)."""
    ln = ordered_lines(spark, path)
    m = ln.filter(F.col("value").startswith("mse:"))
    s = ln.select("_f", F.col("line_no").alias("_sl"), F.trim("value").alias("setting"))
    j = m.join(s, (m["_f"] == s["_f"]) & (s["_sl"] == m["line_no"] - 1)).drop(s["_f"])
    out = j.select("setting", *[F.regexp_extract("value", _METRIC_RE, i + 1).cast("double").alias(n)
                                for i, n in enumerate(["mse", "mae", "rmse", "mape", "mspe"])])
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """Rows, type and null count of every column in one aggregate pass."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"_n_{i}")
                                                 for i, c in enumerate(df.columns)]
    a = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                      F.col("_rows").alias("n"), F.col(f"_n_{i}").alias("nulls")) for i, c in enumerate(df.columns)]
    return a.select(F.inline(F.array(*items)))


def non_numeric_profile(df: DataFrame, order: str, cols: Sequence[str], limit: int = 20) -> DataFrame:
    """Per text column, its non-numeric values (distinct, in order of first
    appearance by ``order``), at most ``limit`` per column."""
    long_ = df.select(order, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                                 for c in cols])))
    bad = long_.filter(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull())
    first = bad.groupBy("column", "value").agg(F.min(order).alias("first_seen"))
    ranked = series_index(first, "column", ["first_seen", "value"], out="_r",
                          bucket=F.floor(F.col("first_seen").cast("double") / F.lit(65536.0)))
    return ranked.filter(F.col("_r") < limit).select("column", "value", "first_seen")
