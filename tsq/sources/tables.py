"""Readers for the input tables and the fixture views built from them.

All builders are lazy DataFrame plans over the parquet tables; nothing goes
through the driver.  The views follow the roles of the input tables:

* ``ticker_panel``  long (ticker, date) OHLCV panel from orders x customer
* ``daily_series``  one wide daily series (``series_id='all'``) from orders
* ``event_series``  per-user event value series (ragged collection)
* ``hourly_matrix`` hour x event_type sensor matrix with natural gaps
* ``sequences``     labelled fixed-length sequences from the embeddings table
* ``news``          documents as dated news records (ticker, date, headline, summary)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the fixture mapping:
# news date = 1995-01-01 + doc_id mod 2399 days; ticker by doc_id mod 5;
# headline = first 8 words.
NEWS_EPOCH = "1995-01-01"
NEWS_DAYS = 2399
HEADLINE_WORDS = 8
# ragged-collection group names by user_id mod 6 (seasonal groups of the
# competition data set the reference evaluates on)
GROUP_NAMES = ["Yearly", "Quarterly", "Monthly", "Weekly", "Daily", "Hourly"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticker_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV panel: ticker = market segment, one row per (ticker, date).

    open/close = price of the first/last order of the day (by order key),
    high/low = max/min price, volume = number of orders.  The join is an
    equi-join on the customer key (Catalyst/AQE pick broadcast or
    sort-merge from runtime sizes); the aggregate is partial+final so a hot
    (ticker, date) group never moves more than one partial row per task.
    """
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(
        F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide single series: daily order revenue (target ``OT``) + features."""
    o = read(spark, sf_dir, "orders").select("o_totalprice", "o_orderdate")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"),
        (F.sum("o_totalprice") / F.lit(1000.0)).alias("OT"),
    ).withColumn("series_id", F.lit("all"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user series of event values ordered by time (ragged collection)."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("user_id").cast("string").alias("series_id"),
        F.element_at(F.array(*[F.lit(g) for g in GROUP_NAMES]),
                     (F.col("user_id") % 6 + 1).cast("int")).alias("grp"),
        "ts", "event_id", "value",
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def hourly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour x event_type matrix of summed values; empty cells are NULL."""
    e = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    types = ["click", "error", "purchase", "signup", "view"]
    return (
        e.groupBy(F.date_trunc("hour", "ts").alias("ts"))
        .pivot("event_type", types)
        .agg(F.sum("value"))
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sequences in long form: (sample_id, label, t, value)."""
    emb = read(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("sample_id"), "label",
        F.posexplode("embedding").alias("t", "value"),
    ).withColumn("value", F.col("value").cast("double"))


def sequence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sequences, one row each: (sample_id, label, x)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated news: ticker, date, headline, summary, source."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    tickers = F.array(*[F.lit(s) for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]])
    words = F.split(F.trim(F.col("text")), r"\s+")
    return d.select(
        "doc_id",
        F.element_at(tickers, (F.col("doc_id") % 5 + 1).cast("int")).alias("ticker"),
        F.date_add(F.lit(NEWS_EPOCH).cast("date"), (F.col("doc_id") % NEWS_DAYS).cast("int")).alias("date"),
        F.array_join(F.slice(words, 1, HEADLINE_WORDS), " ").alias("headline"),
        F.array_join(F.slice(words, HEADLINE_WORDS + 1, F.greatest(F.size(words) - HEADLINE_WORDS, F.lit(0))), " ").alias("summary"),
        "source", "lang",
    )


def col_or_null(df: DataFrame, name: str, dtype: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)
