"""Structured Streaming versions of the core operators.

Sources are file streams over the input tables; every query runs with
``trigger(availableNow=True)`` and writes through ``foreachBatch`` to a
folder under the shared checkpoint folder (never a driver-side memory
sink).  Aggregations run in update mode: each micro-batch appends its
updated rows tagged with the batch id, and :func:`latest` keeps the last
version per key (an upsert without a table format).  State is bounded by
the watermark everywhere; sessions and per-key state emit in append mode, and
a finite input is closed by a last row far in the future.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tsq.session import scratch_path


#: Files of a micro-batch, at most.
FILES_PER_BATCH = 64
#: Event time of the row that ends a finite input: later than all others (pandas ends in 2262).
END_OF_INPUT = "2250-01-01 00:00:00"


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def disorder(spark: SparkSession, path: str, ts: str = "ts") -> str:
    """The watermark delay at which no row of a stored table is late when its
    files are read in the order of their modification, plus an hour: the most
    that a file begins before the end of the files ahead of it.  One row per
    file is compared."""
    files = (spark.read.parquet(path).groupBy(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
             .agg(F.min(F.col(ts).cast("timestamp")).alias("lo"), F.max(F.col(ts).cast("timestamp")).alias("hi")))
    # files of one micro-batch come together, so any file may be the last one before
    ahead = F.max("hi").over(Window.orderBy("at", "file").rowsBetween(Window.unboundedPreceding, -1))
    row = files.select((F.unix_micros(ahead) - F.unix_micros("lo")).alias("back")).agg(F.max("back").alias("back")).first()
    return f"{max(row['back'] or 0, 0) // 1_000_000 + 3600} seconds"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", max_files: int | None = None) -> DataFrame:
    """File stream of one stored table, a single file or a folder of part files."""
    path = table_path(sf_dir, table)
    schema = spark.read.parquet(path).schema
    # written as a pattern, as a stream takes a single file's path for a base folder otherwise
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files or FILES_PER_BATCH).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(spark: SparkSession, sdf: DataFrame, name: str, mode: str = "update", rebuild=None) -> str:
    """Drain the stream (availableNow) into a folder; returns its path.

    ``rebuild`` makes the same query over the events and a second stream
    (given to it), for operators that hold rows back until the watermark
    passes: once the input is drained, one row at END_OF_INPUT goes into that
    second stream and the query goes on from its checkpoint, which closes
    everything that is open."""
    out = scratch_path(spark, name)
    ckpt = scratch_path(spark, name + "-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    def drain(df: DataFrame) -> None:
        (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink).trigger(availableNow=True).start().awaitTermination())

    if rebuild is not None:
        ends = scratch_path(spark, name + "-end")
        schema = rebuild.schema
        row = [F.lit(END_OF_INPUT).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        end = spark.range(1).select(*row)
        end.limit(0).write.parquet(ends)
        sdf = rebuild(spark.readStream.schema(schema).parquet(ends))
    # the table exists even if no batch has rows
    spark.createDataFrame([], sdf.schema).withColumn("_batch", F.lit(0)).write.mode("append").parquet(out)
    drain(sdf)
    if rebuild is not None:
        end.write.mode("append").parquet(ends)
        drain(rebuild(spark.readStream.schema(schema).parquet(ends)))
    return out


class Rebuild:
    """``build`` over the events of a table and the stream that ends them."""

    def __init__(self, events: DataFrame, build):
        self.events, self.build, self.schema = events, build, events.schema

    def __call__(self, ends: DataFrame) -> DataFrame:
        return self.build(self.events.unionByName(ends))


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last written version of every key across micro-batches."""
    d = spark.read.parquet(path)
    cols = [c for c in d.columns if c not in (*keys, "_batch")]
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*cols, F.lit(0).alias("_one")), "_batch").alias("_v"))
    return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def _ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (_ts(events).withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


def session_counts(events: DataFrame, gap: str, watermark: str = "2 hours") -> DataFrame:
    return (_ts(events).withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


def flatten_window(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     *[c for c in df.columns if c != "w"])


ROLL_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("roll_mean", T.DoubleType()),
    T.StructField("ema", T.DoubleType()),
])
ROW_KEY = T.StructType([T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("nth", T.IntegerType())])
ROW_VALUE = T.StructType([T.StructField("value", T.DoubleType())])
TAIL = T.StructType([T.StructField("value", T.DoubleType())])
PATH = T.StructType([T.StructField("ema", T.DoubleType()), T.StructField("taken", T.LongType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rolling(StatefulProcessor):
    """Rows of one series wait, each an entry of its own in the state, until
    an event-time timer says that the watermark has passed them; then they are
    taken in event order.  A batch writes the entries that come and removes
    those that go, and leaves all others alone; beside them are kept the last
    ``window`` values and the EMA."""

    def __init__(self, window: int, alpha: float):
        self.window, self.alpha = window, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", ROW_KEY, ROW_VALUE)
        self.tail = handle.getListState("tail", TAIL)
        self.path = handle.getValueState("path", PATH)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for p in rows:
            ts = p["ts"].astype("datetime64[us]").astype(np.int64).tolist()
            for t, i, v in zip(ts, p["event_id"].fillna(-1).astype(np.int64).tolist(), p["value"].astype(float).tolist()):
                nth = 0
                while self.waiting.containsKey((t, i, nth)):  # a row that came before
                    nth += 1
                self.waiting.updateValue((t, i, nth), (v,))
                first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], None
        for k, v in self.waiting.iterator():
            if k[0] <= passed:
                ready.append((k[0], k[1], k[2], v[0]))
            else:
                later = k[0] if later is None else min(later, k[0])
        if later is not None:
            self.handle.registerTimer(later // 1000 + 1)
        if not ready:
            return
        for r in ready:
            self.waiting.removeKey(r[:3])
        x = np.array([np.nan if r[3] is None else r[3] for r in sorted(ready, key=lambda r: r[:3])])
        ids = [r[1] for r in sorted(ready, key=lambda r: r[:3])]
        last = [r[0] for r in self.tail.get()]
        old = self.path.get()
        known = pd.Series(np.append(np.array(last, float), x))
        before = known.rolling(self.window, min_periods=1).mean().shift().to_numpy()[len(last):]
        begin = np.nan if old is None or old[0] is None else old[0]
        ema = pd.Series(np.append([begin], x)).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
        self.tail.put([(float(v),) for v in known.to_numpy()[-self.window:]])
        self.path.update((None if np.isnan(ema[-1]) else float(ema[-1]), (old[1] if old else 0) + len(x)))
        yield pd.DataFrame({"event_id": ids, "user_id": key[0], "value": x, "roll_mean": before, "ema": ema[1:]})

    def close(self) -> None:
        pass


def rolling_state(events: DataFrame, window: int, span: float, watermark: str = "2 hours") -> DataFrame:
    """Per series (user) in event order: mean of the previous ``window``
    values and EMA (adjust=False).

    Rows wait in the state until the watermark has passed them, so they are
    taken in event order whatever order they come in; the state holds the last
    ``window`` values, the EMA and the rows of the watermark delay.  Rows later
    than the watermark are dropped.  Runs on the RocksDB state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    held = _ts(events).select("ts", "event_id", "user_id", F.col("value").cast("double").alias("value")).withWatermark("ts", watermark)
    return held.groupBy("user_id").transformWithStateInPandas(Rolling(window, 2.0 / (span + 1.0)), ROLL_OUT, "append", "EventTime")


def anomaly_scores(events: DataFrame, stats: DataFrame, threshold: DataFrame) -> DataFrame:
    """Stream-static join: per-user statistics (one row per user) and the
    energy threshold (one row, broadcast) score every arriving event."""
    j = events.join(stats, "user_id").crossJoin(F.broadcast(threshold))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return j.select("event_id", "user_id", z.alias("z"), (z * z > F.col("threshold")).alias("anomaly"))


def dedup_keys(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Duplicates of (user, event type, minute) within the watermark are
    dropped; rows later than the watermark are dropped too."""
    d = _ts(events).withColumn("minute", F.date_trunc("minute", "ts"))
    d = d.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"])
    return d.select("user_id", "event_type", F.col("minute").cast("timestamp_ntz").alias("minute"))


def run_routed(spark: SparkSession, events: DataFrame, keys: Sequence[str], delay: str, name: str, ckpt: str | None = None,
               out: str | None = None) -> str:
    """Drain ``events`` (event_id, ts, ``keys``), every row going one way:
    ``late`` if it is not after the watermark, the latest event time of the
    batches before it less ``delay``; ``duplicate`` if an earlier row of the
    same keys was kept; else ``kept``.  Returns the folder of the rows
    (``rows``) and of one line for each batch (``batches``: watermark and
    counts).

    A batch's rows are written under its number, overwriting what an attempt
    before it left, so a restart repeats no row.  Of the rows kept before,
    those within the delay of the watermark are looked at (``keys`` must hold
    a time no finer than the delay: an older one can't come on time again)."""
    out, ckpt = out or scratch_path(spark, name), ckpt or scratch_path(spark, name + "-ckpt")
    events = _ts(events)
    row_schema = T.StructType([*events.schema.fields, T.StructField("route", T.StringType())])
    lines = "batch long, watermark timestamp, latest timestamp, kept long, duplicate long, late long"

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        seen = session.read.schema(lines).parquet(f"{out}/batches").where(F.col("batch") < batch_id)
        top = seen.agg(F.max("latest").alias("latest")).select("latest", (F.col("latest") - F.expr(f"INTERVAL {delay}")).alias("watermark")).first()
        mark = F.lit(top["watermark"]).cast("timestamp")
        rows = batch.withColumn("late", F.coalesce(F.col("ts") <= mark, F.lit(False)))
        order = Window.partitionBy(*keys).orderBy("ts", "event_id")
        fresh = rows.where("not late").withColumn("again", F.row_number().over(order) > 1)
        before = session.read.schema(row_schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
        before = before.where((F.col("batch") < batch_id) & (F.col("route") == "kept") & F.coalesce(F.col("ts") > mark - F.expr(f"INTERVAL {delay}"), F.lit(True)))
        before = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct().withColumn("_known", F.lit(True))
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        route = F.when(F.col("again") | F.coalesce("_known", F.lit(False)), F.lit("duplicate")).otherwise(F.lit("kept"))
        fresh = fresh.join(before, cond, "left").withColumn("route", route).select(*events.columns, "route")
        done = fresh.unionByName(rows.where("late").withColumn("route", F.lit("late")).select(*events.columns, "route"))
        done.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        wrote = session.read.schema(row_schema).parquet(f"{out}/rows/batch={batch_id}")
        counts = [F.count(F.when(F.col("route") == w, 1)).alias(w) for w in ("kept", "duplicate", "late")]
        (wrote.agg(F.max("ts").alias("latest"), *counts)
         .select(F.lit(mark).alias("watermark"), F.greatest("latest", F.lit(top["latest"]).cast("timestamp")).alias("latest"), "kept", "duplicate", "late")
         .write.mode("overwrite").parquet(f"{out}/batches/batch={batch_id}"))

    spark.createDataFrame([], "watermark timestamp, latest timestamp, kept long, duplicate long, late long").write.mode("overwrite").parquet(f"{out}/batches/batch=-1")
    spark.createDataFrame([], row_schema).write.mode("overwrite").parquet(f"{out}/rows/batch=-1")
    events.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return out


def arrivals(spark: SparkSession, rows: DataFrame, arrival: str, steps: int, name: str) -> Iterator[str]:
    """A folder for :func:`event_stream` that rows come to in ``steps`` equal
    steps of the ``arrival`` time (microseconds): yields its path after each."""
    folder = scratch_path(spark, name)
    span = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi"))
    step = F.floor((F.col(arrival) - F.col("lo")) * steps / (F.col("hi") - F.col("lo") + 1)).cast("int")
    d = rows.crossJoin(F.broadcast(span)).withColumn("_step", step).drop("lo", "hi", arrival)
    for i in range(steps):
        d.where(F.col("_step") == i).drop("_step").write.mode("append").parquet(f"{folder}/events.parquet")
        yield folder
