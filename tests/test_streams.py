"""Streaming queries over several unordered files, long keys and late rows."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.test_oracle import _close, _key, _norm
from tsq.session import scratch_path
from tsq.streaming import features as st

SF = "/root/testdata/sf0.001"
KEYS = [k for k in E.queries() if k.startswith("st_")]


@pytest.fixture(scope="module")
def split(spark):
    """The events table dealt at random over five files, the other tables as they are."""
    folder = scratch_path(spark, "split")
    e = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(5):
        e.where(f"pmod(xxhash64(event_id), 5) = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", KEYS)
def test_many_files_in_any_order(spark, split, name, monkeypatch):
    import duckdb
    monkeypatch.setattr(st, "FILES_PER_BATCH", 1)
    df = E.queries()[name](spark, split)
    order = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=_key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(_norm(r[names.index(c)]) for c in order) for r in res.fetchall()), key=_key)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want) if not _close(a, b)]
    assert not bad, bad[:3]


def _events(spark, rows, files, folder):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for part in np.array_split(np.arange(len(rows)), files):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_rolling_state_beyond_one_arrow_batch(spark, monkeypatch):
    monkeypatch.setattr(st, "FILES_PER_BATCH", 1)
    folder, start = scratch_path(spark, "long"), dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(1)
    n = 25_000
    value = rng.normal(size=n)
    rows = [(i, start + dt.timedelta(seconds=7 * i), 1, "a", float(value[i])) for i in range(n)]
    _events(spark, [rows[i] for i in rng.permutation(n)], 2, folder)
    got = E.queries()["st_rolling_state"](spark, folder).toPandas().sort_values("event_id")
    assert len(got) == n
    want = pd.Series(value).rolling(5, min_periods=1).mean().shift().to_numpy()
    np.testing.assert_allclose(got["roll_mean"].to_numpy(float), want, atol=2e-6)


def test_rows_later_than_the_watermark_are_dropped(spark):
    folder, start = scratch_path(spark, "late"), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), 1, "a", 1.0) for i in range(20)]
    late = [(100, start + dt.timedelta(hours=1, minutes=5), 1, "a", 50.0)]
    for part in (rows, [(20, start + dt.timedelta(hours=20), 1, "a", 1.0)], late):  # a batch's late rows go by the watermark before the last
        _events(spark, part, 1, folder)
    s = st.windowed_counts(st.event_stream(spark, folder, max_files=1), "1 hour", watermark="2 hours")
    path = st.run_to_table(spark, st.flatten_window(s), "late")
    got = st.latest(spark, path, ["window_start", "window_end", "event_type"]).agg({"value_sum": "sum"}).first()[0]
    assert got == 21.0
    assert st.disorder(spark, st.table_path(folder, "events")) == f"{19 * 3600 - 300 + 3600} seconds"


def test_empty_table(spark):
    folder = scratch_path(spark, "none")
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{folder}/events.parquet")
    for name in ("st_tumbling", "st_session", "st_rolling_state", "st_dedup_late", "st_late_rows"):
        assert E.queries()[name](spark, folder).count() == 0


def test_rolling_state_goes_on_from_its_checkpoint(spark):
    folder, out, ckpt = (scratch_path(spark, n) for n in ("again", "again-out", "again-ckpt"))
    start, rng = dt.datetime(2024, 1, 1), np.random.default_rng(4)
    n = 600
    value = rng.normal(size=n)
    rows = [(i, start + dt.timedelta(minutes=3 * i), i % 3, "a", float(value[i])) for i in range(n)]
    mixed = [rows[i] for i in rng.permutation(n)]

    def drain():
        s = st.rolling_state(st.event_stream(spark, folder, max_files=1), 4, 6, "40 hours")
        (s.writeStream.outputMode("append").option("checkpointLocation", ckpt).format("parquet").option("path", out)
         .trigger(availableNow=True).start().awaitTermination())

    _events(spark, mixed[:300] + rows[:1], 3, folder)  # one row comes twice
    drain()
    part = spark.read.parquet(out).count()
    _events(spark, mixed[300:], 2, folder)
    drain()
    _events(spark, [(10_000, dt.datetime(2250, 1, 1), 9, "a", 0.0)], 1, folder)
    drain()
    got = spark.read.parquet(out).toPandas().sort_values("event_id", kind="stable")
    assert part < 301 and len(got) == n + 1
    for user in range(3):
        x = pd.Series(([value[0]] if user == 0 else []) + [value[i] for i in range(n) if i % 3 == user])
        mine = got[got["user_id"] == user]
        np.testing.assert_allclose(mine["roll_mean"].to_numpy(float), x.rolling(4, min_periods=1).mean().shift().to_numpy(), atol=1e-9)
        np.testing.assert_allclose(mine["ema"].to_numpy(float), x.ewm(alpha=2 / 7, adjust=False).mean().to_numpy(), atol=1e-9)


def test_routes_follow_the_file_order_also_after_a_restart(spark):
    folder, out, ckpt = (scratch_path(spark, n) for n in ("routes", "routes-out", "routes-ckpt"))
    start = dt.datetime(2024, 1, 1)
    at = lambda i, h, u=1: (i, start + dt.timedelta(hours=h), u, "a", 1.0)
    files = [[at(0, 1), at(1, 1), at(2, 2)], [at(3, 1.5), at(4, 9), at(5, 2, 2)], [at(6, 8), at(7, 8.5), at(8, 9)], [at(9, 30)], [at(10, 8.5), at(11, 29.5), at(12, 29.5)]]
    want, latest, seen = {}, None, set()
    for rows in files:
        mark = None if latest is None else latest - dt.timedelta(hours=1)
        for i, ts, u, _, _ in rows:
            key = (u, ts)
            want[i] = "late" if mark is not None and ts <= mark else "duplicate" if key in seen else "kept"
            if want[i] == "kept":
                seen.add(key)
        latest = max([r[1] for r in rows] + ([latest] if latest else []))
    for some in (files[:3], files[3:]):
        for rows in some:
            _events(spark, rows, 1, folder)
        s = st.event_stream(spark, folder, max_files=1).withColumn("minute", F.col("ts"))
        st.run_routed(spark, s, ["user_id", "minute"], "1 hour", "routes", ckpt, out)
    got = {r.event_id: r.route for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == want and {"late", "kept", "duplicate"} == set(want.values())
    lines = spark.read.parquet(f"{out}/batches").where("batch >= 0").agg(F.sum("late"), F.sum("kept"), F.sum("duplicate")).first()
    assert tuple(lines) == tuple(list(want.values()).count(k) for k in ("late", "kept", "duplicate"))
