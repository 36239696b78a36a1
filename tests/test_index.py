"""Row index, halo blocks and fills equal the whole-series answer."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsq.operators import features as fe
from tsq.operators.recurrence import Smooth, smoothed
from tsq.operators.index import fill_backward, fill_forward, series_index


def _series(spark, n=500, k=3, seed=1, nulls=False):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(k):
        ts = pd.date_range("2020-01-01", periods=n + s * 37, freq="D")
        for i, t in enumerate(ts):
            v = float(rng.normal(100, 5))
            if nulls and rng.random() < 0.3:
                v = None
            rows.append((f"s{s}", t.to_pydatetime(), v))
    return spark.createDataFrame(rows, "sid string, ts timestamp, x double")


def test_series_index_matches_row_number(spark):
    df = _series(spark)
    a = series_index(df, "sid", "ts").select("sid", "ts", "t")
    b = df.select("sid", "ts", (F.row_number().over(Window.partitionBy("sid").orderBy("ts")) - 1).alias("t"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_halo_blocks_equal_whole_series(spark):
    df = series_index(_series(spark), "sid", "ts")
    build = lambda w: [fe.trailing_mean("x", 7, w).alias("m"), F.lag("x", 3).over(w).alias("l"),
                       F.lead("x", 2).over(w).alias("f")]
    small = fe.with_features(df, "sid", "t", build, back=7, ahead=2, block=16).select("sid", "t", "m", "l", "f")
    w = Window.partitionBy("sid").orderBy("t")
    full = df.select("sid", "t", fe.trailing_mean("x", 7, w).alias("m"), F.lag("x", 3).over(w).alias("l"),
                     F.lead("x", 2).over(w).alias("f"))
    a = small.toPandas().sort_values(["sid", "t"]).reset_index(drop=True)
    b = full.toPandas().sort_values(["sid", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)


def test_ema_matches_pandas(spark):
    df = series_index(_series(spark, n=900), "sid", "ts")
    out = smoothed(df, "sid", "t", [Smooth("x", fe.ema_alpha(26), "e")], block=300)
    got = out.toPandas().sort_values(["sid", "t"])
    for sid, g in got.groupby("sid"):
        exp = g["x"].ewm(span=26, adjust=False).mean()
        np.testing.assert_allclose(g["e"].to_numpy(), exp.to_numpy(), rtol=1e-10)


def test_fill_forward_backward_exact(spark):
    df = series_index(_series(spark, nulls=True), "sid", "ts")
    ff = fill_forward(df, "sid", "t", ["x"], block=8).toPandas().sort_values(["sid", "t"])
    bf = fill_backward(df, "sid", "t", ["x"], block=8).toPandas().sort_values(["sid", "t"])
    raw = df.toPandas().sort_values(["sid", "t"])
    exp_f = raw.groupby("sid")["x"].ffill()
    exp_b = raw.groupby("sid")["x"].bfill()
    np.testing.assert_allclose(ff["x"].to_numpy(), exp_f.to_numpy(), equal_nan=True)
    np.testing.assert_allclose(bf["x"].to_numpy(), exp_b.to_numpy(), equal_nan=True)


def test_partition_invariance(spark):
    import __spark_entry__ as E
    q = E.queries()["point_adjust"]
    res = []
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1] == res[2]


def test_series_index_with_ties_is_a_permutation(spark):
    rows = [("a", 5 if i % 3 else 1, i) for i in range(300)] + [("b", 7, i) for i in range(50)]
    df = spark.createDataFrame(rows, "sid string, o long, v long")
    out = series_index(df, "sid", "o", bucket=F.floor(F.col("o") / F.lit(2.0))).toPandas()
    for sid, g in out.groupby("sid"):
        assert sorted(g["t"]) == list(range(len(g)))
        # order key respected: t sorted by o
        assert list(g.sort_values("t")["o"]) == sorted(g["o"])


def test_ranged_index_matches_row_number(spark):
    from tsq.operators.index import series_index_ranged
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id", "ts")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = series_index_ranged(e, "user_id", ["ts", "event_id"]).select("event_id", "t")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    exp = e.select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("t"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    # one hot series still gets split over several range partitions
    one = e.withColumn("user_id", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    h = series_index_ranged(one, "user_id", ["ts", "event_id"])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    ts = [r.t for r in h.select("t").collect()]
    assert sorted(ts) == list(range(e.count()))
