"""Hand-checked micro cases and cross checks against numpy/pandas."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tsq.operators import metrics as me
from tsq.operators import windows as wo
from tsq.operators.index import series_index


def test_point_adjust_segments(spark):
    gt = [0, 1, 1, 1, 0, 1, 1, 0, 1]
    pr = [0, 0, 1, 0, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([("a", i, g, p) for i, (g, p) in enumerate(zip(gt, pr))], "sid string, t long, gt int, pred int")
    out = wo.point_adjust(df, "sid", "t").orderBy("t").select("pred_adj").toPandas()["pred_adj"].tolist()
    assert out == [0, 1, 1, 1, 0, 0, 0, 1, 0]


def test_split_chrono_borders(spark):
    n, seq = 100, 10
    df = spark.createDataFrame([("a", i) for i in range(n)], "sid string, t long")
    s = wo.split_chrono(df, "sid", "t", seq).groupBy("split").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    got = {r.split: (r.lo, r.hi) for r in s.collect()}
    assert got == {"train": (0, 69), "val": (60, 79), "test": (70, 99)}


def test_sliding_window_count(spark):
    n, seq, lab, pred = 50, 8, 4, 3
    df = spark.createDataFrame([("a", i, float(i)) for i in range(n)], "sid string, t long, x double")
    w = wo.sliding_windows(df, "sid", "t", seq, lab, pred)
    assert w.select("window_id").distinct().count() == n - seq - pred + 1
    assert w.filter("window_id = 5").count() == seq + pred


def test_moving_average_edge_replication(spark):
    x = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    k = 5
    padded = np.concatenate([[x[0]] * 2, x, [x[-1]] * 2])
    exp = np.convolve(padded, np.ones(k) / k, mode="valid")
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "sid string, t long, x double")
    got = wo.moving_average(df, "sid", "t", "x", k, block=4).orderBy("t").toPandas()["trend"].to_numpy()
    np.testing.assert_allclose(got, exp)


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.exponential(2.0, 1001)
    df = spark.createDataFrame([(float(a),) for a in v], "e double")
    for q in (0.0, 0.5, 0.99, 1.0):
        got = me.exact_percentile(df, "e", q, buckets=16).collect()[0][0]
        assert abs(got - np.percentile(v, 100 * q)) < 1e-12


def test_smoothing_matches_recursion(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=700)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "sid string, t long, x double")
    got = wo.smoothing(df, "sid", "t", "x", 0.8).orderBy("t").toPandas()["level"].to_numpy()
    s, exp = x[0], []
    for v in x:
        s = 0.8 * s + 0.2 * v
        exp.append(s)
    np.testing.assert_allclose(got, exp, rtol=1e-10)


def test_divide_no_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(me.divide_no_nan("a", "b")).collect()]
    assert got == [0.0, 0.0, float("-inf"), 1.5]


def test_exact_percentile_heavy_ties(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([np.zeros(700), rng.normal(size=300), np.full(50, 3.0)])
    df = spark.createDataFrame([(float(a),) for a in v], "e double")
    for q in (0.1, 0.5, 0.69, 0.7, 0.95, 1.0):
        got = me.exact_percentile(df, "e", q, buckets=8).collect()[0][0]
        assert abs(got - np.percentile(v, 100 * q)) < 1e-12, q
