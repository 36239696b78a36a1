"""Property tests: inverses, reconstructions, invariants."""
import math

import numpy as np
from pyspark.sql import functions as F

from tsq.operators import augment as au
from tsq.operators import spectral as sp
from tsq.operators import windows as wo

SF = "/root/testdata/sf0.001"


def _long(spark, arrays):
    rows = [(sid, t, float(v)) for sid, a in enumerate(arrays) for t, v in enumerate(a)]
    return spark.createDataFrame(rows, "sample_id long, t long, value double")


def test_full_spectrum_reconstructs(spark):
    rng = np.random.default_rng(4)
    arrs = [rng.normal(size=n) for n in (16, 17, 32)]
    df = _long(spark, arrs)
    spec = sp.dft(df, "sample_id", "t", "value")
    rec = sp.idft(spec, df, "sample_id", "t", "x").join(df, ["sample_id", "t"])
    err = rec.select(F.max(F.abs(F.col("x") - F.col("value")))).collect()[0][0]
    assert err < 1e-9
    # rfft agrees with numpy
    got = {(r.sample_id, r.k): (r.re, r.im) for r in spec.collect()}
    for sid, a in enumerate(arrs):
        X = np.fft.rfft(a)
        for k, z in enumerate(X):
            assert abs(got[(sid, k)][0] - z.real) < 1e-9 and abs(got[(sid, k)][1] - z.imag) < 1e-9


def test_trend_plus_seasonal_is_x(spark):
    rng = np.random.default_rng(5)
    df = _long(spark, [rng.normal(size=200)]).withColumnRenamed("sample_id", "sid")
    d = wo.decompose(df, "sid", "t", "value", [7, 12], block=32)
    err = d.select(F.max(F.abs(F.col("trend") + F.col("seasonal") - F.col("value")))).collect()[0][0]
    assert err < 1e-12


def test_rev_norm_roundtrip(spark):
    rng = np.random.default_rng(6)
    df = _long(spark, [rng.normal(size=60)]).withColumnRenamed("sample_id", "sid")
    w = wo.sliding_windows(df, "sid", "t", 12, 6, 6)
    n = wo.rev_denorm(wo.rev_norm(w, "sid", "value"), "x_norm")
    err = n.select(F.max(F.abs(F.col("x_denorm") - F.col("value")))).collect()[0][0]
    assert err < 1e-12


def test_haar_split_inverts(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=32)
    h = sp.haar_split(_long(spark, [a]), "sample_id", "t", "value").orderBy("i").toPandas()
    r2 = math.sqrt(2)
    even = (h.smooth + h.detail) / r2
    odd = (h.smooth - h.detail) / r2
    np.testing.assert_allclose(even, a[0::2], atol=1e-12)
    np.testing.assert_allclose(odd, a[1::2], atol=1e-12)


def test_augmentations_keep_samples_and_length(spark):
    from tsq.sources import tables as tb
    s = tb.sequences(spark, SF).select(*au.COLS)
    for op in (au.jitter, au.scaling, au.rotation, au.permutation, au.window_slice, au.shift_transform):
        out = op(s, seed=9)
        c = out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("d"))
        bad = c.filter((F.col("n") != 64) | (F.col("d") != 64)).count()
        assert bad == 0 and c.count() == s.select("sample_id").distinct().count(), op.__name__
    # permutation is a reordering: same multiset of values per sample
    p = au.permutation(s, seed=9).groupBy("sample_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    o = s.groupBy("sample_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    assert p.join(o, ["sample_id", "v"]).count() == o.count()
