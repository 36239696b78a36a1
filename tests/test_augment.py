"""Augmentation kernels: spline exactness, warps keep length, seeds stable."""
import numpy as np

from tsq.operators import augment as au


def test_not_a_knot_reproduces_cubics_and_knots():
    xk = np.linspace(0, 63, 6)
    f = lambda x: 0.5 * x ** 3 - 2 * x ** 2 + x - 7
    x = np.arange(64, dtype=float)
    np.testing.assert_allclose(au.not_a_knot_spline(xk, f(xk), x), f(x), rtol=1e-9, atol=1e-6)
    yk = np.array([1.0, 0.8, 1.3, 0.9, 1.1, 1.2])
    np.testing.assert_allclose(au.not_a_knot_spline(xk, yk, xk), yk, atol=1e-12)


def test_warps_keep_length_and_identity():
    rng = np.random.default_rng(2)
    x = rng.normal(size=64)
    ones = np.ones(6)
    np.testing.assert_allclose(au.magnitude_warp(x, ones), x, atol=1e-12)
    np.testing.assert_allclose(au.time_warp(x, ones), x, atol=1e-9)
    assert len(au.window_warp(x, 5, 2.0)) == 64 and len(au.window_warp(x, 5, 0.5)) == 64
    assert len(au.spawner(x, rng.normal(size=64), 20)) == 64
    w, q = au.guided_warp(x, x)
    np.testing.assert_allclose(w, x, atol=1e-12)
    b = au.wdba([x, x + 0.1, x - 0.1])
    assert b.shape == (64,)


def test_relational_aug_partition_invariant(spark):
    import __spark_entry__ as E
    q = E.queries()["aug_permutation"]
    res = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
