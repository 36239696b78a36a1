"""Batch spectra and correlations against their definitions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tsq.operators import spectrum as S


def _direct(x):
    n = len(x)
    k = np.arange(n // 2 + 1)
    f = np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n) @ x
    f.imag[0] = 0.0
    if n % 2 == 0:
        f.imag[-1] = 0.0
    return f


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 4096, 4097])
def test_kernels_equal_definitions(n):
    x, y = np.random.default_rng(n).normal(size=(2, 3, n))
    f = S.rfft(x)
    assert np.allclose(f, [_direct(v) for v in x], atol=1e-7)
    assert (f.imag[:, 0] == 0).all() and (n % 2 or (f.imag[:, -1] == 0).all())
    lag = (np.arange(n)[:, None] + np.arange(n)) % n  # row tau: x[(t + tau) mod L]
    assert np.allclose(S.circular(x, y), np.stack([v[lag] @ w for v, w in zip(x, y)]), atol=1e-7)
    own = S.circular(x, x)
    assert np.allclose(own, np.stack([v[lag] @ v for v in x]), atol=1e-7) and (own[:, 1:] == own[:, :0:-1]).all()


def test_long_windows_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(1, rng.normal(size=4096).tolist()), (2, rng.normal(size=777).tolist()), (3, []), (4, None), (5, [3.0]), (6, [1.0, None, 2.0]), (2, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, x array<double>")
    got = {}
    for r in S.frequencies(d, "id", "x").collect():
        got.setdefault((r.id, r.L), {})[r.k] = r
    want = {(i, len(x)): _direct(np.array([0.0 if v is None else v for v in x])) for i, x in rows if x}
    assert got.keys() == want.keys()
    for key, f in want.items():
        r = [got[key][k] for k in range(len(f))]
        assert np.allclose([v.re + 1j * v.im for v in r], f, atol=1e-8) and np.allclose([v.amp for v in r], abs(f), atol=1e-8)
        assert np.allclose([v.phase for v in r], np.where(abs(f) < S.NO_PHASE, 0, np.arctan2(f.imag + 0.0, f.real)), atol=1e-6)
    corr = {(r.id, r.tau): r.corr for r in S.correlations(d.where("id = 1"), "id", "x").collect()}
    x = np.array(rows[0][1])
    assert len(corr) == 4096 and all(abs(corr[1, k] - np.roll(x, -k) @ x) < 1e-8 for k in (0, 1, 2048, 4095))
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [0.0, 1.0, 0.0]), (2, [1.0], [1.0, 2.0]), (3, None, [1.0])], "id int, x array<double>, y array<double>")
    assert [r.c for r in two.orderBy("id").select(S.correlation("x", "y").alias("c")).collect()] == [pytest.approx([2.0, 3.0, 1.0]), None, None]


def test_delays_and_roll(spark):
    x = [float(v) for v in np.sin(np.arange(120) * 2 * np.pi / 12) + 0.1 * np.random.default_rng(3).normal(size=120)]
    d = spark.createDataFrame([(1, x), (2, [1.0, 2.0])], "id int, x array<double>").withColumn("lags", S.delays(S.correlation("x"), 1.0))
    lags = {r.id: r.lags for r in d.collect()}
    corr = np.array([np.roll(x, -k) @ np.array(x) for k in range(120)])
    assert lags[2] == [] and [p.tau for p in lags[1]] == sorted(range(120), key=lambda k: (-round(corr[k], 9), k))[:4]
    w = np.exp([p.corr - lags[1][0].corr for p in lags[1]])
    want = sum(a * np.roll(x, -p.tau) for a, p in zip(w / w.sum(), lags[1]))
    got = d.where("id = 1").select(S.delay_aggregate("x", "lags").alias("y")).first().y
    assert np.allclose(got, want)


def test_long_form_is_gathered_in_order(spark):
    rows = [("a", t, float(t * t)) for t in range(50)] + [("b", 1, 2.0)]
    d = spark.createDataFrame(rows[::-1], "s string, t int, v double").repartition(5)
    got = {r.s: r.x for r in S.to_windows(d, "s", "t", "v").collect()}
    assert got == {"a": [float(t * t) for t in range(50)], "b": [2.0]}
    assert S.frequencies(S.to_windows(d, "s", "t", "v"), "s", "x").where(F.col("s") == "a").count() == 26
