"""Fitted linear forecasts and the lag search against plain least squares."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsq.operators import lagged as L


def _series(spark, groups):
    rows = [(k, t, None if v is None else float(v)) for k, x in groups.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "s string, t long, x double")


def _plain_adf(x):
    """Each model by least squares, by the definition (a shift of the values changes nothing)."""
    n, x = len(x), x - np.mean(x)
    most = max((n - 1) // 2 - 1, 0) - 1
    p = max(min(math.ceil(12 * (n / 100) ** 0.25), most), 0)
    d = np.diff(x)

    def model(k, skip):
        rows = range(skip, len(d))
        a = np.array([[1.0, x[i], *(d[i - j] for j in range(1, k + 1))] for i in rows])
        y = d[list(rows)]
        c, *_ = np.linalg.lstsq(a, y, rcond=None)
        return a, y, c, ((y - a @ c) ** 2).sum()

    best = min(range(p + 1), key=lambda k: (round((n - p - 1) * math.log(model(k, p)[3] / (n - p - 1)) + 2 * k, 9), k))
    a, y, c, error = model(best, best)
    return c[1] / math.sqrt(error / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1]), best


def test_adf_equals_plain_search(spark):
    rng = np.random.default_rng(2)
    groups = {f"walk{n}": 50 + np.cumsum(rng.normal(size=n)) for n in (10, 17, 60, 400, 9000)}
    ar = np.zeros(500)
    for i in range(5, 500):
        ar[i] = 0.4 * ar[i - 1] - 0.3 * ar[i - 4] + rng.normal()
    groups |= {"ar": ar + 1e6, "noise": rng.normal(size=300), "season": np.sin(np.arange(200) * 0.5) + rng.normal(size=200)}
    got = {r.s: r for r in L.adf_searched(_series(spark, groups), "s", "t", "x").collect()}
    for name, x in groups.items():
        stat, lag = _plain_adf(np.asarray(x))
        assert got[name].lag == lag, name
        assert got[name].adf == pytest.approx(stat, rel=1e-6), name
    assert len({r.lag for r in got.values()}) > 2


def test_adf_odd_series(spark):
    groups = {"constant": [4.0] * 80, "one": [1.0], "two": [1.0, 2.0], "four": [1.0, 3.0, 2.0, 5.0], "line": list(range(60))}
    got = {r.s: r for r in L.adf_searched(_series(spark, groups), "s", "t", "x").collect()}
    assert got.keys() == groups.keys()
    assert all(got[k].adf is None and got[k].lag is None for k in ("constant", "one", "two", "line"))
    assert L.adf_searched(_series(spark, groups).limit(0), "s", "t", "x").count() == 0


def test_fit_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=6000).cumsum() * 0.05, "b": rng.normal(size=300), "short": [1.0, 2.0]}
    d, seq, pred = _series(spark, groups), 8, 3
    def design(names):
        w = [np.lib.stride_tricks.sliding_window_view(np.asarray(groups[k]), seq + pred) for k in names]
        v = np.concatenate(w)
        return np.column_stack([v[:, :seq], np.ones(len(v))]), v[:, seq:]
    a, y = design(["a", "b"])
    want = np.linalg.lstsq(a, y, rcond=None)[0].T
    model = L.fit_linear(d, "s", "t", "x", seq, pred)
    got = {r.h: [*r.weights, r.bias] for r in model.collect()}
    assert np.allclose([got[h] for h in (1, 2, 3)], want, atol=1e-8)
    pred_rows = {(r.s, r.window_id, r.h): r.y_pred for r in L.predict_linear(d, "s", "t", "x", model, seq).collect()}
    x = np.asarray(groups["a"])
    assert len(pred_rows) == 3 * (6000 - 7 + 300 - 7)
    assert all(pred_rows["a", s, h] == pytest.approx(want[h - 1, :-1] @ x[s:s + seq] + want[h - 1, -1]) for s in (0, 4095, 4096, 5992) for h in (1, 3))
    own = {(r.s, r.h): [*r.weights, r.bias] for r in L.fit_linear(d, "s", "t", "x", seq, pred, by="s").collect()}
    a, y = design(["b"])
    assert np.allclose([own["b", h] for h in (1, 2, 3)], np.linalg.lstsq(a, y, rcond=None)[0].T, atol=1e-8) and ("short", 1) not in own
    each = L.predict_linear(d, "s", "t", "x", L.fit_linear(d, "s", "t", "x", seq, pred, by="s"), seq, by="s")
    assert each.where(F.col("s") == "b").count() == 3 * 293


def test_parts_are_the_fit_on_trend_and_season():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(400, 24)), rng.normal(size=400)
    m = L.trend_matrix(24, 25)
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    season, trend = L.parts(w, 25)
    both = np.linalg.lstsq(np.column_stack([x - x @ m.T, x @ m.T]), y, rcond=None)[0]
    assert np.allclose(np.concatenate([season[0], trend[0]]), both, atol=1e-6)
    assert np.allclose((x - x @ m.T) @ season[0] + x @ m.T @ trend[0], x @ w)


def test_singular_fit_has_least_norm(spark):
    d = _series(spark, {"c": [2.0] * 40})
    r = {v.h: v for v in L.fit_linear(d, "s", "t", "x", 4, 2).collect()}
    assert all(abs(2 * sum(v.weights) + v.bias - 2) < 1e-6 for v in r.values())
    assert L.fit_linear(d.limit(3), "s", "t", "x", 4, 2).count() == 0
