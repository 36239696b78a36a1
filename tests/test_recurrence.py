"""Smoothing and padded changes with nulls against pandas, over many blocks."""
import numpy as np
import pandas as pd
import pytest

from tsq.operators import features as fe
from tsq.operators import windows as wo
from tsq.operators.recurrence import Smooth, smoothed


def _series(n=900):
    rng = np.random.default_rng(3)
    out = {}
    x = 50 + rng.normal(size=n).cumsum()
    out["full"] = x.copy()
    x[:37] = np.nan
    out["leading"] = x.copy()
    x[100:520] = np.nan  # longer than a block
    x[rng.integers(0, n, 90)] = np.nan
    out["gaps"] = x.copy()
    out["empty"] = np.full(n, np.nan)
    out["one"] = np.where(np.arange(n) == 400, 7.0, np.nan)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, x in _series().items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t long, x double").cache()


@pytest.mark.parametrize("alpha", [2 / 27, 0.5, 0.9999, 1.0, 1e-4])
def test_smoothed_equals_pandas_ewm(frame, alpha):
    got = smoothed(frame, "k", "t", [Smooth("x", alpha, "y")], block=128).toPandas().sort_values(["k", "t"])
    for k, g in got.groupby("k"):
        want = pd.Series(_series()[k]).ewm(alpha=alpha, adjust=False, ignore_na=False).mean()
        np.testing.assert_allclose(g["y"].to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_smoothing_from_a_given_start(spark, frame):
    got = wo.smoothing(frame.where("k = 'full'").drop("k"), None, "t", "x", 0.8, init=3.0).orderBy("t").toPandas()["level"].to_numpy()
    level, want = 3.0, []
    for v in _series()["full"]:
        level = 0.8 * level + (1 - 0.8) * v
        want.append(level)
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_stock_features_with_nulls(spark):
    """Leading nulls, a gap longer than a block, and a ticker without prices."""
    rows, days = [], pd.date_range("2000-01-01", periods=900)
    for k, x in _series().items():
        rows += [(k, d.date(), 1.0, 1.0, 1.0, None if np.isnan(v) else float(v), 1) for d, v in zip(days, x)]
    panel = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")
    got = fe.stock_features(panel, block=128).toPandas().sort_values(["ticker", "date"])
    assert set(got["ticker"]) == {"full", "leading", "gaps", "one"}
    ewm = lambda s, n: s.ewm(span=n, adjust=False).mean()
    for k, g in got.groupby("ticker"):
        x = pd.Series(_series()[k])
        pad = x.ffill()
        macd = ewm(x, 12) - ewm(x, 26)
        for col, want in (("pct_change", pad / pad.shift() - 1), ("macd", macd), ("macd_signal", ewm(macd, 9)), ("macd_hist", macd - ewm(macd, 9))):
            np.testing.assert_allclose(g[col].to_numpy(float), want.to_numpy(), rtol=1e-8, atol=1e-8, err_msg=f"{k} {col}")


def test_point_adjust_with_rare_segments(spark):
    rng = np.random.default_rng(9)
    gt = (rng.random(3000) < 0.02).astype(int)
    gt[1000:1040] = 1
    pred = (rng.random(3000) < 0.3).astype(int)
    d = spark.createDataFrame([("s", i, int(a), int(b)) for i, (a, b) in enumerate(zip(gt, pred))], "k string, t long, gt int, pred int")
    got = wo.point_adjust(d, "k", "t").orderBy("t").toPandas()["pred_adj"].to_numpy()
    want, i = pred.copy(), 0
    while i < 3000:
        j = i
        while j < 3000 and gt[j] == 1:
            j += 1
        if j > i and pred[i:j].any():
            want[i:j] = 1
        i = max(j, i + 1)
    assert (got == want).all()


def test_convergence_in_one_pass_equals_pandas(spark):
    from tsq.operators.recurrence import convergence
    rng = np.random.default_rng(12)
    groups = {"full": rng.normal(size=600).cumsum(), "gaps": rng.normal(size=500).cumsum(), "late": rng.normal(size=90), "none": np.full(130, np.nan), "one": np.array([3.0])}
    groups["gaps"][rng.random(500) < 0.4] = np.nan
    groups["gaps"][60:200] = np.nan  # whole blocks without a value
    groups["late"][:40] = np.nan
    rows = [(k, i, None if np.isnan(v) else float(v), "z") for k, x in groups.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "k string, t long, x double, n string").repartition(6)
    got = convergence(d, "k", "t", "x", 2 / 13, 2 / 27, 2 / 10, block=32).toPandas()
    assert list(got.columns) == ["k", "t", "x", "n", "_filled", "macd", "macd_signal"] and len(got) == len(rows)
    for k, x in groups.items():
        mine, s = got[got["k"] == k].sort_values("t"), pd.Series(x)
        fast, slow = (s.ewm(alpha=a, adjust=False, ignore_na=False).mean() for a in (2 / 13, 2 / 27))
        macd = fast - slow
        np.testing.assert_allclose(mine["_filled"], s.ffill(), equal_nan=True)
        np.testing.assert_allclose(mine["macd"], macd, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(mine["macd_signal"], macd.ewm(alpha=2 / 10, adjust=False).mean(), atol=1e-9, equal_nan=True)
