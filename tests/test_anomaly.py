"""Window-keyed anomaly scores against numpy."""
import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tsq.operators import anomaly as A
from tsq.plans import evals, spectral


def _frame(spark, groups):
    rows = [(k, t, float(v), int(t % 7 == 0)) for k, x in groups.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "s string, t long, x double, y int")


def test_windows_times_steps_and_moving_average(spark):
    rng = np.random.default_rng(1)
    groups = {"long": rng.normal(size=9000), "short": rng.normal(size=8), "none": rng.normal(size=7)}
    w = A.windows(_frame(spark, groups), "s", "t", {"x": "x", "y": "y"}, 8).withColumn("e", A.smooth_energy("x", 8, 5))
    got = {(r.s, r.window_id, r.step): (r.energy, r.label) for r in A.scores(w, "s", "e", "y").collect()}
    assert len(got) == 8 * (9000 - 7 + 1)
    for s in (0, 1, 4090, 4096, 8992):
        x = groups["long"][s:s + 8]
        mean = np.array([np.pad(x, 2, mode="edge")[i:i + 5].mean() for i in range(8)])
        assert [got["long", s, i] for i in range(8)] == [(pytest.approx(float(v)), int((s + i) % 7 == 0)) for i, v in enumerate((x - mean) ** 2)]


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {f"s{i}": np.sin(np.arange(n) * 0.7 + i) + 0.3 * rng.normal(size=n) + 2 for i, n in enumerate((5000, 60, 8))}
    w = A.windows(_frame(spark, groups), "s", "t", {"x": "x", "y": "y"}, 8)
    mean, axes = A.fit_components(w, "x", 3)
    v = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, 8) for x in groups.values()])
    assert np.allclose(mean, v.mean(axis=0))
    _, _, vt = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    assert np.allclose(axes.T @ axes, vt[:3].T @ vt[:3], atol=1e-8)
    rest = v - v.mean(axis=0) - (v - v.mean(axis=0)) @ vt[:3].T @ vt[:3]
    got = sorted(x for r in w.select(A.component_energy((mean, axes), "x").alias("e")).collect() for x in r.e)
    assert np.allclose(got, np.sort((rest ** 2).ravel()), atol=1e-8)
    assert A.fit_components(w.limit(0), "x", 3) is None


def test_pca_query(spark):
    r = evals.q_anomaly_eval_pca(spark, SF_SMALL).first()
    s = evals.anomaly_scores(spark, SF_SMALL, components=True).collect()
    x = {}
    for v in evals.anomaly_windows(spark, SF_SMALL).collect():
        x[v.series_id, v.split, v.window_id] = v
    train = np.array([v.x for k, v in x.items() if k[1] == "train"])
    m = train.mean(axis=0)
    _, _, vt = np.linalg.svd(train - m, full_matrices=False)
    energy = {k: ((np.array(v.x) - m) - (np.array(v.x) - m) @ vt[:3].T @ vt[:3]) ** 2 for k, v in x.items()}
    assert len(s) == 8 * len(x) and all(abs(energy[v.series_id, v.split, v.window_id][v.step] - v.energy) < 1e-9 for v in s)
    bar = np.percentile(np.concatenate(list(energy.values())), 80)
    hits = tp = fn = fp = n = 0
    for series in {k[0] for k in x}:
        keys = sorted(k for k in x if k[0] == series and k[1] == "test")
        gt = np.concatenate([x[k].label for k in keys]) if keys else np.zeros(0, int)
        pred = np.concatenate([energy[k] > bar for k in keys]).astype(int) if keys else gt
        i = 0
        while i < len(gt):  # any hit inside a true segment counts for all of it
            j = i
            while j < len(gt) and gt[j] == 1:
                j += 1
            if j > i and pred[i:j].any():
                pred[i:j] = 1
            i = max(j, i + 1)
        hits, n = hits + (gt == pred).sum(), n + len(gt)
        tp, fp, fn = tp + ((gt == 1) & (pred == 1)).sum(), fp + ((gt == 0) & (pred == 1)).sum(), fn + ((gt == 1) & (pred == 0)).sum()
    assert r.n == n and (r.accuracy, r.precision, r.recall) == pytest.approx((hits / n, tp / (tp + fp), tp / (tp + fn)), abs=1e-6)


def test_period_weights(spark):
    rows = spectral.q_detect_period(spark, SF_SMALL).collect()
    total = {}
    for r in rows:
        total.setdefault(r.sample_id, []).append(r.weight)
    assert len(total) == 500 and all(len(w) == 3 and sum(w) == pytest.approx(1, abs=1e-5) for w in total.values())
