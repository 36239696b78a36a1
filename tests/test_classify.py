"""Logistic regression summed over the cluster against numpy."""
import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tsq.operators import classify as C
from tsq.plans import evals


def _plain(xs, ys, l2):
    """Newton's method on the penalised likelihood of padded samples."""
    size = max(map(len, xs))
    x = np.full((len(xs), size), np.nan)
    for i, v in enumerate(xs):
        x[i, :len(v)] = v
    sd = np.nanstd(x, axis=0)
    f = np.column_stack([np.nan_to_num((x - np.nanmean(x, axis=0)) / np.where(sd > 1e-12, sd, 1.0)), np.ones(len(xs))])
    k = sorted(set(ys))
    y = np.array([[c == v for c in k] for v in ys], float)
    w = np.zeros((len(k), size + 1))
    pen = np.append(np.full(size, l2), 1e-12)
    for _ in range(60):
        z = f @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (y - p).T @ f - pen * w
        h = np.zeros((w.size, w.size))
        n = size + 1
        for a in range(len(k)):
            for b in range(len(k)):
                h[a * n:(a + 1) * n, b * n:(b + 1) * n] = f.T @ (f * (p[:, a] * ((a == b) - p[:, b]))[:, None])
        w = w + np.linalg.solve(h + np.diag(np.tile(pen, len(k))) + 1e-9 * np.eye(w.size), g.ravel()).reshape(w.shape)
    return w, k, f


def test_fit_on_ragged_samples_equals_numpy(spark):
    rng = np.random.default_rng(3)
    ys = rng.integers(0, 3, 240).tolist()
    xs = [(rng.normal(size=n) + 0.8 * c * np.cos(np.arange(n))).tolist() for c, n in zip(ys, rng.integers(3, 9, 240))]
    d = spark.createDataFrame([(i, 10 * c, x) for i, (c, x) in enumerate(zip(ys, xs))] + [(900, None, [1.0]), (901, 20, None)], "id int, label int, x array<double>")
    model = C.fit_logistic(d.where("id < 901"), l2=1.0, steps=150, tol=1e-8)
    w, k, f = _plain(xs, [10 * c for c in ys], 1.0)
    assert model.classes == k
    # all classes' constants may shift together
    assert np.allclose(model.weight[:, :-1], w[:, :-1], atol=2e-3) and np.allclose(np.diff(model.weight[:, -1]), np.diff(w[:, -1]), atol=2e-3)
    got = {r.id: (r.pred_class, r.prob) for r in C.predict(d, model).collect()}
    z = f @ model.weight.T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert all(got[i] == (k[int(p[i].argmax())], pytest.approx(p[i].max())) for i in range(240)) and got[901][0] in k
    assert C.fit_logistic(d.limit(0)) is None


def test_query_accuracy_equals_numpy(spark):
    r = evals.q_classification_logistic(spark, SF_SMALL).first()
    s = (spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").selectExpr("vec_id AS sample_id", "label", "embedding AS x")
         .withColumn("train", evals.rng.uniform("sample_id", evals.F.lit("split"), evals.F.lit(evals.SPLIT_SEED)) < 0.7).collect())
    train, test = [v for v in s if v.train], [v for v in s if not v.train]
    w, k, _ = _plain([v.x for v in train], [v.label for v in train], 1.0)
    x = np.array([v.x for v in train], float)
    f = np.column_stack([(np.array([v.x for v in test], float) - x.mean(0)) / x.std(0), np.ones(len(test))])
    want = np.mean([k[i] == v.label for i, v in zip((f @ w.T).argmax(1), test)])
    assert r.n_test == len(test) and abs(r.accuracy - want) <= 2 / len(test) + 1e-6
