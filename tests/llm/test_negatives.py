"""Hard negatives: the intervals hold, and the result equals a plain double loop."""
import math

import numpy as np
import pyarrow as pa

from tsq.llm import negatives as N
from tsq.llm import vectors as V


def _plain(rows):
    """The contract, over (vec_id, embedding, label)."""
    r = []
    for i, v, l in rows:
        if i is None or l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if sum(x * x for x in v) <= N.LARGEST:
            r.append((i, (l + 1) % 10 if i % 7 == 0 else l, v))
    out = []
    for key in sorted({(i, l, tuple(v)) for i, l, v in r if i % 100 == 0}):
        a, label, v = key
        s = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in r if i != a)
        for score, p, _ in [x for x in s if x[2] == label][:5]:
            fit = [x for x in s if x[2] != label and -30 * score <= -100 * x[0] <= -90 * score][:10]
            out += [(a, p, n + 1, i, -score, -x) for n, (x, i, _) in enumerate(fit)]
    return sorted(out)


def _run(spark, rows):
    d = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, chunk int, codes string")
    return sorted(tuple(r) for r in N.hard_negatives(d).collect())


def test_intervals_hold():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 100):
        x = np.floor(256 * np.concatenate([rng.normal(size=(200, dim)), np.zeros((1, dim)), 40 * np.eye(dim)[:2]]))
        mean = x.mean(axis=0)
        codes, facts = N.encode(x, mean)
        a = N.Anchors(x.astype(np.int64), mean)
        words = codes.shape[1] // N.LEVELS
        for i in range(0, 203, 29):
            true, centre, blur = x @ x[i], np.full(203, a.base[i]), np.zeros(203)
            widths = []
            for level in range(N.LEVELS):
                s, lost = a.along(i, level, codes[:, level * words:(level + 1) * words])
                centre, blur = centre + facts[:, 2 * level] * s, blur + facts[:, 2 * level] * lost
                margin = facts[:, 2 * level + 1] * np.sqrt(np.maximum(a.norm2[i] - np.maximum(abs(s) - lost, 0) ** 2, 0)) + blur + a.slack[i] * (1 + facts[:, 2 * level + 1])
                assert (abs(true - centre) <= margin).all()
                widths.append(margin.mean())
            assert a.norm2[i] == 0 or all(p > q for p, q in zip(widths, widths[1:]))


def test_rotation_keeps_lengths_and_products():
    x = np.random.default_rng(1).normal(size=(9, 40))
    y = V.rotate(x, V.signs(64, 3))
    assert np.allclose(x @ x.T, y @ y.T)
    assert (V.unpacked(V.packed(y), np.float64, 64) == y).all()


def test_matrix():
    x, ok = V.matrix(pa.array([[1.0, 2.0], None, [], [1.0, None], [float("nan")], [3.0]], pa.list_(pa.float32())), 3)
    assert ok.tolist() == [True, False, True, False, False, True] and x[0].tolist() == [1, 2, 0] and x[5].tolist() == [3, 0, 0]


def test_clusters_ties_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 24))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.3 * rng.normal(size=24)], int(i % 10 if i % 3 else 2)) for i in range(700)]
    rows += [(800 + i, rows[3][1], 4) for i in range(40)] + [(900, rows[3][1], 4), (900, rows[3][1], 4), (900, rows[4][1], 4)]  # copies, repeated anchor
    rows += [(1000, None, 1), (1001, rows[1][1], None), (None, rows[1][1], 1), (1002, [1.0, None], 1), (1100, [float("nan")] * 24, 1),
             (1003, [], 1), (1200, [0.0] * 24, 1), (1300, [0.5], 3), (1004, [3e38] * 24, 1), (1005, [900.0] * 24, 1), (1006, [1.0] * 30, 2)]
    assert _run(spark, rows) == _plain(rows)


def test_small_tables(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(0, [1.0, 2.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 2), (2, [0.5], 1)]
    assert _run(spark, rows) == _plain(rows)
