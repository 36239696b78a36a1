"""Cross-polytope neighbours: exact scores, recall against brute force, odd rows."""
import math
from collections import defaultdict

import numpy as np

from tsq.llm import crosspolytope as C


def _plain(rows, k=5):
    """All cosines, by the contract, over (vec_id, embedding)."""
    r = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in r), default=1)
    r = [(i, np.pad(v, (0, dim - len(v)))) for i, v in r]
    out = {}
    for i, q in r:
        if i % 50 == 0:
            cos = sorted((-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in r if j != i)
            out[i] = [(j, -c) for c, j in cos[:k]]
    return out


def _run(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, codes string, chunk int")
    got = defaultdict(list)
    for r in sorted(C.nearest_neighbours(d).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return dict(got)


def _recall(got, want):
    return np.mean([len({j for j, _ in got[q]} & {j for j, _ in w}) / len(w) for q, w in want.items()])


def test_axes_and_scaling():
    x = np.random.default_rng(2).normal(size=(50, 40))
    y = C.coordinates(C._unit(x), 3)
    assert y.shape == (50, 128) and (y.argmax(axis=1) == C.codes(C._unit(x))[:, 3]).all()
    assert np.allclose((y[:, :64] ** 2).sum(axis=1), 1, atol=1e-5)
    z = C.scaled(x * 2.0 ** 900)
    assert (C.scaled(x) == z).all() and np.abs(z).max() < 1


def test_whole_table_recall(spark):
    for sf in ("0.01", "0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
        got, want = _run(spark, rows), _plain(rows)
        assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
        exact = {(i, j): c for i, w in _plain(rows, len(rows)).items() for j, c in w}
        assert all(abs(exact[q, j] - c) < 1e-12 for q, f in got.items() for j, c in f)
        assert _recall(got, want) >= 0.93


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 20)).astype(np.float32).astype(float)
    rows = [(i, (base[i % 8] + 0.2 * rng.normal(size=20)).tolist()) for i in range(300)]
    rows += [(1000 + i, base[0].tolist()) for i in range(200)]  # exact copies: ties go by id
    rows += [(1500, None), (1501, [0.0] * 20), (1550, [float("inf")] * 20), (1502, [None] * 20), (None, base[0].tolist()), (1600, base[0].tolist()[:3]),
             (1650, []), (1700, base[1].tolist()), (1700, base[1].tolist()), (1701, (3 * base[1]).tolist()), (1800, [1e-30] * 20), (1801, [3e38] * 20)]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got, want = _run(spark, rows), _plain([r for k, r in enumerate(rows) if r not in rows[:k]])
    assert got.keys() == want.keys()
    copies = [q for q in want if 1000 <= q < 1200]
    assert all([j for j, _ in got[q]] == [j for j in range(1000, 1006) if j != q][:5] and got[q][0][1] == got[q][4][1] for q in copies)
    assert _recall(got, want) > 0.95


def test_fewer_rows_than_asked(spark):
    assert _run(spark, []) == {}
    assert _run(spark, [(0, [1.0, 0.0])]) == {}
    assert _run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]) == {0: [(1, 0.0), (2, -1.0)]}
