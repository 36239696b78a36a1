"""Haar transform of any length: coefficients by the pyramid, and the way back."""
import math

import numpy as np
import pytest

from tsq.operators import spectral as S


def _pyramid(x):
    """Level by level: (level, i) to (smooth, detail)."""
    p = 1 << max(len(x) - 1, 0).bit_length()
    cur = np.array([x[i % len(x)] for i in range(p)])
    out, level = {}, 0
    while len(cur) > 1:
        level += 1
        s, d = (cur[::2] + cur[1::2]) / math.sqrt(2), (cur[::2] - cur[1::2]) / math.sqrt(2)
        out |= {(level, i): (a, b) for i, (a, b) in enumerate(zip(s, d))}
        cur = s
    return out or {(0, 0): (x[0], None)}


def test_analysis_and_way_back(spark, monkeypatch):
    rng = np.random.default_rng(6)
    groups = {n: rng.normal(size=n) for n in (1, 2, 3, 5, 8, 17, 64, 1000, 9001)}
    d = spark.createDataFrame([(n, t, float(v), "x") for n, x in groups.items() for t, v in enumerate(x)], "k int, t long, v double, i string")
    c = S.haar_analysis(d, "k", "t", "v")
    got = {}
    for r in c.collect():
        got.setdefault(r.k, {})[r.level, r.i] = (r.smooth, r.detail)
        assert r.n == r.k
    for n, x in groups.items():
        want = _pyramid(x)
        assert got[n].keys() == want.keys()
        assert all(got[n][k] == (pytest.approx(a, abs=1e-9), None if b is None else pytest.approx(b, abs=1e-9)) for k, (a, b) in want.items())
    for fine in (12, 3):  # with 3, most levels go through the blocks
        monkeypatch.setattr(S, "FINE", fine)
        back = {}
        for r in S.haar_synthesis(c, "k").collect():
            back.setdefault(r.k, {})[r.t] = r.value
        assert {n: len(v) for n, v in back.items()} == {n: n for n in groups}
        assert all(np.allclose([back[n][t] for t in range(n)], x) for n, x in groups.items())


def test_merge_undoes_split(spark):
    rows = [(k, t, float(v)) for k, x in {"a": [1.0, 4.0, -2.0], "b": [5.0]}.items() for t, v in enumerate(x)]
    d = spark.createDataFrame(rows, "k string, t long, v double")
    n = d.groupBy("k").count().withColumnRenamed("count", "n")
    back = S.haar_merge(S.haar_split(d, "k", "t", "v").join(n, "k"), "k", "i", "smooth", "detail", "t", "v", "n")
    assert sorted((r.k, r.t, round(r.v, 9)) for r in back.collect()) == rows
    assert S.haar_synthesis(S.haar_analysis(d.limit(0), "k", "t", "v"), "k").count() == 0
