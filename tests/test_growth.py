"""Steps whose rows or bytes must not outgrow their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators import spectral as sp
from tsq.operators import spectrum as sq

SAMPLES = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _samples(spark, n=4, length=8):
    draw = np.random.default_rng(5)
    return spark.createDataFrame([(i, i % 2, [float(v) for v in draw.normal(size=length)]) for i in range(n)], SAMPLES)


def test_f1_exploded_time_grid_is_not_broadcast(spark):
    s = _samples(spark)
    spec = sq.frequencies(s, "sample_id", "x").where("k > 0")
    n = s.groupBy("sample_id").agg(F.sum(F.size("x")).alias("L"))
    grid = n.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("L") + 3)).alias("t"))
    out = sp.idft(spec, grid, "sample_id", "t", "v")
    plan = _plan(out)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = {(r["sample_id"], r["t"]): r["v"] for r in out.collect()}
    for r in s.collect():
        x = np.array(r["x"]) - np.mean(r["x"])
        assert [got[r["sample_id"], t] for t in range(12)] == pytest.approx([x[t % 8] for t in range(12)])


def test_f2_season_is_not_broadcast(spark, tmp_path):
    from tsq.plans.udf import q_ets
    s = _samples(spark).select(F.col("sample_id").alias("vec_id"), "label", F.col("x").alias("embedding"))
    s.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = q_ets(spark, str(tmp_path))
    plan = _plan(out)
    # each join with the exploded grid or the season is a merge join
    final = plan.split("Initial Plan")[0]
    joins = [line for line in final.splitlines() if "BroadcastHashJoin" in line and ("season" in line or "_st" in line or ", t#" in line)]
    assert not joins
    assert out.count() == 4 * 16


def test_f7_convolution_moves_windows_not_terms(spark):
    w = [0.5, 0.25, 0.125]
    rows = [(0, 0, [1.0, 2.0, None, 4.0, 5.0]), (1, 0, [1.0, 1.0]), (1, 0, [2.0, 3.0, 4.0]), (2, 0, []), (3, 0, None), (4, 1, [None, 7.0]), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, SAMPLES)
    out = sq.causal_convolution(df, "sample_id", "x", w)
    assert "Join" not in _plan(out)
    got = {(r["sample_id"], r["t"]): r["y"] for r in out.collect()}
    points = [(i, t, v) for i, _, x in rows if x and i is not None for t, v in enumerate(x)]
    want: dict = {}
    for i, t, _ in points:  # the points joined with themselves
        for j, wj in enumerate(w):
            for i2, t2, v in points:
                if i2 == i and t2 == t - j:
                    old = want.setdefault((i, t), None)
                    want[i, t] = old if v is None else (old or 0.0) + wj * v
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()}


def test_f3_grid_of_points_is_not_broadcast(spark):
    d = spark.createDataFrame([("a", t, float(t)) for t in range(9)] + [("b", 0, 4.0)], "k string, t long, v double")
    # read back, so that sizes are known when the joins are planned
    out = sp.haar_synthesis(sp.haar_analysis(d, "k", "t", "v").localCheckpoint(), "k")
    final = _plan(out).split("Initial Plan")[0]
    on_points = [line for line in final.splitlines() if "HashJoin" in line and ("level" in line or ", t#" in line)]
    assert "SortMergeJoin" in final and not on_points
    assert sorted((r["k"], r["t"], round(r["value"], 9)) for r in out.collect()) == [("a", t, float(t)) for t in range(9)] + [("b", 0, 4.0)]


@pytest.mark.parametrize("block", [3, 256])
def test_f4_distances_of_whole_classes(spark, block):
    from tsq.operators import similarity as si
    draw = np.random.default_rng(6)
    rows = [(i, 0 if i < 11 else 1, [float(v) for v in draw.normal(size=12)]) for i in range(15)]
    odd = [(20, 1, None), (None, 1, [1.0]), (21, None, [1.0])]
    df = spark.createDataFrame(rows + odd, SAMPLES)
    got = [tuple(r) for r in si.class_distances(df, "label", "sample_id", "x", 0.1, block).collect()]
    want = {(g, a, b): 0.0 if a == b else si.dtw(*((x, y) if a < b else (y, x)), "symmetric", 2)[0]
            for a, g, x in rows for b, h, y in rows if g == h} | {(1, 20, 20): 0.0}
    assert len(got) == len(want) == 11 ** 2 + 4 ** 2 + 1
    assert {r[:3]: r[3] for r in got} == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("shape", [None, 0.05])
def test_f5_f6_costs_are_made_in_the_band_alone(monkeypatch, shape):
    from tsq.operators import warping as wp
    cells = []
    plain = wp.DISTANCES["euclidean"]
    monkeypatch.setitem(wp.DISTANCES, "euclidean", lambda d: cells.append(int(np.prod(d.shape[:-1]))) or plain(d))
    draw = np.random.default_rng(7)
    xs, ys = [list(draw.normal(size=(30, 16)))] * 2
    found = list(wp.warp_batch(xs, ys, "symmetric", [2] * 30, shape, True))
    assert sum(cells) <= 30 * 16 * 5
    for f in found:
        assert f.distance == pytest.approx(0.0)
        assert all((p == q).all() and len(p) == 16 for p, q in f.paths())


def test_f5_switches_take_all_samples_of_a_shape_at_once(monkeypatch):
    import pyarrow as pa
    from tsq.operators import augment as au
    from tsq.operators import multichannel as mc
    draw = np.random.default_rng(3)
    rows = [draw.normal(size=(2, n)).tolist() for n in [20] * 40 + [13] * 20]
    start, scale, ratio, u = [3] * 60, [0.5, 2.0] * 30, [0.9, 0.93, 1.0] * 20, draw.random(60)
    kind = pa.list_(pa.list_(pa.float64()))
    samples = mc._samples(mc._arrays(pa.array([None, *rows], kind).slice(1)))
    assert mc._column(samples).equals(pa.array(rows, kind)) and mc._plain(pa.array([None, [rows[0]], []], pa.list_(kind)))[::2] == [None, []]
    want = [[np.stack([au.window_warp(ch, a, f) for ch in np.array(x)], axis=1) for x, a, f in zip(rows, start, scale)],
            [np.stack([au.slice_stretch(ch, r, v) for ch in np.array(x)], axis=1) for x, r, v in zip(rows, ratio, u)]]
    protos = samples[1:40] + samples[:1] + samples[41:] + samples[40:41]
    want.append([np.stack([au.resample_path(ch, len(x[0])) for ch in np.array(x)[:, q]], axis=1)
                 for x, q in zip(rows, mc.guided(samples, protos)[1])])
    calls = []
    monkeypatch.setattr(np, "interp", lambda *a: calls.append(a))
    got = [mc.window_warps(samples, start, scale), mc.slices(samples, ratio, u), mc.guided(samples, protos)[0]]
    assert not calls  # one for each channel of each sample before
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            np.testing.assert_allclose(x, y, atol=1e-12)
    with pytest.raises(ValueError):
        mc._arrays(pa.array([[[1.0, 2.0], [1.0]]], kind))


@pytest.mark.parametrize("size, reach", [(1, 1), (2, 0), (7, 3), (12, 2), (20, 30)])
def test_f2_matrix_has_the_distances_of_single_pairs(monkeypatch, size, reach):
    from tsq.operators import warping as wp
    monkeypatch.setattr(wp, "MATRIX_PAIRS", 12)
    monkeypatch.setattr(wp, "MATRIX_COLS", 4)
    draw = np.random.default_rng(8)
    xs, ys = draw.normal(size=(9, size)), draw.normal(size=(5, size))
    for x, y in ((xs, ys), (ys, xs), (xs, ys[:1])):
        p, q = (k.ravel() for k in np.indices((len(x), len(y))))
        want = next(wp.warp_batch(list(x[p]), list(y[q]), "symmetric", [reach] * len(p))).distance
        np.testing.assert_array_equal(wp.distance_matrix(x, y, reach).ravel(), want)
    assert wp.distance_matrix(xs[:0], ys, reach).shape == (0, 5)


@pytest.mark.parametrize("block", [4, 256])
def test_f2_pairs_of_a_length_are_aligned_as_a_matrix(spark, monkeypatch, block):
    from tsq.operators import similarity as si
    from tsq.operators import warping as wp
    draw = np.random.default_rng(9)
    values = [list(map(float, draw.normal(size=n))) for n in [12] * 7 + [11] * 5 + [12, 12]]
    values[-1][3], values[-2][11], values[2][0] = float("inf"), float("nan"), values[3][0]
    rows = [(i, 0, v) for i, v in enumerate(values)] + [(5, 0, values[0]), (30, 0, None)]
    got = [tuple(r)[1:] for r in si.class_distances(spark.createDataFrame(rows, SAMPLES), "label", "sample_id", "x", 0.1, block).collect()]
    want = []
    for a, _, x in rows:
        for b, _, y in rows:
            if a != b and x is not None and y is not None:
                lo, hi = (x, y) if a < b else (y, x)
                want.append((a, b, next(wp.warp_batch([lo], [hi], "symmetric", [int(np.ceil(len(hi) * 0.1))])).distance[0]))
    want += [(a, a, 0.0) for a, _, _ in rows]
    assert sorted(map(str, got)) == sorted(str((a, b, float(d))) for a, b, d in want)
    aligned, plain = [], wp.cost_batch
    monkeypatch.setattr(wp, "cost_batch", lambda xs, *a, **k: aligned.append(len(xs)) or plain(xs, *a, **k))
    i, j = np.triu_indices(7, 1)
    everyone = np.ones(7, bool)
    assert len(si._pair_distances([np.array(v) for v in values[:7]], i, j, [everyone, everyone], 0.1)) == 21 and not aligned


def test_f3_groups_smoothed_together_equal_single_ones(monkeypatch):
    from tsq.operators import recurrence as rc
    monkeypatch.setattr(rc, "LONG_ROWS", 20)
    draw = np.random.default_rng(10)
    parts = [np.where(draw.random(n) < 0.3, np.nan, draw.normal(size=n)) for n in draw.integers(1, 30, 60)]
    parts += [np.full(5, np.nan), np.full(25, np.nan), np.full(9, 0.1), np.array([np.nan, 2.0])]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    for alpha in (0.5, 0.07, 1.0):
        first, y, kept = rc._locals(np.concatenate(parts), starts, alpha)
        for part, at, begin in zip(parts, starts, first):
            want = rc._local(part, alpha)
            rows = slice(at, at + len(part))
            assert begin == want[0]
            np.testing.assert_allclose(y[rows], want[1], rtol=1e-14)
            if begin >= 0:
                np.testing.assert_allclose(kept[rows], want[2], rtol=1e-12)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_f3_many_series_are_smoothed_without_a_call_each(spark, batch):
    import pandas as pd
    from tsq.operators.recurrence import Smooth, smoothed
    draw = np.random.default_rng(11)
    series = {(f"s{i}", None if i % 9 == 0 else i): [None if u < 0.2 else float(u) for u in draw.random(int(draw.integers(1, 40)))] for i in range(50)}
    rows = [(a, b, t, v) for (a, b), x in series.items() for t, v in enumerate(x)] + [("s1", 1, None, 3.0), (None, None, 0, 4.0)]
    df = spark.createDataFrame(rows, "a string, b long, t long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = smoothed(df, ["a", "b"], "t", [Smooth("x", 0.3, "y"), Smooth("x", 0.5, "z")], block=8)
        assert "FlatMapGroups" not in _plan(out)
        got = {tuple(r)[:3]: (r["y"], r["z"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and got["s1", 1, None] == (None, None) and got[None, None, 0] == (4.0, 4.0)
    for (a, b), x in series.items():
        for alpha, k in ((0.3, 0), (0.5, 1)):
            want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, ignore_na=False).mean()
            for t, w in enumerate(want):
                assert got[a, b, t][k] == (None if np.isnan(w) else pytest.approx(w))
