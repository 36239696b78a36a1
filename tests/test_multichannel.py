"""Switches on several channels: single-channel kernels as reference, every switch alone and all in order."""
import numpy as np
import pytest

from tsq.operators import augment as au
from tsq.operators import multichannel as mc

ONE_BY_ONE = [s for s in au.PIPELINE_ORDER]


def _samples(n=24, channels=3, points=30, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, i % 3, rng.normal(size=(channels, points)).cumsum(axis=1).tolist()) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, label int, x array<array<double>>")


def _got(df):
    return {r.sample_id: np.array(r.x) for r in df.collect()}


@pytest.mark.parametrize("name", ONE_BY_ONE)
def test_every_switch_keeps_samples_channels_and_points(spark, name):
    rows = _samples() + [(99, 7, [[1.0, 2.0, 4.0, 8.0, 9.0, 3.0]] * 3)]  # a class of one
    out, tag = mc.pipeline(_frame(spark, rows), [name], 5)
    got = _got(out)
    assert tag == au.TAGS[name] and {i: x.shape for i, x in got.items()} == {i: np.array(x).shape for i, _, x in rows}
    assert all(np.isfinite(x).all() for x in got.values())
    again, _ = mc.pipeline(_frame(spark, rows[::-1]).repartition(7), [name], 5)
    back = _got(again)
    assert all(np.allclose(x, back[i]) for i, x in got.items())
    changed = sum(not np.allclose(got[i], np.array(x)) for i, _, x in rows)
    assert changed


def test_rotation_shares_one_shuffle(spark):
    rows = _samples(60)
    got = _got(mc.rotation(_frame(spark, rows), 3))
    orders = set()
    for i, _, x in rows:
        x = np.array(x)
        where = [next(d for d in range(3) if np.allclose(abs(got[i][j]), abs(x[d]))) for j in range(3)]
        orders.add(tuple(where))
    assert len(orders) == 1 and sorted(*orders) == [0, 1, 2]


@pytest.mark.parametrize("random_points", [False, True])
def test_permutation_moves_whole_points(spark, random_points):
    rows = _samples(40)
    got = _got(mc.permutation(_frame(spark, rows), 3, random_points=random_points))
    moved, sizes = 0, set()
    for i, _, x in rows:
        x = np.array(x)
        at = [int(np.flatnonzero((x == got[i][:, t:t + 1]).all(axis=0))[0]) for t in range(30)]
        assert sorted(at) == list(range(30))
        breaks = np.flatnonzero(np.diff(at) != 1)
        moved += at != list(range(30))
        sizes.add(len(breaks) + 1)
    assert moved > 10 and max(sizes) <= 4


def test_batch_kernels_equal_single_samples():
    rng = np.random.default_rng(3)
    s = [rng.normal(size=(n, 1)).cumsum(axis=0) for n in (30, 30, 17)]
    knots = [rng.normal(1, 0.2, size=(1, 6)).tolist() for _ in s]
    flat = [x[:, 0] for x in s]
    for many, one in ((mc.magnitude_warps, au.magnitude_warp), (mc.time_warps, au.time_warp)):
        for got, x, k in zip(many(s, knots), flat, knots):
            np.testing.assert_allclose(got[:, 0], one(x, np.array(k[0])), atol=1e-9)
    as_rows = lambda xs: [x.T.tolist() for x in xs]
    p = [s[1], s[0], None]
    for got, x, q, c in zip(mc.spawned(s, [None if v is None else v.T.tolist() for v in p], [7, 11, 5]), flat, p, [7, 11, 5]):
        np.testing.assert_allclose(got[:, 0], x if q is None else au.spawner(x, q[:, 0], c), atol=1e-9)
    for shape in (False, True):
        for got, x, q in zip(mc.guided(s, p, shape)[0], flat, p):
            np.testing.assert_allclose(got[:, 0], x if q is None else au.guided_warp(x, q[:, 0], shape)[0], atol=1e-9)
    t = np.linspace(0, 6, 30)
    group = [np.sin(t), np.sin(t + 0.2), np.sin(t) + 0.3, np.cos(t)]
    batches = [as_rows([g[:, None] for g in group[:3]]), as_rows([group[0][:, None]] * 2), None]
    for got, b, x in zip(mc.barycentres(s, batches), [group[:3], [group[0]] * 2, None], flat):
        np.testing.assert_allclose(got[:, 0], x if b is None else au.wdba(b), atol=1e-9)
    pos, neg = group[:3], [group[3], group[3] + 0.1]
    out, moved = mc.discriminative(s[:2] + [s[0]], [as_rows([g[:, None] for g in pos])] * 2 + [None], [as_rows([g[:, None] for g in neg])] * 3)
    for got, m, x in zip(out[:2], moved, flat):
        want, amount = au.discriminative_warp(x, pos, neg)
        np.testing.assert_allclose(got[:, 0], want, atol=1e-9)
        assert m == pytest.approx(amount)
    assert moved[2] == 0 and out[2] is s[0]


def test_channels_of_one_sample_share_their_paths():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 1)).cumsum(axis=0), rng.normal(size=(20, 1)).cumsum(axis=0)
    two, = mc.guided([np.hstack([a, a])], [np.hstack([b, b])])[0]
    one, = mc.guided([a], [b])[0]
    np.testing.assert_allclose(two, np.hstack([one, one]))


def test_all_switches_in_order_and_the_long_form(spark):
    out, tag = mc.pipeline(_frame(spark, _samples(12)), au.PIPELINE_ORDER, 1)
    assert tag == "".join(au.TAGS[s] for s in au.PIPELINE_ORDER) and all(x.shape == (3, 30) for x in _got(out).values())
    with pytest.raises(ValueError):
        mc.pipeline(out, ["nothing"], 1)
    rows = [(i, i % 2, t, float(np.sin(t + i))) for i in range(6) for t in range(20)]
    long = spark.createDataFrame(rows, "sample_id long, label int, t int, value double")
    for some in (["randompermutation"], ["jitter", "magwarp", "dtwwarp", "wdba"]):
        got, tag = au.pipeline(long, some, 2)
        assert got.columns == au.COLS and got.count() == 120 and tag == "".join(au.TAGS[s] for s in some)
    both = [sorted(map(tuple, d.collect())) for d in (au.pipeline(long, ["jitter", "permutation"], 2)[0],
            mc.long_form(mc.pipeline(spark.createDataFrame([(i, i % 2, [[float(np.sin(t + i)) for t in range(20)]]) for i in range(6)],
                                                           "sample_id long, label int, x array<array<double>>"), ["jitter", "permutation"], 2)[0], False))]
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3]) for a, b in zip(*both))
