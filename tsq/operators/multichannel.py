"""Augmentation of samples with several channels, and the composer of all
fifteen switches.

A row is one sample: (sample_id, label, x), x an array of channels, each an
array of equally many points.  Random numbers are hashes of (sample, channel,
point, op, seed) as in :mod:`tsq.operators.augment`, so a single channel gives
what the long form gives.  Element-wise switches and reorderings are array
expressions; the spline, window and DTW switches are kernels that take all
samples of an Arrow batch in one call.  Switches that need other samples get
them by joins on hashed ranks (a partner, or a few members), from the state
that the switches before them left, which is written first.

What a sample's channels share (as all of them lie on one time axis): segments,
slices, windows, partners, DTW paths and the shuffle of channels.  What each
has of its own: noise, factors, flips and splines.

Defined cases: a sample without a partner, members or rivals stays as it is;
samples may differ in length and number of channels, but DTW pairs them within
a label, whose samples must have equally many channels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.functions import rng
from tsq.operators import align as al
from tsq.operators import augment as au
from tsq.operators import similarity as si
from tsq.operators import warping as wp
from tsq.session import materialize

CHANNELS = T.ArrayType(T.ArrayType(T.DoubleType()))
KNOTS, KNOT_SD = 4, 0.2
BATCH = 6


def _scaled(channels: Column, factors: Column) -> Column:
    """Channels times a factor each, which is worked out once for a channel."""
    return F.zip_with(channels, factors, lambda ch, f: F.transform(ch, lambda v: v * f))


def jitter(df: DataFrame, seed: int, sigma: float = 0.03) -> DataFrame:
    # the part of the hashed key that a channel's points share
    keys = F.transform("x", lambda ch, d: F.concat_ws("|", F.col("sample_id").cast("string"), d.cast("string")))
    return df.withColumn("x", F.zip_with("x", keys, lambda ch, k: F.transform(
        ch, lambda v, t: v + rng.normal(k, t, F.lit(f"jitter|{seed}"), sd=sigma))))


def scaling(df: DataFrame, seed: int, sigma: float = 0.1) -> DataFrame:
    factors = F.transform("x", lambda ch, d: rng.normal("sample_id", d, F.lit("scaling"), F.lit(seed), mean=1.0, sd=sigma))
    return df.withColumn("x", _scaled(F.col("x"), factors))


def rotation(df: DataFrame, seed: int) -> DataFrame:
    """One order of the channels for all samples, a sign for each sample and
    channel of the result."""
    axes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda d: F.struct(rng.uniform(d, F.lit("axis"), F.lit(seed)).alias("u"), d.alias("d"))))
    one = F.when(F.size("x") > 1, axes).otherwise(F.array(F.struct(F.lit(0.0).alias("u"), F.lit(0).alias("d"))))

    def flip(d: Column) -> Column:
        return F.when(rng.uniform("sample_id", d, F.lit("flip"), F.lit(seed)) < F.lit(0.5), F.lit(-1.0)).otherwise(F.lit(1.0))
    turned = F.transform(one, lambda a, d: F.struct(F.get("x", a["d"]).alias("ch"), flip(d).alias("f")))
    return df.withColumn("x", F.transform(turned, lambda e: F.transform(e["ch"], lambda v: v * e["f"])))


def permutation(df: DataFrame, seed: int, max_segments: int = 5, random_points: bool = False) -> DataFrame:
    """1 to ``max_segments`` - 1 segments in a hash order: near-equal ones, or
    cut at distinct random points (a cut at the first point leaves an empty
    segment)."""
    n = F.size(F.get("x", F.lit(0)))
    m = (F.lit(1) + F.floor(rng.uniform("sample_id", F.lit("nseg"), F.lit(seed)) * F.lit(max_segments - 1))).cast("int")
    d = df.withColumn("_n", n).withColumn("_m", m)
    if random_points:
        # the first m - 1 of the points 0 .. n - 3 by their hashes
        order = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))),
                                         lambda i: F.struct(rng.uniform("sample_id", i, F.lit("cut"), F.lit(seed)).alias("u"), i.alias("i"))))
        cuts = F.sort_array(F.transform(F.slice(order, 1, F.greatest(F.col("_m") - 1, F.lit(0))), lambda p: p["i"]))
        d = d.withColumn("_at", F.concat(F.array(F.lit(0)), cuts, F.array(F.col("_n"))))
    else:
        # the first n mod m segments are one longer
        edge = F.transform(F.sequence(F.lit(0), F.col("_m")), lambda k: (k * F.floor(F.col("_n") / F.col("_m")) + F.least(k, F.col("_n") % F.col("_m"))).cast("int"))
        d = d.withColumn("_at", edge)
    segments = F.transform(F.sequence(F.lit(0), F.size("_at") - 2), lambda k: F.struct(
        rng.uniform("sample_id", k, F.lit("perm"), F.lit(seed)).alias("u"), k.alias("k"), F.get("_at", k).alias("a"), F.get("_at", k + 1).alias("b")))
    # the order is worked out once for a sample, as the one element that the outer function takes
    moved = F.transform(F.array(F.sort_array(segments)), lambda order: F.transform(
        "x", lambda ch: F.flatten(F.transform(order, lambda s: F.slice(ch, s["a"] + 1, s["b"] - s["a"])))))
    return d.withColumn("x", F.get(moved, F.lit(0))).drop("_n", "_m", "_at")


# ------------------------------------------------------------ batch kernels
def _samples(col: Sequence) -> list[np.ndarray]:
    """Samples of a column (each its channels in turn) as (points, channels)."""
    return [x.T if isinstance(x, np.ndarray) and x.ndim == 2 else np.stack([np.asarray(ch, float) for ch in x], axis=1) for x in col]


def _arrays(col: pa.Array) -> list:
    """Samples of an Arrow column as (channels, points), nulls as None: views of
    its values, without an object for each of them.  Null values are NaN."""
    each, points = np.asarray(col.offsets), np.asarray(col.values.offsets)
    many, size = np.diff(each), np.diff(points)
    some = many > 0
    if col.values.null_count or (size[each[0]:each[-1]] != np.repeat(size[each[:-1][some]], many[some])).any():
        raise ValueError("all channels of a sample must have equally many points")
    values = col.values.values.to_numpy(zero_copy_only=False)
    spots = zip(np.asarray(col.is_valid()).tolist(), many.tolist(), points[each[:-1]].tolist(), points[each[1:]].tolist())
    return [values[a:b].reshape(m, -1) if there else None for there, m, a, b in spots]


def _plain(col: pa.Array) -> Sequence:
    """A column besides the samples: numbers, samples, or lists of samples."""
    if not pa.types.is_list(col.type):
        return col.to_numpy(zero_copy_only=False)
    if not pa.types.is_list(col.type.value_type.value_type):
        return _arrays(col)
    members, at = _arrays(col.values), np.asarray(col.offsets).tolist()
    return [members[a:b] if there else None for there, a, b in zip(np.asarray(col.is_valid()).tolist(), at, at[1:])]


def _column(samples: Sequence[np.ndarray]) -> pa.Array:
    """Samples as (points, channels) to an Arrow column; NaN is null."""
    many, size = [s.shape[1] for s in samples], [len(s) for s in samples]
    values = np.concatenate([np.zeros(0), *(s.T.ravel() for s in samples)])
    points = np.concatenate([[0], np.cumsum(np.repeat(size, many))]).astype(np.int32)
    channels = pa.ListArray.from_arrays(pa.array(points), pa.array(values, from_pandas=True))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), channels)


def kernel(fn: Callable[..., list[np.ndarray]]):
    """UDF from a function of all samples of a batch and further columns;
    samples without the first further column's value (if it is an array column
    of other samples) are the function's own matter."""
    @F.arrow_udf(CHANNELS)
    def run(x: pa.Array, *more: pa.Array) -> pa.Array:
        return _column(fn(_samples(_arrays(x)), *map(_plain, more)))
    return run


def _alike(samples: Sequence[np.ndarray], *more: Sequence[Hashable]) -> Iterator[tuple[list[int], np.ndarray, tuple]]:
    """Samples of one shape, with one value of each of ``more``, at a time:
    their numbers, (samples, points, channels), and those values."""
    groups: dict = {}
    for i, key in enumerate(zip(map(np.shape, samples), *more)):
        groups.setdefault(key, []).append(i)
    for (shape, *rest), rows in groups.items():
        yield rows, np.concatenate([samples[i] for i in rows]).reshape(len(rows), *shape), tuple(rest)


class Grid:
    """``np.interp`` from the points ``known`` to the points ``wanted`` for
    many samples at once (samples, points, channels)."""

    def __init__(self, wanted: np.ndarray, known: np.ndarray):
        self.wanted, self.known = wanted, known
        last = len(known) - 1
        self.low = np.clip(np.searchsorted(known, wanted, side="right") - 1, 0, last)
        self.high = np.minimum(self.low + 1, last)
        inside = self.high > self.low
        self.gap = np.where(inside, known[self.high] - known[self.low], 1.0)[:, None]
        self.past = np.where(inside, np.maximum(wanted - known[self.low], 0.0), 0.0)[:, None]

    def __call__(self, samples: np.ndarray) -> np.ndarray:
        first = samples[:, self.low]
        with np.errstate(invalid="ignore", over="ignore"):
            out = (samples[:, self.high] - first) / self.gap * self.past + first
        if not np.isfinite(out).all():  # np.interp takes care of values that are not finite
            out = np.stack([np.stack([np.interp(self.wanted, self.known, ch) for ch in s.T], axis=1) for s in samples])
        return out


@lru_cache(maxsize=1024)
def _path_grid(length: int, size: int) -> Grid:
    """As :func:`tsq.operators.augment.resample_path`."""
    return Grid(np.arange(length), np.linspace(0, length - 1.0, num=size))


@lru_cache(maxsize=1024)
def _slice_grid(length: int, size: int) -> Grid:
    return Grid(np.linspace(0, size, num=length), np.arange(size))


@lru_cache(maxsize=1024)
def _window_grid(size: int, wanted: int) -> Grid:
    return Grid(np.linspace(0, size - 1, num=wanted), np.arange(size))


@lru_cache(maxsize=64)
def spline_matrix(length: int, knots: int) -> np.ndarray:
    """The not-a-knot spline through equally spaced knots as a matrix: its
    values at all points are this times the knots' values."""
    xk = np.linspace(0, length - 1.0, num=knots)
    return np.stack([au.not_a_knot_spline(xk, e, np.arange(length, dtype=float)) for e in np.eye(knots)], axis=1)


def curves(samples: list[np.ndarray], knots: list[np.ndarray]) -> list[np.ndarray]:
    """For each sample the smooth curves (points x channels) through its
    knots (knots x channels): one product for all samples of one length."""
    out: list = [None] * len(samples)
    for n in {len(s) for s in samples}:
        rows = [i for i, s in enumerate(samples) if len(s) == n]
        made = spline_matrix(n, len(knots[rows[0]])) @ np.concatenate([knots[i] for i in rows], axis=1)
        stop = np.cumsum([samples[i].shape[1] for i in rows])
        for i, part in zip(rows, np.split(made, stop[:-1], axis=1)):
            out[i] = part
    return out


def _resampled(values: Sequence[np.ndarray], lengths: Sequence[int]) -> list[np.ndarray]:
    """Values along paths, resampled to the given numbers of points."""
    out: list = [None] * len(values)
    for rows, found, (length,) in _alike(values, lengths):
        for i, x in zip(rows, _path_grid(length, found.shape[1])(found)):
            out[i] = x
    return out


def magnitude_warps(samples, knots) -> list[np.ndarray]:
    return [s * c for s, c in zip(samples, curves(samples, _samples(knots)))]


def time_warps(samples, knots) -> list[np.ndarray]:
    ks, out = _samples(knots), []
    at = [_spaced(len(s), len(k)) for s, k in zip(samples, ks)]
    for s, c in zip(samples, curves(samples, [k * a[:, None] for k, a in zip(ks, at)])):
        n, grid = len(s), np.arange(len(s), dtype=float)
        axis = np.clip((n - 1) / c[-1] * c, 0, n - 1)
        warped = np.empty(s.shape)
        for d in range(s.shape[1]):
            warped[:, d] = np.interp(grid, axis[:, d], s[:, d])
        out.append(warped)
    return out


@lru_cache(maxsize=1024)
def _spaced(length: int, knots: int) -> np.ndarray:
    return np.linspace(0, length - 1.0, num=knots)


def window_warps(samples, start, scale) -> list[np.ndarray]:
    out: list = [None] * len(samples)
    for rows, x, (a, f) in _alike(samples, map(int, start), map(float, scale)):
        size = math.ceil(0.1 * x.shape[1])
        window = x[:, a:a + size]
        if not size or window.shape[1] != size:
            made = [np.stack([au.window_warp(ch, a, f) for ch in s.T], axis=1) for s in x]
        else:
            longer = np.concatenate([x[:, :a], _window_grid(size, int(size * f))(window), x[:, a + size:]], axis=1)
            made = _path_grid(x.shape[1], longer.shape[1])(longer)
        for i, s in zip(rows, made):
            out[i] = s
    return out


def slices(samples, ratio, u) -> list[np.ndarray]:
    """:func:`tsq.operators.augment.slice_stretch` of every channel."""
    out = list(samples)
    sizes = [int(np.ceil(r * len(s))) for r, s in zip(np.asarray(ratio).tolist(), samples)]
    u = np.asarray(u, float)
    for rows, x, (size,) in _alike(samples, sizes):
        if size < x.shape[1]:
            start = np.floor(u[rows] * (x.shape[1] - size)).astype(int)
            found = x[np.arange(len(rows))[:, None], start[:, None] + np.arange(size)]
            for i, s in zip(rows, _slice_grid(x.shape[1], size)(found)):
                out[i] = s
    return out


def _bands(lengths) -> list[int]:
    return [-(-n // 10) for n in lengths]


def _aligned(firsts, seconds, lengths, shape: bool, moves: bool) -> Iterator[tuple[list[int], wp.Alignment]]:
    """Alignments of all pairs, band a tenth of the given length: pairs of one
    shape and band at a time, with their numbers."""
    ratio = au.SHAPE_RATIO if shape else None
    for pairs, left, (_, band) in _alike(firsts, map(np.shape, seconds), _bands(lengths)):
        right = np.concatenate([seconds[k] for k in pairs]).reshape(len(pairs), *np.shape(seconds[pairs[0]]))
        at = 0
        for f in wp.warp_batch(left, right, "symmetric", [band] * len(pairs), ratio, moves):
            yield pairs[at:at + len(f.rows)], f
            at += len(f.rows)


def _paths(firsts, seconds, lengths, shape: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list = [None] * len(firsts)
    for pairs, f in _aligned(firsts, seconds, lengths, shape, True):
        for k, path in zip(pairs, f.paths()):
            out[k] = path
    return out


def _distances(firsts, seconds, lengths, shape: bool = False) -> np.ndarray:
    out = np.zeros(len(firsts))
    for pairs, f in _aligned(firsts, seconds, lengths, shape, False):
        out[pairs] = f.distance
    return out


def spawned(samples, protos, cut) -> list[np.ndarray]:
    """Means of samples and partners along the paths of their two halves."""
    out = list(samples)
    rows = [i for i, p in enumerate(protos) if p is not None]
    other = dict(zip(rows, _samples([protos[i] for i in rows])))
    halves = [(i, samples[i][a], other[i][a]) for i in rows for a in (slice(None, int(cut[i])), slice(int(cut[i]), None))]
    found = _paths([a for _, a, _ in halves], [b for _, _, b in halves], [len(samples[i]) for i, _, _ in halves])
    means = []
    for k, i in enumerate(rows):
        (p1, q1), (p2, q2) = found[2 * k], found[2 * k + 1]
        p, q = np.concatenate([p1, p2 + int(cut[i])]), np.concatenate([q1, q2 + int(cut[i])])
        means.append((samples[i][p] + other[i][q]) / 2.0)
    for i, x in zip(rows, _resampled(means, [len(samples[i]) for i in rows])):
        out[i] = x
    return out


def guided(samples, protos, shape: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Samples on their prototypes' time axes, and the points taken."""
    out, taken = list(samples), [np.arange(len(s)) for s in samples]
    rows = [i for i, p in enumerate(protos) if p is not None]
    found = _paths([protos[i] for i in rows], [samples[i] for i in rows], [len(samples[i]) for i in rows], shape)
    warped = _resampled([samples[i][q] for i, (_, q) in zip(rows, found)], [len(samples[i]) for i in rows])
    for i, (_, q), x in zip(rows, found, warped):
        out[i], taken[i] = x, q
    return out, taken


def barycentres(samples, batches) -> list[np.ndarray]:
    """One step of weighted DTW barycentre averaging for each sample's batch
    (:func:`tsq.operators.augment.wdba`), distances and paths of all batches
    in one call each."""
    out = list(samples)
    rows = [i for i, b in enumerate(batches) if b is not None and len(b)]
    members = {i: _samples(batches[i]) for i in rows}
    pairs = [(i, a, b) for i in rows for a in range(len(members[i])) for b in range(a + 1, len(members[i]))]
    far = _distances([members[i][a] for i, a, _ in pairs], [members[i][b] for i, _, b in pairs], [len(members[i][0]) for i, _, _ in pairs])
    apart = {i: np.zeros((len(members[i]),) * 2) for i in rows}
    for (i, a, b), d in zip(pairs, far):
        apart[i][a, b] = apart[i][b, a] = d
    jobs, order = [], {}
    for i in rows:
        order[i] = au.medoid_order(apart[i])
        first, others = order[i][0], order[i][1:]
        if len(others) and apart[i][first, others[0]] != 0.0:
            jobs += [(i, first, o) for o in others]
        else:
            out[i] = members[i][first].copy()
    found = _paths([members[i][f] for i, f, _ in jobs], [members[i][o] for i, _, o in jobs], [len(members[i][f]) for i, f, _ in jobs])
    weights = [0.5 ** (apart[i][f, o] / apart[i][f, order[i][1]]) for i, f, o in jobs]
    # the jobs of samples with equally many channels in one sum, each sample's points after those before it
    for c in {members[i][f].shape[1] for i, f, _ in jobs}:
        mine = [k for k, (i, f, _) in enumerate(jobs) if members[i][f].shape[1] == c]
        start = {i: members[i][f] for i, f, _ in (jobs[k] for k in mine)}
        stop = np.cumsum([len(x) for x in start.values()])
        first = dict(zip(start, (stop - [len(x) for x in start.values()]).tolist()))
        value = np.ascontiguousarray(np.concatenate(list(start.values())).T)
        share = np.ones(value.shape[1])
        spots = np.concatenate([found[k][0] + first[jobs[k][0]] for k in mine])
        weight = np.repeat([weights[k] for k in mine], [len(found[k][0]) for k in mine])
        brought = np.concatenate([members[jobs[k][0]][jobs[k][2]][found[k][1]] for k in mine])
        np.add.at(share, spots, weight)
        for d in range(c):
            np.add.at(value[d], spots, weight * brought[:, d])
        for i, x in zip(start, np.split((value / share).T, stop[:-1])):
            out[i] = x
    return out


def discriminative(samples, pos, neg, shape: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples warped onto the positive that lies far from the negatives and
    near the other positives, and how far that moved their points in time."""
    rows = [i for i in range(len(samples)) if pos[i] is not None and len(pos[i]) and neg[i] is not None and len(neg[i])]
    ps, ns = {i: _samples(pos[i]) for i in rows}, {i: _samples(neg[i]) for i in rows}
    jobs = [(i, a, "p", b) for i in rows for a in range(len(ps[i])) for b in range(len(ps[i])) if a != b]
    jobs += [(i, a, "n", b) for i in rows for a in range(len(ps[i])) for b in range(len(ns[i]))]
    far = _distances([ps[i][a] for i, a, _, _ in jobs], [(ps if w == "p" else ns)[i][b] for i, _, w, b in jobs], [len(samples[i]) for i, *_ in jobs], shape)
    gain = {i: np.zeros(len(ps[i])) for i in rows}
    for (i, a, which, _), d in zip(jobs, far):
        gain[i][a] += d / len(ns[i]) if which == "n" else -d / max(len(ps[i]) - 1, 1)
    protos = [None] * len(samples)
    for i in rows:
        protos[i] = ps[i][int(gain[i].argmax())]
    out, taken = guided(samples, protos, shape)
    moved = np.zeros(len(samples))
    for i, at in zip(rows, _resampled([taken[i][:, None].astype(float) for i in rows], [len(samples[i]) for i in rows])):
        moved[i] = np.abs(at[:, 0] - np.arange(len(at))).sum()
    return out, moved


# --------------------------------------------------------- spline switches
def _knots(tag: str, seed: int) -> Column:
    def one(d: Column) -> Column:
        return F.array(*[rng.normal("sample_id", d, F.lit(j), F.lit(tag), F.lit(seed), mean=1.0, sd=KNOT_SD) for j in range(KNOTS + 2)])
    return F.transform("x", lambda ch, d: one(d))


def magnitude_warp(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("x", kernel(magnitude_warps)("x", _knots("magwarp", seed)))


def time_warp(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("x", kernel(time_warps)("x", _knots("timewarp", seed)))


def _points() -> Column:
    return F.size(F.get("x", F.lit(0)))


def window_slice(df: DataFrame, seed: int, ratio: float = 0.9) -> DataFrame:
    return df.withColumn("x", kernel(slices)("x", F.lit(ratio), rng.uniform("sample_id", F.lit("slice"), F.lit(seed))))


def window_warp(df: DataFrame, seed: int) -> DataFrame:
    n = _points()
    start = (F.lit(1) + F.floor(rng.uniform("sample_id", F.lit("wwstart"), F.lit(seed)) * (n - F.ceil(F.lit(0.1) * n) - 2))).cast("int")
    scale = F.when(rng.uniform("sample_id", F.lit("wwscale"), F.lit(seed)) < 0.5, F.lit(0.5)).otherwise(F.lit(2.0))
    return df.withColumn("x", kernel(window_warps)("x", start, scale))


# ------------------------------------------------------------ DTW switches
def _with_partner(df: DataFrame, seed: int) -> DataFrame:
    pr = al.pick_partner(df.select("sample_id", "label"), "label", "sample_id", seed)
    other = df.select(F.col("sample_id").alias("partner_id"), F.col("x").alias("proto"))
    return si.spread(df.join(pr.select("sample_id", "partner_id"), "sample_id", "left").join(other, "partner_id", "left"), "sample_id")


def _gathered(df: DataFrame, chosen: DataFrame, id_col: str, out: str) -> DataFrame:
    """The samples named in ``chosen`` (sample_id, j, ``id_col``; a few for each) as one array."""
    x = df.select(F.col("sample_id").alias(id_col), F.col("x").alias("mx"))
    g = chosen.join(x, id_col).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "mx"))), lambda e: e["mx"]).alias(out))
    return g


def spawner(df: DataFrame, seed: int) -> DataFrame:
    cut = (F.lit(1) + F.floor(rng.uniform("sample_id", F.lit("cut"), F.lit(seed)) * (_points() - 2))).cast("int")
    d = _with_partner(df, seed)
    return jitter(d.withColumn("x", kernel(spawned)("x", "proto", cut)).select("sample_id", "label", "x"), seed, 0.05)


def _guided_by(shape: bool):
    def run(samples, protos):
        return guided(samples, [None if p is None else _samples([p])[0] for p in protos], shape)[0]
    return run


def guided_warp(df: DataFrame, seed: int, shape: bool = False) -> DataFrame:
    return _with_partner(df, seed).withColumn("x", kernel(_guided_by(shape))("x", "proto")).select("sample_id", "label", "x")


def wdba(df: DataFrame, seed: int) -> DataFrame:
    m = al.pick_members(df.select("sample_id", "label"), "label", "sample_id", BATCH, seed, "wdba", False)
    d = si.spread(df.join(_gathered(df, m, "member_id", "batch"), "sample_id", "left"), "sample_id")
    return d.withColumn("x", kernel(barycentres)("x", "batch")).select("sample_id", "label", "x")


def discriminative_warp(df: DataFrame, seed: int, shape: bool = False) -> DataFrame:
    """The warp, then a slice of 90 to 100 % by how far it moved a sample
    against the one that it moved most."""
    ids = df.select("sample_id", "label")
    pos = _gathered(df, al.pick_members(ids, "label", "sample_id", (BATCH + 1) // 2, seed, "pos", True), "member_id", "pos")
    neg = _gathered(df, al.pick_others(ids, "label", "sample_id", BATCH // 2, seed, "neg", out="neg_id"), "neg_id", "neg")
    d = si.spread(df.join(pos, "sample_id", "left").join(neg, "sample_id", "left"), "sample_id")

    @F.arrow_udf(T.StructType([T.StructField("x", CHANNELS), T.StructField("amount", T.DoubleType())]))
    def warp(x: pa.Array, p: pa.Array, n: pa.Array) -> pa.Array:
        out, moved = discriminative(_samples(_arrays(x)), _plain(p), _plain(n), shape)
        return pa.StructArray.from_arrays([_column(out), pa.array(moved, from_pandas=True)], ["x", "amount"])

    d = materialize(d.select("sample_id", "label", warp("x", "pos", "neg").alias("w")), "warped").select("sample_id", "label", "w.x", "w.amount")
    d = d.crossJoin(F.broadcast(d.agg(F.max("amount").alias("most"))))  # one row
    ratio = F.when(F.col("most") == 0, F.lit(0.9)).otherwise(F.lit(0.9) + F.lit(0.1) * F.col("amount") / F.col("most"))
    return d.withColumn("x", kernel(slices)("x", ratio, rng.uniform("sample_id", F.lit("dslice"), F.lit(seed)))).select("sample_id", "label", "x")


SWITCHES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "jitter": jitter, "scaling": scaling, "rotation": rotation, "permutation": permutation,
    "randompermutation": lambda d, s: permutation(d, s, random_points=True), "magwarp": magnitude_warp, "timewarp": time_warp,
    "windowslice": window_slice, "windowwarp": window_warp, "spawner": spawner, "dtwwarp": guided_warp,
    "shapedtwwarp": lambda d, s: guided_warp(d, s, True), "wdba": wdba, "discdtw": discriminative_warp,
    "discsdtw": lambda d, s: discriminative_warp(d, s, True),
}
#: Switches that join samples with others.
PAIRED = {"spawner", "dtwwarp", "shapedtwwarp", "wdba", "discdtw", "discsdtw"}


def pipeline(df: DataFrame, enabled: Sequence[str], seed: int) -> tuple[DataFrame, str]:
    """The enabled switches in their fixed order, and the tag string."""
    unknown = set(enabled) - SWITCHES.keys()
    if unknown:
        raise ValueError(f"no such switch: {sorted(unknown)}")
    df, tag = df.select("sample_id", "label", "x"), ""
    for name in au.PIPELINE_ORDER:
        if name in enabled:
            if name in PAIRED and tag:  # read several times below
                df = materialize(df, "augmented")
            df = SWITCHES[name](df, seed)
            tag += au.TAGS[name]
    return df, tag


def one_channel(arrays: DataFrame) -> DataFrame:
    """Samples (sample_id, label, x) of plain arrays as samples of one channel."""
    return arrays.select("sample_id", "label", F.array("x").alias("x"))


def long_form(df: DataFrame, channel: bool = True) -> DataFrame:
    """(sample_id, label, channel, t, value); without ``channel`` the first one alone."""
    if not channel:
        return df.select("sample_id", "label", F.posexplode(F.get("x", F.lit(0))).alias("t", "value"))
    d = df.select("sample_id", "label", F.posexplode("x").alias("channel", "_ch"))
    return d.select("sample_id", "label", "channel", F.posexplode("_ch").alias("t", "value"))
