"""Spectra and circular correlations of whole windows held as arrays.

One row holds one window (bounded by the window length), and a kernel call
takes all windows of an Arrow batch: windows of equal length are one matrix,
transformed by one FFT, L log L for each, where the long form of
:mod:`tsq.operators.spectral` joins L x L rows.  No window crosses a task, so
nothing is shuffled; :func:`to_windows` gathers a long-form table first.

Null points count as 0; a null window has null results, an empty one empty
lists.  The imaginary part is exactly 0 at frequency 0 and, for even L, at L/2;
the phase of an amplitude under ``NO_PHASE`` is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators.index import _keys

#: Amplitude below which a phase is noise.
NO_PHASE = 1e-9
DOUBLES = T.ArrayType(T.DoubleType())
SPECTRUM = T.StructType([T.StructField(c, DOUBLES) for c in ("re", "im", "amp", "phase")])


def to_windows(df: DataFrame, keys, t: str, x: str, out: str = "x") -> DataFrame:
    """(keys, out): the values of each window in order of ``t``."""
    points = F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("v"))))
    return df.groupBy(*_keys(keys)).agg(F.transform(points, lambda p: p["v"]).alias(out))


def _matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of a list column with their values as a matrix."""
    size = np.asarray(pc.list_value_length(col).fill_null(0)).astype(np.int64)
    there = ~np.asarray(pc.is_null(col))
    values = np.asarray(col.flatten().cast(pa.float64()).fill_null(0.0))
    begin = np.cumsum(size) - size
    for n in np.unique(size[there]):
        rows = np.flatnonzero(there & (size == n))
        yield rows, values[begin[rows][:, None] + np.arange(n)]


def _lists(rows: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One list per row from matrices of rows; rows without any are null."""
    size, there = np.zeros(rows, np.int64), np.zeros(rows, bool)
    for at, m in parts:
        size[at], there[at] = m.shape[1], True
    begin = np.cumsum(size) - size
    values = np.empty(int(size.sum()))
    for at, m in parts:
        values[begin[at][:, None] + np.arange(m.shape[1])] = m
    return pa.ListArray.from_arrays(pa.array(np.append(begin, size.sum()).astype(np.int32)), pa.array(values), mask=pa.array(~there))


def rfft(x: np.ndarray) -> np.ndarray:
    """Real DFT of each row, with real end points."""
    n = x.shape[1]
    if n == 0:
        return np.zeros((len(x), 0), complex)
    f = np.fft.rfft(x, axis=1)
    f.imag[:, 0] = 0.0
    if n % 2 == 0:
        f.imag[:, -1] = 0.0
    return f


def circular(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """r[tau] = sum_t x[(t + tau) mod L] y[t] of each pair of rows, by the product of their spectra."""
    n = x.shape[1]
    if n == 0:
        return x
    if x is not y:
        return np.fft.irfft(np.fft.rfft(x, axis=1) * np.conj(np.fft.rfft(y, axis=1)), n=n, axis=1)
    f = np.fft.rfft(x, axis=1)
    r = np.fft.irfft(f.real ** 2 + f.imag ** 2, n=n, axis=1)
    r[:, 1:] = (r[:, 1:] + r[:, :0:-1]) / 2  # lags tau and L - tau are equal to the last bit
    return r


@F.arrow_udf(SPECTRUM)
def _spectrum(x: pa.Array) -> pa.Array:
    parts = [(rows, rfft(m)) for rows, m in _matrices(x)]
    amp = [(rows, np.abs(f)) for rows, f in parts]
    phase = [(rows, np.where(a < NO_PHASE, 0.0, np.arctan2(f.imag, f.real))) for (rows, f), (_, a) in zip(parts, amp)]
    re, im = [(rows, f.real) for rows, f in parts], [(rows, f.imag + 0.0) for rows, f in parts]
    return pa.StructArray.from_arrays([_lists(len(x), p) for p in (re, im, amp, phase)], names=["re", "im", "amp", "phase"])


@F.arrow_udf(DOUBLES)
def _autocorrelation(x: pa.Array) -> pa.Array:
    return _lists(len(x), [(rows, circular(m, m)) for rows, m in _matrices(x)])


@F.arrow_udf(DOUBLES)
def _correlation(x: pa.Array, y: pa.Array) -> pa.Array:
    other = {}
    for rows, m in _matrices(y):
        other.update(zip(rows.tolist(), m))
    parts = []
    for rows, m in _matrices(x):
        same = np.array([r in other and len(other[r]) == m.shape[1] for r in rows.tolist()], bool)
        if same.any():
            parts.append((rows[same], circular(m[same], np.stack([other[r] for r in rows[same].tolist()]))))
    return _lists(len(x), parts)


def spectrum(x: str | Column) -> Column:
    """Real DFT of a window: arrays re, im, amp, phase over k = 0 .. L // 2."""
    return _spectrum(x)


def correlation(x: str | Column, y: str | Column | None = None) -> Column:
    """Circular correlation over all lags (of x with itself without y); null
    where the lengths differ."""
    return _autocorrelation(x) if y is None else _correlation(x, y)


def frequencies(df: DataFrame, keys, x: str) -> DataFrame:
    """Long form of the spectrum: (keys, k, re, im, amp, phase, L)."""
    keys = _keys(keys)
    d = df.select(*keys, F.size(x).cast("long").alias("L"), spectrum(x).alias("_s"))
    zipped = F.arrays_zip(*[F.col(f"_s.{c}").alias(c) for c in ("re", "im", "amp", "phase")])
    d = d.select(*keys, "L", F.posexplode(zipped).alias("k", "_p"))
    return d.select(*keys, F.col("k").cast("long").alias("k"), "_p.re", "_p.im", "_p.amp", "_p.phase", "L")


def correlations(df: DataFrame, keys, x: str, y: str | None = None) -> DataFrame:
    """Long form of the circular correlation: (keys, tau, corr)."""
    keys = _keys(keys)
    d = df.select(*keys, F.posexplode(correlation(x, y)).alias("tau", "corr"))
    return d.select(*keys, F.col("tau").cast("long").alias("tau"), "corr")


def delays(corr: str | Column, factor: float, digits: int = 9) -> Column:
    """The first floor(factor ln L) lags by correlation, as an array of
    (tau, corr).  Correlations are compared to so many decimals, so that
    mirrored lags tie and the shorter one comes first."""
    c = F.col(corr) if isinstance(corr, str) else corr
    scale = F.lit(10.0 ** digits)

    def near(v: Column) -> Column:  # from 2^52 / scale on, a double has no more decimals
        return F.when(F.abs(v) < F.lit(2.0 ** 52) / scale, F.floor(v * scale + F.lit(0.5)) / scale).otherwise(v)

    ranked = F.array_sort(F.transform(c, lambda v, i: F.struct((-near(v)).alias("down"), i.cast("long").alias("tau"), v.alias("corr"))))
    n = F.floor(F.lit(factor) * F.log(F.greatest(F.size(c), F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(n, F.lit(0))), lambda d: F.struct(d["tau"].alias("tau"), d["corr"].alias("corr")))


def delay_aggregate(x: str, lags: str) -> Column:
    """The window rolled by each lag, averaged with the softmax of the lags'
    correlations: out[t] = sum_i w_i x[(t + tau_i) mod L]."""
    d = F.col(lags)
    top = F.array_max(F.transform(d, lambda p: p["corr"]))
    w = F.transform(d, lambda p: F.exp(p["corr"] - top))
    total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    parts = F.arrays_zip(F.transform(d, lambda p: p["tau"]).alias("tau"), w.alias("w"))
    n = F.size(x)

    def at(t: Column) -> Column:
        rolled = lambda a, p: a + p["w"] / total * F.element_at(x, ((t + p["tau"]) % n + 1).cast("int"))
        return F.aggregate(parts, F.lit(0.0), rolled)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def causal_convolution(df: DataFrame, keys, x: str, weights: Sequence[float], out: str = "y") -> DataFrame:
    """y[t] = sum_j weights[j] x[t - j] over the points from t = 0 on: (keys, t,
    out), by a weighted sum inside each window's row.

    Rows of equal keys are one window: its points are their sums, times the
    number of rows that reach t (what a join of the points with themselves
    gives).  Null points are left out; rows of a null key are dropped."""
    keys = _keys(keys)
    there = F.size(x) > 0
    for k in keys:
        there = there & F.col(k).isNotNull()
    d = df.where(there).groupBy(*keys).agg(F.collect_list(x).alias("_xs"))
    none = F.lit(None).cast("double")

    def plus(a: Column, v: Column) -> Column:
        return F.coalesce(a + v, a, v)

    places = F.sequence(F.lit(0), F.array_max(F.transform("_xs", F.size)) - 1)
    total = F.transform(places, lambda t: F.aggregate("_xs", none, lambda a, w: plus(a, F.get(w, t))))
    reach = F.transform(places, lambda t: F.size(F.filter("_xs", lambda w: F.size(w) > t)).cast("double"))
    d = d.select(*keys, F.when(F.size("_xs") == 1, F.get("_xs", F.lit(0))).otherwise(total).alias("_x"),
                 F.when(F.size("_xs") > 1, reach).alias("_n"))
    back = F.array(*[F.lit(float(w)) for w in reversed(weights)])
    n = len(weights)

    def at(t: Column) -> Column:
        m = F.least(t + 1, F.lit(n))
        near = F.zip_with(F.slice("_x", t + 2 - m, m), F.slice(back, F.lit(n + 1) - m, m), lambda v, w: v * w)
        return F.aggregate(near, none, plus) * F.coalesce(F.get("_n", t), F.lit(1.0))

    y = F.transform("_x", lambda v, t: at(t))
    return d.select(*keys, y.alias("_y")).select(*keys, F.posexplode("_y").alias("t", out))
