"""Spectral operators as relational jobs: DFT as an aggregate, frequency
selection by ranking, reconstruction by a join with the time grid; Haar
transform by grouping pairs.  Spectra and correlations of windows held as
arrays are in :mod:`tsq.operators.spectrum`.

They act on fixed-length windows / samples (L points each, L bounded by the
window length), so every group is bounded: (sample, k) sums L terms,
ranking runs over L/2 + 1 frequencies of one sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.operators.index import _keys
from tsq.operators.windows import with_count

TWO_PI = 2.0 * math.pi


def _angle(k, t, n) -> Column:
    """2*pi*k*t/L evaluated as lit(2pi) * double(k*t) / double(L)."""
    return F.lit(TWO_PI) * (k * t).cast("double") / n.cast("double")


def dft(df: DataFrame, keys, t: str, x: str) -> DataFrame:
    """Real DFT of every series: (keys, k, re, im, amp, L) for
    k = 0..L//2, X_k = sum_t x_t exp(-2 pi i k t / L)."""
    keys = _keys(keys)
    d = with_count(df.select(*keys, t, x), keys, "L")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("L") / 2))))
    ang = _angle(F.col("k"), F.col(t), F.col("L"))
    s = d.groupBy(*keys, "k").agg(F.sum(F.col(x) * F.cos(ang)).alias("re"),
                                  (-F.sum(F.col(x) * F.sin(ang))).alias("im"), F.first("L").alias("L"))
    return s.withColumn("amp", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def rank_freqs(spec: DataFrame, keys, k: int, score: str = "amp", skip_dc: bool = True,
               skip_nyquist: bool = False, out: str = "rank") -> DataFrame:
    """Top ``k`` frequencies per series by ``score`` (ties: lower index);
    a series' spectrum is L/2 + 1 rows, so the ranking group is bounded."""
    keys = _keys(keys)
    s = spec
    if skip_dc:
        s = s.filter(F.col("k") > 0)
    if skip_nyquist:
        s = s.filter(~((F.col("L") % 2 == 0) & (F.col("k") * 2 == F.col("L"))))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("k"))
    return s.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def idft(spec: DataFrame, times: DataFrame, keys, t: str, out: str, scale: Column | None = None) -> DataFrame:
    """x_t = (1/L) sum_k c_k (re_k cos(theta) - im_k sin(theta)), theta =
    2 pi k t / L, c = 1 for DC and Nyquist, 2 otherwise, over the rows of
    ``spec`` (a subset of frequencies); ``times`` gives (keys, t) rows
    (t may run past L for extrapolation).

    The rows meet in a merge join on the keys: a grid of times exploded from
    one row per series is estimated as that one row, so it would be broadcast
    whole through the driver."""
    keys = _keys(keys)
    j = times.select(*keys, t).join(spec.select(*keys, "k", "re", "im", "L").hint("merge"), keys)
    ang = _angle(F.col("k"), F.col(t), F.col("L"))
    c = F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("L")), F.lit(1.0)).otherwise(F.lit(2.0))
    term = c * (F.col("re") * F.cos(ang) - F.col("im") * F.sin(ang))
    sc = (F.lit(1.0) / F.col("L").cast("double")) if scale is None else scale
    return j.groupBy(*keys, t).agg((F.sum(term) * F.first(sc)).alias(out))


def softshrink(c: Column, lam: float) -> Column:
    return F.signum(c) * F.greatest(F.abs(c) - F.lit(lam), F.lit(0.0))


def haar_split(df: DataFrame, keys, t: str, x: str) -> DataFrame:
    """One level: smooth = (x_2i + x_2i+1)/sqrt2, detail = (x_2i - x_2i+1)/sqrt2
    (an odd last point pairs with 0)."""
    keys = _keys(keys)
    r2 = math.sqrt(2.0)
    g = df.groupBy(*keys, F.floor(F.col(t) / 2).alias("i")).agg(
        F.sum(F.when(F.col(t) % 2 == 0, F.col(x)).otherwise(F.lit(0.0))).alias("_e"),
        F.sum(F.when(F.col(t) % 2 == 1, F.col(x)).otherwise(F.lit(0.0))).alias("_o"))
    return g.select(*keys, F.col("i").cast("long").alias("i"), ((F.col("_e") + F.col("_o")) / F.lit(r2)).alias("smooth"),
                    ((F.col("_e") - F.col("_o")) / F.lit(r2)).alias("detail"))


def haar_merge(df: DataFrame, keys, i: str, smooth: str, detail: str, t: str, out: str, length: str | None = None) -> DataFrame:
    """Inverse of :func:`haar_split`: two points from each pair of
    coefficients, cut back to ``length`` points (a column) if given."""
    keys = _keys(keys)
    r2 = F.lit(math.sqrt(2.0))
    two = F.array(F.struct((F.col(i) * 2).alias(t), ((F.col(smooth) + F.col(detail)) / r2).alias(out)),
                  F.struct((F.col(i) * 2 + 1).alias(t), ((F.col(smooth) - F.col(detail)) / r2).alias(out)))
    d = df.select(*keys, *([length] if length else []), F.inline(two))
    return (d.where(F.col(t) < F.col(length)) if length else d).select(*keys, t, out)


def _levels(points: Column) -> Column:
    """Levels of a series of so many points (a power of two)."""
    return F.round(F.log2(points.cast("double"))).cast("int")


def haar_analysis(df: DataFrame, keys, t: str, x: str) -> DataFrame:
    """All levels of the orthonormal Haar transform of every series (``t``:
    positions from 0), circularly extended to P points, the next power of two:
    (keys, level, i, smooth, detail, n), n the length of the series.

    A coefficient of level j is the signed sum of its 2^j points over 2^(j/2),
    so every point is added to its coefficient on each level in one keyed
    aggregate, whatever the number of levels.  A series of one point has level
    0 alone (its value as smooth, no detail)."""
    keys = _keys(keys)
    d = with_count(df.select(*keys, t, x), keys, "n")
    p2 = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("long")
    d = d.withColumn("_p", p2)
    again = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_p") - 1 - F.col(t)) / F.col("n")).cast("long"))
    d = d.withColumn("_r", F.explode(again)).withColumn("_t", F.col(t) + F.col("_r") * F.col("n"))
    top = _levels(F.col("_p"))
    d = d.withColumn("level", F.explode(F.when(top == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), top))))
    block = F.pow(F.lit(2.0), F.col("level")).cast("long")
    first_half = F.col("_t") % block < F.greatest(F.floor(block / 2), F.lit(1))
    g = d.groupBy(*keys, "n", "level", F.floor(F.col("_t") / block).cast("long").alias("i")).agg(
        F.sum(F.when(first_half, F.col(x))).alias("_a"), F.sum(F.when(~first_half, F.col(x))).alias("_b"))
    scale = F.sqrt(F.pow(F.lit(2.0), F.col("level")))
    return g.select(*keys, "level", "i", ((F.col("_a") + F.coalesce("_b", F.lit(0.0))) / scale).alias("smooth"),
                    F.when(F.col("level") > 0, (F.col("_a") - F.col("_b")) / scale).alias("detail"), "n")


#: Levels whose coefficients are joined to single points; those above reach blocks of 2^FINE points first.
FINE = 12


def haar_synthesis(coefficients: DataFrame, keys, t: str = "t", out: str = "value") -> DataFrame:
    """The series that :func:`haar_analysis` came from, cut back to its n
    points: (keys, t, out).

    A point is the signed sum of the details above it and the top smooth.
    Blocks of 2^FINE points get the part of the levels above FINE first, then
    every point the part of its own levels and its block's, so no key of a
    join meets more than 2^FINE points, or the blocks of one series.  Grids
    exploded from one row per series or block are estimated as that one row,
    so they meet the coefficients in merge joins, never in a broadcast."""
    keys = _keys(keys)
    c = coefficients.select(*keys, "level", "i", "smooth", "detail", "n")
    series = c.groupBy(*keys, "n").agg(F.max("level").alias("_top"), F.max_by("smooth", "level").alias("_smooth"))

    def part(grid: DataFrame, at: str, shift: int, low: Column, high: Column) -> DataFrame:
        """Sum of the details of levels low .. high above each ``at`` (a point's position shifted right)."""
        d = grid.where(low <= high).withColumn("level", F.explode(F.sequence(low, high)))
        place = F.col("level") - shift
        span = F.pow(F.lit(2.0), place).cast("long")
        d = d.withColumn("i", F.floor(F.col(at) / span).cast("long"))
        sign = F.when(F.col(at) % span < F.floor(span / 2), F.lit(1.0)).otherwise(F.lit(-1.0))
        j = d.join(c.select(*keys, "level", "i", "detail").hint("merge"), [*keys, "level", "i"])
        return j.groupBy(*keys, at).agg(F.sum(sign * F.col("detail") / F.sqrt(F.pow(F.lit(2.0), F.col("level")))).alias("_v"))

    blocks = series.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(2 ** FINE)).cast("long"))))
    coarse = part(blocks, "_b", FINE, F.lit(FINE + 1), F.col("_top"))
    blocks = (blocks.join(coarse, [*keys, "_b"], "left")
              .withColumn("_base", F.coalesce("_v", F.lit(0.0)) + F.col("_smooth") / F.sqrt(F.pow(F.lit(2.0), F.col("_top")))).drop("_v"))
    size = F.least(F.lit(2 ** FINE), F.col("n") - F.col("_b") * F.lit(2 ** FINE))
    points = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), size - 1))).withColumn(t, F.col("_b") * F.lit(2 ** FINE) + F.col("_o"))
    fine = part(points.select(*keys, t, "_top"), t, 0, F.lit(1), F.least(F.col("_top"), F.lit(FINE)))
    return points.join(fine.hint("merge"), [*keys, t], "left").select(*keys, t, (F.col("_base") + F.coalesce("_v", F.lit(0.0))).alias(out))
