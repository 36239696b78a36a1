"""Anomaly scores of sliding windows, one for each window and step.

A window is an array of its values (halo blocks, no whole-series window); it
is rebuilt from itself (centred moving average) or from the leading principal
components of all training windows, and each step's squared error is its
energy.  A row of a series has a score in every window that it lies in, so the
score table has windows times steps rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.operators.index import _keys, block_window, core_rows, halo
from tsq.operators.lagged import DOUBLES, full_matrix, sums_of_products


def windows(df: DataFrame, keys, t: str, cols: dict[str, str], length: int) -> DataFrame:
    """(keys, window_id, arrays): the stride-1 windows of ``length`` rows of
    each series, named by their first position; ``cols`` gives each array's
    column.  Windows with a null in any of the columns are left out."""
    keys = _keys(keys)
    w = block_window(keys, t).rowsBetween(0, length - 1)
    d = halo(df.select(*keys, t, *set(cols.values())), t, ahead=length - 1)
    d = d.select(*keys, t, "_blk", "_halo", *[F.collect_list(c).over(w).alias(f"_w_{out}") for out, c in cols.items()])
    d = core_rows(d)
    for out in cols:
        d = d.where(F.size(f"_w_{out}") == length)
    return d.select(*keys, F.col(t).cast("long").alias("window_id"), *[F.col(f"_w_{out}").alias(out) for out in cols])


def smooth_energy(x: str, length: int, kernel: int) -> Column:
    """Squared errors of a window against its own centred moving average
    (odd ``kernel``, the ends repeated)."""
    side = (kernel - 1) // 2

    def rebuilt(i: Column) -> Column:
        at = [F.element_at(x, F.least(F.greatest(i + j, F.lit(0)), F.lit(length - 1)) + 1) for j in range(-side, side + 1)]
        total = at[0]
        for v in at[1:]:
            total = total + v
        return total / F.lit(float(kernel))

    return F.transform(x, lambda v, i: F.pow(v - rebuilt(i), F.lit(2.0)))


def fit_components(train: DataFrame, x: str, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean window and the ``k`` leading principal components (rows) of all
    training windows, from one distributed sum of products; only that sum
    (its size is the window's length squared) reaches the driver."""
    row = sums_of_products(train.select(x), [], x, lambda v, _: np.column_stack([np.ones(len(v)), v])).first()
    if row is None or not row["products"]:
        return None
    g = full_matrix(np.array(row["products"]))
    mean = g[0, 1:] / g[0, 0]
    value, vector = np.linalg.eigh(g[1:, 1:] / g[0, 0] - np.outer(mean, mean))
    return mean, vector[:, ::-1][:, :k].T


def component_energy(model: tuple[np.ndarray, np.ndarray], x: str) -> Column:
    """Squared errors of a window against its part along the components."""
    mean, axes = model

    @F.arrow_udf(DOUBLES)
    def energy(col: pa.Array) -> pa.Array:
        n, length = len(col), len(mean)
        v = np.asarray(col.flatten()).reshape(n, length) - mean
        rest = v - (v @ axes.T) @ axes
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), pa.array((rest * rest).ravel()))

    return energy(x)


def scores(scored: DataFrame, keys, energy: str, label: str) -> DataFrame:
    """(keys, window_id, step, label, energy) of windows with arrays of both."""
    zipped = F.arrays_zip(F.col(label).alias("label"), F.col(energy).alias("energy"))
    d = scored.select(*_keys(keys), "window_id", F.posexplode(zipped).alias("step", "p"))
    return d.select(*_keys(keys), "window_id", "step", "p.label", "p.energy")
