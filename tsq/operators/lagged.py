"""Least squares on lagged values: fitted linear forecasts and the
Dickey-Fuller test with a lag search.

Both need sums of products of a row's neighbours.  Rows are cut into halo
blocks (so one long series is spread), a row gets its neighbours as a short
array, and every task sums the outer products of its rows as one matrix
product; only those sums are shuffled.  A model is then solved from a matrix
whose size depends on the number of lags, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators.index import _keys, block_window, core_rows, halo

DOUBLES = T.ArrayType(T.DoubleType())


def neighbours(df: DataFrame, keys, t: str, x: str, back: int, ahead: int, out: str = "near") -> DataFrame:
    """Rows that have ``back`` rows before and ``ahead`` rows after them in
    their series, none with a null value, with all of these as one array."""
    keys = _keys(keys)
    w = block_window(keys, t).rowsBetween(-back, ahead)
    d = halo(df, t, back=back, ahead=ahead).withColumn(out, F.collect_list(x).over(w))
    return core_rows(d.where(F.size(out) == back + ahead + 1))


def _row_of(names: list[str], table: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's key, and the keys."""
    keys = list(zip(*(table.column(c).to_pylist() for c in names))) if names else [()] * table.num_rows
    number: dict[tuple, int] = {}
    return np.array([number.setdefault(k, len(number)) for k in keys], np.int64), list(number)


def sums_of_products(df: DataFrame, keys, near: str, make) -> DataFrame:
    """(keys, products): for each key the upper triangle, row by row, of the
    summed outer products of ``make(matrix of near arrays, columns)``.

    ``make`` gets the arrays of one key's rows and the first of these rows as
    a dictionary of all columns of ``df``."""
    keys = _keys(keys)
    fields = [df.schema[k] for k in keys]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(batch.schema.get_field_index(near))
            number, found = _row_of(keys, batch)
            x = np.asarray(col.flatten()).reshape(batch.num_rows, -1)
            out = []
            for i in range(len(found)):
                rows = np.flatnonzero(number == i)
                v = make(x[rows], batch.slice(int(rows[0]), 1).to_pylist()[0])
                g = v.T @ v
                out.append(g[np.triu_indices(len(g))])
            cols = [pa.array([k[j] for k in found], batch.schema.field(c).type) for j, c in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g.tolist() for g in out], pa.list_(pa.float64()))], names=[*keys, "products"])

    part = df.mapInArrow(products, T.StructType([*fields, T.StructField("products", DOUBLES)]))
    each = part.select(*keys, F.posexplode("products").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    points = F.sort_array(F.collect_list(F.struct("at", "v")))
    return each.groupBy(*keys).agg(F.transform(points, lambda p: p["v"]).alias("products"))


def full_matrix(products: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle given row by row."""
    n = int(round((math.sqrt(8 * len(products) + 1) - 1) / 2))
    g = np.zeros((n, n))
    g[np.triu_indices(n)] = products
    return g + np.triu(g, 1).T


# ------------------------------------------------------- linear forecasts
def trend_matrix(seq_len: int, kernel: int) -> np.ndarray:
    """The centred moving average (ends repeated) of a look-back as a matrix."""
    side = (kernel - 1) // 2
    m = np.zeros((seq_len, seq_len))
    for i in range(seq_len):
        for j in range(i - side, i + side + 1):
            m[i, min(max(j, 0), seq_len - 1)] += 1 / (2 * side + 1)
    return m


def fit_linear(df: DataFrame, keys, t: str, x: str, seq_len: int, pred_len: int, by=None) -> DataFrame:
    """Least-squares maps from a look-back to each step of the horizon, over
    all windows of ``df``: (by, h, weights, bias).  One model for all series,
    or one for each value of the key columns ``by``.

    The normal equations are summed over the cluster and solved once for all
    steps.  Where they are singular (fewer windows than look-back points, a
    constant series) the solution of least norm is taken."""
    by = _keys(by) if by else []
    near = neighbours(df, keys, t, x, 0, seq_len + pred_len - 1)
    g = sums_of_products(near.select(*by, "near"), by, "near", lambda v, _: np.column_stack([v[:, :seq_len], np.ones(len(v)), v[:, seq_len:]]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("weights", DOUBLES), T.StructField("bias", T.DoubleType())])))
    def solve(products: pa.Array) -> pa.Array:
        out = []
        for p in products.to_pylist():
            m = full_matrix(np.array(p))
            a, b = m[:seq_len + 1, :seq_len + 1], m[:seq_len + 1, seq_len + 1:]
            try:
                c = np.linalg.solve(a, b) if np.linalg.cond(a) < 1e12 else np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
            except np.linalg.LinAlgError:
                c = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
            out.append([{"weights": w[:-1].tolist(), "bias": float(w[-1])} for w in c.T])
        return pa.array(out, pa.list_(pa.struct([("weights", pa.list_(pa.float64())), ("bias", pa.float64())])))

    models = g.select(*by, F.posexplode(solve("products")).alias("at", "m"))
    return models.select(*by, (F.col("at") + 1).alias("h"), "m.weights", "m.bias")


def initial_linear(spark, seq_len: int, pred_len: int) -> DataFrame:
    """The maps before any fit: every weight 1 / seq_len."""
    return spark.range(1, pred_len + 1).select(F.col("id").cast("int").alias("h"), F.array_repeat(F.lit(1.0 / seq_len), seq_len).alias("weights"),
                                               F.lit(0.0).alias("bias"))


def parts(weights: np.ndarray, kernel: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights on the seasonal and on the trend part of a look-back (its
    moving average and the rest) that make the map ``weights``.  Both parts
    are linear in the look-back, so many pairs do; this one has the least
    norm, as a least-squares fit on the two parts has."""
    m = trend_matrix(weights.shape[-1], kernel)
    both = np.linalg.pinv(np.concatenate([np.eye(len(m)) - m, m]).T) @ np.atleast_2d(weights).T
    return both[:len(m)].T, both[len(m):].T


def predict_linear(df: DataFrame, keys, t: str, x: str, models: DataFrame, seq_len: int, by=None) -> DataFrame:
    """(keys, window_id, h, y_pred) for the look-back that begins at each row
    (window_id is its position)."""
    keys, by = _keys(keys), _keys(by) if by else []
    near = neighbours(df, keys, t, x, 0, seq_len - 1)
    m = models.withColumnsRenamed({c: f"_m_{c}" for c in by})  # one row for each step (and value of ``by``)
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    j = near.crossJoin(F.broadcast(m)) if not by else near.join(m, cond)
    dot = F.aggregate(F.zip_with("near", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return j.select(*keys, F.col(t).cast("long").alias("window_id"), "h", (dot + F.col("bias")).alias("y_pred"))


# --------------------------------------------------------- Dickey-Fuller
def default_lags(n: Column) -> Column:
    """Most lags that the search tries for a series of n values: 12 (n/100)^(1/4),
    fewer for short series, so that the fit has rows left."""
    most = F.greatest(F.floor((n - 1) / 2) - 1, F.lit(0)) - 1
    return F.greatest(F.least(F.ceil(F.lit(12.0) * F.pow(n / F.lit(100.0), F.lit(0.25))), most), F.lit(0)).cast("int")


def _regressors(v: np.ndarray, lags: int) -> np.ndarray:
    """Rows of constant, last level, ``lags`` lagged differences, difference,
    from arrays that end with the row's own value."""
    d = np.diff(v, axis=1)
    return np.column_stack([np.ones(len(v)), v[:, -2], *(d[:, -1 - k] for k in range(1, lags + 1)), d[:, -1]])


def _factor(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper factor R with R'R = g, row by row, and whether a column depends
    on those before it (its row is zero then)."""
    n = len(g)
    r, lost = np.zeros((n, n)), np.zeros(n, bool)
    for i in range(n):
        rest = g[i, i] - r[:i, i] @ r[:i, i]
        if rest <= 1e-10 * g[i, i] or g[i, i] <= 0:
            lost[i] = True
            continue
        r[i, i] = math.sqrt(rest)
        r[i, i + 1:] = (g[i, i + 1:] - r[:i, i] @ r[:i, i + 1:]) / r[i, i]
    return r, lost


def lag_search(g: np.ndarray, rows: int, lags: int) -> int:
    """The number of lags with the least AIC.  ``g``: products of constant,
    level, lagged differences and difference, over the rows that have all
    lags.  One factor holds the squared errors of all nested models."""
    r, _ = _factor(g)
    gone = r[:-1, -1] ** 2  # what each column explains of the difference
    error = g[-1, -1] - np.cumsum(gone)[1:lags + 2]
    if rows <= 0 or (error <= 1e-12 * max(g[-1, -1], 1e-300)).any():
        return int(np.argmax(error <= 1e-12 * max(g[-1, -1], 1e-300))) if rows > 0 else 0
    return int(np.argmin(rows * np.log(error / rows) + 2 * np.arange(lags + 1)))


def df_statistic(g: np.ndarray, rows: int) -> float | None:
    """t statistic of the level's coefficient (None where it has none)."""
    r, lost = _factor(g[:, [0, *range(2, len(g) - 1), 1, len(g) - 1]][[0, *range(2, len(g) - 1), 1, len(g) - 1]])
    k = len(g) - 1  # regressors; the level is the last of them
    error = g[-1, -1] - (r[:-1, -1] ** 2).sum()
    free = rows - int((~lost[:-1]).sum())
    if lost[k - 1] or free <= 0 or error <= 1e-12 * max(g[-1, -1], 1e-300):
        return None
    # coefficient r[y]/r[l] over its standard error s / r[l]
    return float(r[k - 1, -1] / math.sqrt(error / free))


ADF = T.StructType([T.StructField("adf", T.DoubleType()), T.StructField("lag", T.IntegerType())])


def adf_searched(df: DataFrame, keys, t: str, x: str) -> DataFrame:
    """Augmented Dickey-Fuller test of each series (``t``: positions from 0)
    with a constant: (keys, n, adf, lag).

    All models of 0 to ``default_lags`` lags are compared by AIC on the rows
    that have every lag; the best is fitted anew on all rows that it can use.
    Rows beyond the first few enter through one matrix of summed products;
    the first rows of a series, which only the smaller models use, are kept.
    Null for series too short or without any change."""
    keys = _keys(keys)
    d = df.select(*keys, t, F.col(x).cast("double").alias("v"))
    facts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("v", t).alias("first"))
    facts = facts.withColumn("lags", default_lags(F.col("n")))
    most = facts.agg(F.max("lags")).first()[0] or 0
    j = d.join(facts, keys).withColumn("v", F.col("v") - F.col("first"))  # the test is the same for shifted values
    # the rows before a row that has all lags; a shorter array would be a row of the head
    w = block_window(keys, t).rowsBetween(-(most + 1), 0)
    near = core_rows(halo(j, t, back=most + 1).withColumn("near", F.collect_list("v").over(w)))
    near = near.where(F.col(t) >= F.col("lags") + 1)
    own = F.slice("near", -(F.col("lags") + 2), F.col("lags") + 2)
    near = near.select(*keys, "lags", F.concat(F.array_repeat(F.lit(0.0), F.lit(most) - F.col("lags")), own).alias("near"))
    g = sums_of_products(near, keys, "near", lambda v, row: _regressors(v[:, most - row["lags"]:], row["lags"]))
    head = (j.where(F.col(t) <= F.col("lags")).groupBy(*keys)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), "v"))), lambda p: p["v"]).alias("head")))

    @F.arrow_udf(ADF)
    def decide(n: pa.Array, lags: pa.Array, products: pa.Array, head: pa.Array) -> pa.Array:
        out = []
        for size, p, tri, first in zip(n.to_pylist(), lags.to_pylist(), products.to_pylist(), head.to_pylist()):
            if tri is None:
                out.append({"adf": None, "lag": None})
                continue
            g = full_matrix(np.array(tri))
            rows = size - p - 1
            k = lag_search(g, rows, p)
            use = [*range(k + 2), p + 2]
            g = g[np.ix_(use, use)]
            first = np.array(first)
            if len(first) > k + 1:  # rows that have k lags, but not all
                v = np.lib.stride_tricks.sliding_window_view(first, k + 2)
                more = _regressors(v, k)
                g, rows = g + more.T @ more, rows + len(v)
            stat = df_statistic(g, rows)
            out.append({"adf": stat, "lag": None if stat is None else k})
        return pa.array(out, pa.struct([("adf", pa.float64()), ("lag", pa.int32())]))

    cond = facts.join(g, keys, "left").join(head, keys, "left")
    return cond.select(*keys, "n", decide("n", "lags", "products", "head").alias("r")).select(*keys, "n", "r.adf", "r.lag")
