"""Multinomial logistic regression over padded, masked samples.

Samples are arrays of any length; they are padded to the longest one, every
position is standardised with the training samples that reach it, and padded
positions are 0 (no evidence).  Each step sums the gradient over the cluster
and solves with a fixed bound of the curvature (half the features' second
moments, the same for all classes), so the likelihood rises with every step
and no step size is searched; what reaches the driver are classes x (length +
1) numbers a step, and once the moments, (length + 1) squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators.lagged import full_matrix

EPS = 1e-12


@dataclass
class Logistic:
    classes: list
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # classes x (positions + 1), the last column is the constant

    def features(self, col: pa.Array) -> np.ndarray:
        """Standardised, padded rows with a 1 at the end; null and padded points are 0."""
        n, size = len(col), np.asarray(pc.list_value_length(col).fill_null(0)).astype(np.int64)
        out = np.zeros((n, len(self.mean) + 1))
        row = np.repeat(np.arange(n), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        v = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
        use = (at < len(self.mean)) & np.isfinite(v)
        row, at, v = row[use], at[use], v[use]
        out[row, at] = (v - self.mean[at]) / self.scale[at]
        out[:, -1] = 1.0
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight.T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _summed(df: DataFrame, x: str, label: str, make) -> np.ndarray | None:
    """Sum over all rows of ``make(list column, labels)``, a flat array per batch."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = make(batch.column(0), batch.column(1).to_pylist())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    rows = df.select(x, label).mapInArrow(parts, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["at"])]) if rows else None


def fit_logistic(train: DataFrame, x: str = "x", label: str = "label", l2: float = 1.0, steps: int = 60, tol: float = 1e-5) -> Logistic | None:
    """The model of all training rows (null labels left out), with ``l2`` / 2
    times the squared weights (not the constants') as penalty."""
    train = train.where(F.col(label).isNotNull())
    points = train.select(F.posexplode(x).alias("at", "v")).where(~F.isnan("v"))
    stats = {r["at"]: r for r in points.groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    classes = [r[label] for r in train.select(label).distinct().orderBy(label).collect()]
    if not stats or not classes:
        return None
    size = max(stats) + 1
    mean = np.array([stats[i]["m"] if i in stats else 0.0 for i in range(size)])
    scale = np.array([stats[i]["s"] if i in stats and stats[i]["s"] > EPS else 1.0 for i in range(size)])
    model = Logistic(classes, mean, scale, np.zeros((len(classes), size + 1)))
    number = {c: i for i, c in enumerate(classes)}
    upper = np.triu_indices(size + 1)

    def moments(col: pa.Array, _) -> np.ndarray:
        f = model.features(col)
        return (f.T @ f)[upper]

    def gradient(col: pa.Array, labels: list) -> np.ndarray:
        f = model.features(col)
        p = -model.probabilities(f)
        p[np.arange(len(f)), [number[c] for c in labels]] += 1.0
        return (p.T @ f).ravel()

    penalty = np.append(np.full(size, l2), EPS)
    bound = np.linalg.inv(0.5 * full_matrix(_summed(train, x, label, moments)) + np.diag(penalty))
    for _ in range(steps):
        g = _summed(train, x, label, gradient).reshape(model.weight.shape) - penalty * model.weight
        move = g @ bound
        model.weight = model.weight + move
        if np.abs(move).max() < tol:
            break
    return model


def predict(df: DataFrame, model: Logistic, x: str = "x", out: str = "pred_class") -> DataFrame:
    """``df`` with the most probable class (the smaller of equals) and its probability."""
    kind = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("prob", T.DoubleType())])

    @F.arrow_udf(kind)
    def best(col: pa.Array) -> pa.Array:
        p = model.probabilities(model.features(col))
        at = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(p[np.arange(len(p)), at])], names=["at", "prob"])

    names = F.array(*[F.lit(c) for c in model.classes])
    return df.withColumn("_p", best(x)).withColumns({out: F.get(names, F.col("_p.at")), "prob": F.col("_p.prob")}).drop("_p")
