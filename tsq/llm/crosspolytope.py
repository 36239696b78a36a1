"""Nearest neighbours by cross-polytope hashing.

A table of the index pseudo-rotates a unit vector (seeded signs and fast
Hadamard transforms, three times over) and takes the nearest signed axis, the
largest coordinate by magnitude with its sign, as the vector's bucket.  There
are TABLES such tables.  A query probes many buckets: of all signed axes of all
tables those with its largest coordinates, as a neighbour lies there with the
highest chance.  All rows found in a probed bucket are ranked by their exact
cosine in double precision.

How many buckets a query probes is fitted: on a bounded sample of rows
(SAMPLE_ROWS at most, the first by a hash) the true neighbours are found by
brute force, and the probes are the fewest that reach TARGET of them.  A
sample's neighbours lie farther off than those of the whole table, so the
number errs on the high side.  Every row is indexed.

The index is cut into chunks of bounded size (:func:`tsq.llm.vectors.against`),
each with the buckets of all tables; a query visits all chunks and takes its
first k from each.  No bucket has a cap.  Where a chunk's buckets hold fewer
than k rows, the whole chunk is ranked, so a query gets k rows whenever there
are as many.

Defined cases: rows without an id or a vector, with a null or non-finite
component, and zero vectors take no part; shorter vectors are continued with
zeros; rows that share the query's id are its own; a repeated row is a row of
its own, but equal queries count once; equal cosines go by id; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm import vectors as V
from tsq.llm.base import prepare, stored

QUERIES, NEAREST = 50, 5
TABLES = 32
#: Share of the sample's true neighbours that the probes reach.
TARGET = 0.98
#: Bounds of the sample that the number of probes is fitted on.
SAMPLE_ROWS, SAMPLE_QUERIES, SAMPLE_BYTES = 4096, 256, 16 << 20

_HASHED = "vec_id long, vector binary, codes binary, probes binary"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that keeps squares in range (a cosine's
    bits don't change)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def coordinates(unit: np.ndarray, table: int) -> np.ndarray:
    """Of unit vectors: the coordinate along each signed axis of a table (all
    positive axes, then all negative ones)."""
    wide = V.width(unit.shape[1])
    y = V.rotate(unit.astype(np.float32), V.signs(wide, 1200 + table))
    return np.concatenate([y, -y], axis=1)


def codes(unit: np.ndarray) -> np.ndarray:
    """Bucket of each vector in each table."""
    return np.stack([coordinates(unit, t).argmax(axis=1).astype(np.uint16) for t in range(TABLES)], axis=1)


def probes(unit: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` probes of each vector, as table x axes + signed axis."""
    z = np.concatenate([coordinates(unit, t) for t in range(TABLES)], axis=1)
    return np.argpartition(-z, min(most, z.shape[1]) - 1, axis=1)[:, :most].astype(np.int32)


def fitted_probes(x: np.ndarray, k: int) -> int:
    """Probes that reach TARGET of the k true neighbours within a sample."""
    least = TABLES
    if len(x) < 2:
        return least
    unit = _unit(x)
    asked = unit[:SAMPLE_QUERIES]
    cosine = asked @ unit.T
    cosine[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    code = codes(unit).astype(np.int64)
    axes = 2 * V.width(x.shape[1])
    need = []
    for i, q in enumerate(asked):
        z = np.concatenate([coordinates(q[None, :], t)[0] for t in range(TABLES)])
        rank = np.empty(len(z), np.int64)
        rank[np.argsort(-z, kind="stable")] = np.arange(len(z))
        need.append(rank[code[near[i]] + axes * np.arange(TABLES)].min(axis=1) + 1)
    return max(least, int(np.quantile(np.concatenate(need), TARGET, method="higher")))


class Chunk:
    """Vectors with the buckets of all tables as one sorted posting list."""

    def __init__(self, rows: pa.Table, dim: int):
        self.vec_id = np.asarray(rows.column("vec_id").combine_chunks())
        self.x = V.unpacked(rows.column("vector"), np.float64, dim)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        axes = 2 * V.width(dim)
        bucket = (V.unpacked(rows.column("codes"), np.uint16, TABLES).astype(np.int32) + axes * np.arange(TABLES, dtype=np.int32)).ravel()
        order = np.argsort(bucket, kind="stable")
        self.posting = order // TABLES
        self.start = np.searchsorted(bucket[order], np.arange(axes * TABLES + 1))

    def nearest(self, vec_id: int, q: np.ndarray, probe: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the first k of all rows in the probed buckets."""
        hit = np.zeros(len(self.x), bool)
        for b in probe:
            hit[self.posting[self.start[b]:self.start[b + 1]]] = True
        other = self.vec_id != vec_id
        rows = np.flatnonzero(hit & other)
        if len(rows) < k:
            rows = np.flatnonzero(other)
        norm = np.sqrt((q * q).sum())
        rough = (self.x[rows] @ q) / (self.norm[rows] * norm)
        if len(rows) > k:
            rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
        # summed in one order for all rows, so that equal vectors tie exactly
        score = (self.x[rows] * q).sum(axis=1) / (self.norm[rows] * norm)
        best = np.lexsort((self.vec_id[rows], -score))[:k]
        return rows[best], score[best]


def _valid(batch: pa.RecordBatch, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    x, ok = V.matrix(batch.column(1), dim)
    ok &= x.any(axis=1)
    return batch.filter(pa.array(ok)), scaled(x[ok]) if ok.any() else x[ok]


def _hashed(df: DataFrame, dim: int, most: int, every: int) -> DataFrame:
    """Rows that take part, with their buckets, and as queries with their probes."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(V.CHUNK_BYTES // (16 * V.width(dim)), 1)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch, x = _valid(whole.slice(i, step), dim)
                unit = _unit(x)
                asks = np.flatnonzero(np.asarray(batch.column(0)) % every == 0)
                probe = np.full(len(x), None, object)
                for j in range(0, len(asks), 256):
                    some = asks[j:j + 256]
                    probe[some] = [p.tobytes() for p in probes(unit[some], most)]
                yield pa.RecordBatch.from_arrays([batch.column(0), V.packed(x), V.packed(codes(unit)), pa.array(probe.tolist(), pa.binary())],
                                                 names=["vec_id", "vector", "codes", "probes"])

    return df.mapInArrow(make, _HASHED)


def _sample(df: DataFrame, dim: int) -> np.ndarray:
    rows = max(min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)), 2)
    some = df.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(rows).toArrow()
    if not some.num_rows:
        return np.zeros((0, dim))
    return _valid(some.combine_chunks().to_batches()[0], dim)[1]


def nearest_neighbours(rows: DataFrame, every: int = QUERIES, k: int = NEAREST) -> DataFrame:
    """The k rows of largest cosine found for each row whose id ``every``
    divides, of rows (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    prepare(spark)
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    n, dim = V.shape(d, "embedding")
    most = fitted_probes(_sample(d, dim), k)
    hashed = stored(_hashed(d, dim, most, every), "axis-codes").withColumn("key", F.lit(None).cast("long"))
    asked = hashed.where(F.col("probes").isNotNull()).select("vec_id", "vector", "probes").distinct()
    asked = stored(asked.withColumn("key", F.monotonically_increasing_id()).withColumn("codes", F.lit(None).cast("binary")), "queries")

    def search(chunk: Chunk, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        x = V.unpacked(queries.column("vector"), np.float64, dim)
        out = [[], [], [], []]
        for i, (key, vec_id, probe) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("key", "vec_id", "probes")))):
            found, score = chunk.nearest(vec_id, x[i], np.frombuffer(probe, np.int32), k)
            for part, v in zip(out, (np.full(len(found), key), np.full(len(found), vec_id), chunk.vec_id[found], score)):
                part.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], names=["key", "query_id", "vec_id", "score"])

    found = V.against(hashed.drop("probes").withColumn("probes", F.lit(None).cast("binary")), asked, V.chunks_for(d, n, dim),
                      lambda t: Chunk(t, dim), search, "key long, query_id long, vec_id long, score double")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
