"""Vectors of a table as matrices inside Arrow tasks, seeded rotations, and a
query set held against all rows in chunks.

:func:`against` deals the rows evenly over chunks of bounded size, whatever
their ids, and sends every query once to every chunk; a task loads one chunk
and streams the queries past it.  Nothing passes through the driver, memory is
bounded by a chunk, and a lost executor repeats its own chunks.  Rows are
shuffled once, queries once per chunk (one query row for some ten thousand
rows that it is compared with).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import partitions, within

#: Bytes of a chunk's vectors as doubles.
CHUNK_BYTES = 8 << 20


def shape(df: DataFrame, vector: str) -> tuple[int, int]:
    """Rows, and the length of the longest vector."""
    rows, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    return rows, max(dim or 0, 1)


def chunks_for(df: DataFrame, rows: int, dim: int) -> int:
    """Chunks of at most CHUNK_BYTES, and one for each shuffle partition at least."""
    most = max(CHUNK_BYTES // (8 * dim), 1)
    return max(-(-rows // most), partitions(df.sparkSession))


def matrix(col, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Double matrix of a list column, shorter vectors continued with zeros;
    and whether a row has a vector without null or non-finite components."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    ok = ~np.asarray(pc.is_null(col))
    size = np.asarray(pc.list_value_length(col).fill_null(0)).astype(np.int64)
    x = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    good = np.isfinite(x)
    if not good.all():
        ok[np.repeat(np.arange(n), size)[~good]] = False
        x = np.where(good, x, 0.0)
    if (size == dim).all():
        return x.reshape(n, dim).copy(), ok
    out = np.zeros((n, dim))
    out[np.repeat(np.arange(n), size), within(size)] = x
    return out, ok


def width(dim: int) -> int:
    """The power of two, 64 or more, that holds ``dim``."""
    return max(64, 1 << (dim - 1).bit_length())


def _order(n: int) -> np.ndarray:
    """The orthonormal Hadamard matrix of a power of two."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]]) / np.sqrt(2.0)
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row (a power of two
    long), 64 points a step."""
    n, d = x.shape
    h = 1
    while h < d:
        r = min(64, d // h)
        step = _order(r).astype(x.dtype)
        x = x.reshape(-1, r) @ step if h == 1 else np.matmul(step, x.reshape(-1, r, h))
        h *= r
    return x.reshape(n, d)


def signs(dim: int, seed: int, rounds: int = 3) -> np.ndarray:
    """The random signs of one pseudo-rotation."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(rounds, dim))


def rotate(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Pseudo-rotation: signs and a Hadamard transform, a few times over."""
    if x.shape[1] < sign.shape[1]:
        x = np.pad(x, ((0, 0), (0, sign.shape[1] - x.shape[1])))
    for s in sign:
        x = hadamard(x * s.astype(x.dtype))
    return x


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    off = np.arange(len(x) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x)])


def unpacked(col, dtype, dim: int) -> np.ndarray:
    """The matrix that :func:`packed` made."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros((0, dim), dtype)
    off = np.frombuffer(off, np.int32, count=len(col) + 1, offset=4 * col.offset)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(dtype).reshape(len(col), dim)


def against(rows: DataFrame, queries: DataFrame, chunks: int, build: Callable, search: Callable, ddl: str) -> DataFrame:
    """``search(build(rows of a chunk), queries)`` for every chunk and all
    queries, in batches.  Both tables have the same columns; ``build`` takes a
    pyarrow table, ``search`` what it returned and a table of queries, and
    yields record batches."""
    deal: Column = F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    both = (rows.select(deal.alias("chunk"), F.lit(0).alias("side"), *rows.columns)
            .unionByName(queries.select(every.alias("chunk"), F.lit(1).alias("side"), *rows.columns)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = [], None
        for batch in batches:
            side = np.asarray(batch.column(1))
            turn = int(np.searchsorted(side, 1))
            if turn:
                held.append(batch.slice(0, turn))
            if turn < len(side):
                if held:
                    index, held = build(pa.Table.from_batches(held)), []
                if index is not None:
                    yield from search(index, pa.Table.from_batches([batch.slice(turn)]))

    return both.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("side").mapInArrow(walk, ddl)
