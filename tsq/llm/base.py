"""Shared pieces: Arrow text buffers, bounded slices, key ranges, stored tables.

Rules common to all operators of this package:

* a null text is the empty text, a null id is a value of its own that sorts last;
* operators read only the columns they name, by position in a ``select`` made
  first, so extra columns with clashing names do no harm;
* tables read more than once, or that cut lineage, are written to the shared
  ``spark.checkpoint.dir`` (:func:`stored`).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsq.session import materialize, ship_package

# Workers share their executor's memory: large freed buffers (8 MB or more) go
# back to the system at once, instead of staying with Arrow's or libc's allocator.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    _libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    _libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD

#: Text bytes that a vectorised step takes at once (a longer text goes alone).
SLICE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage)."""
    return materialize(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2)


def plain(arr) -> pa.Array:
    """One string array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type != pa.string():
        arr = arr.cast(pa.string())
    return arr.fill_null("") if arr.null_count else arr


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 byte offsets of a string array, without a copy."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int32, count=n + 1, offset=4 * arr.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` text bytes each, one row at least."""
    _, off = flat(arr)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lines(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of all texts in order, and the number of lines of each text.
    The empty text has no line."""
    parts = pc.split_pattern(arr, "\n")
    count = np.diff(np.asarray(parts.offsets)).astype(np.int64)
    values = parts.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(arr), 0))
    if empty.any():
        keep = np.ones(len(values), bool)
        keep[(np.cumsum(count) - count)[empty]] = False
        values = values.filter(pa.array(keep))
        count = np.where(empty, 0, count)
    return values, count


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each of the groups of the given sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of a long column by
    approximate quantiles (one distributed aggregate; as many numbers as
    partitions reach the driver)."""
    at = [(i + 1) / parts for i in range(parts - 1)]
    row = df.agg(F.percentile_approx(F.col(key), at, 100 * parts).alias("b")).first()
    return sorted(set(row["b"] or [])) if row else []


def range_of(bounds: list[int]):
    """UDF: number of cut points below a key (nulls: one past the last range)."""
    cuts = np.array(bounds, np.int64)

    @F.arrow_udf("long")
    def which(keys: pa.Array) -> pa.Array:
        null = np.asarray(pc.is_null(keys))
        at = np.searchsorted(cuts, np.asarray(keys.fill_null(0)).astype(np.int64), side="left")
        return pa.array(np.where(null, len(cuts) + 1, at), pa.int64())

    return which


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``mod`` (a null id: of '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def first_by_hash(df: DataFrame, group: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct rows of each value of ``group`` (few values),
    the first by a hash of the whole row: the same ones on every retry,
    whatever repeats.

    Only hashes are shuffled and written; of these, those up to a cut that
    holds some more than ``rows`` are ranked, and the rows that stay are found
    by a broadcast of at most ``rows`` hashes for each value."""
    d = df.withColumn("_hash", F.xxhash64(*df.columns))
    hashes = stored(d.select(group, "_hash").distinct(), "hashes")
    share = hashes.groupBy(group).agg((F.lit(rows + 10 * rows**0.5 + 50) / F.count(F.lit(1))).alias("_share"))
    at = (F.col("_hash").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    order = Window.partitionBy(group).orderBy("_hash")
    some = (hashes.join(F.broadcast(share), group).where(at <= F.col("_share"))
            .withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= rows).select(group, "_hash"))
    return d.join(F.broadcast(some), [group, "_hash"], "left_semi").dropDuplicates([group, "_hash"]).drop("_hash")


#: What operators keep in a worker between tasks: how to free it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, free: Callable[[], None]) -> None:
    """State the name of something that this worker keeps between tasks."""
    _KEPT[name] = free


def give_back(*still: str) -> None:
    """Free all that this worker has kept for others than the ``still`` named,
    and return freed memory to the system: workers share their executor's."""
    for name in [n for n in _KEPT if n not in still]:
        _KEPT.pop(name)()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
