"""Token-id files with directly addressable codes (operator 5).

Ids are split into 8-bit chunks, lowest first.  Level l holds the l-th chunk
of every id that has one; a bitmap beside it tells which ids go on at the next
level, and a rank directory (ones before every 512th bit) turns a position at
one level into the position at the next.  Any id is read with one rank query
per level; no block is decoded.

The file is a Parquet table in the given folder (Spark's commit protocol, any
store that Spark writes): one row per segment of whole documents with the
columns ``shard, first, doc_ids, sizes, levels``.  Shards cover ascending
ranges of ``doc_id``; ``first`` is the number of ids of the shard before the
segment.

Defined cases: a null or empty text is the end id alone; null ids come last;
rows with one id are ordered by text; an empty table makes no segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsq.llm.base import partitions, plain, prepare, range_bounds, range_of
from tsq.llm.tokens import encode_documents

#: Ids of a segment at which the next document begins a new one.
SEGMENT_IDS = 1 << 20
RANK_BITS = 512

LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("sizes", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))])
SEGMENT_DDL = ("shard long, first long, doc_ids array<long>, sizes array<long>, "
               "levels array<struct<chunks:binary,more:binary,ranks:binary>>")
READ_DDL = "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def pack_ids(ids: np.ndarray) -> list[dict]:
    """The levels of an id array (values of up to 32 bits)."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        padded = np.zeros(-(-max(len(rest), 1) // RANK_BITS) * RANK_BITS, bool)
        padded[:len(rest)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(1)
        levels.append({"chunks": (rest & 255).astype(np.uint8).tobytes(),
                       "more": np.packbits(padded, bitorder="little").tobytes(),
                       "ranks": (np.cumsum(ones) - ones).astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> 8


def unpack_ids(levels: list[dict]) -> np.ndarray:
    """All ids of a segment, in order."""
    out = np.zeros(0, np.uint32)
    for level in reversed(levels):
        low = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), bitorder="little", count=len(low)).astype(bool)
        low[more] |= out << 8
        out = low
    return out


def id_at(levels: list[dict], i: int) -> int:
    """One id by its position, by rank queries alone."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["chunks"][i] << (8 * depth)
        bits = level["more"]
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        part = int.from_bytes(bits[start:(i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = int.from_bytes(level["ranks"][4 * block:4 * block + 4], "little") + part.bit_count()
    return value


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of whole shards to segments."""
    shard, first, ids, ends = None, 0, [], []

    def made():
        sizes = [len(x) for x in ids]
        row = {"shard": shard, "first": first, "doc_ids": ends, "sizes": sizes, "levels": pack_ids(np.concatenate(ids))}
        return sum(sizes), pa.RecordBatch.from_pylist([row], schema=SEGMENT)

    held = 0
    for batch in batches:
        shards, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for s, doc_id, one in zip(shards, doc_ids, encode_documents(plain(batch.column(2)))):
            if ids and (s != shard or held >= SEGMENT_IDS):
                n, out = made()
                yield out
                first, ids, ends, held = first + n, [], [], 0
            if s != shard:
                shard, first = s, 0
            ids.append(one.copy())
            ends.append(doc_id)
            held += len(one)
    if ids:
        yield made()[1]


def write_ids(docs: DataFrame, path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write the table of segments to ``path``."""
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shard = range_of(range_bounds(d, "doc_id", 2 * n))
    (d.select(shard("doc_id").alias("shard"), "doc_id", "text")
      .repartition(n, "shard")
      .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "text")
      .mapInArrow(_segments, SEGMENT_DDL)
      .write.parquet(path))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard, first, doc_ids, sizes, levels = (batch.column(c)[row].as_py() for c in range(5))
            ids = unpack_ids(levels).astype("<u4")
            stop = np.cumsum(sizes)
            start = stop - sizes
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(crc), pa.int64()), pa.array(doc_ids, pa.int64()),
                                              pa.array(start + first), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32.
    Only one row per shard is ordered in one place to get the shards' offsets."""
    prepare(spark)
    segments = spark.read.schema(SEGMENT_DDL).parquet(path)
    each = segments.select("shard", "first", "doc_ids", "sizes", "levels").mapInArrow(_documents, READ_DDL)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = (segments.groupBy("shard").agg(F.sum(size).alias("ids"))
              .select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before")))
    return (each.join(F.broadcast(shards), "shard")
            .select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32"))
