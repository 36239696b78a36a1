"""Packing along a space-filling curve (operator 8).

Every document's words are hashed to fixed random directions of a few
dimensions; the document's point is their normalised sum, scaled to a grid by
the normal distribution.  Documents are range-sorted by the Hilbert key of the
point, so neighbours in the file are alike, and are laid end to end into
sequences of 4,096 tokens along the curve.  The rest of each range is cut into
sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; a text without words
has the middle point; copies share the point and are spread by a hash of the
id, so that a large group of copies fills many ranges; rows with one id and
text are packed each; an empty table makes no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import give_back, partitions, plain, prepare, range_bounds, range_of, slices, stored
from tsq.llm.hashing import words
from tsq.llm.tokens import encode_documents

SEQUENCE = 4096
DIMENSIONS, BITS = 4, 10
#: Low bits of the sort key that a hash of the id fills.
SPREAD_BITS = 22

TOKENS_DDL = "doc_id long, key long, ids binary"
PIECES_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (n x d, integers of ``bits``
    bits): coordinates are changed to the curve's transposed form by undoing
    the rotations from the highest bit down, then Gray-decoded and interleaved."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    d = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(d):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    carry = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ carry) >> level & 1)
    return key


def document_points(arr: pa.Array) -> np.ndarray:
    """Grid points (n x DIMENSIONS) of texts."""
    h, _, _, count = words(arr)
    out = np.zeros((len(arr), DIMENSIONS))
    full = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[full]
    for k in range(DIMENSIONS):
        part = ((h >> np.uint64(16 * k)) & np.uint64(65535)).astype(np.float64) - 32767.5
        if len(full):
            out[full, k] = np.add.reduceat(part, begin) / np.sqrt(count[full]) / 18918.6
    # the normal distribution function by its logistic approximation
    return np.minimum((2**BITS / (1 + np.exp(-np.clip(1.702 * out, -30, 30)))).astype(np.int64), 2**BITS - 1)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        give_back("words")
        text = plain(batch.column(1))
        key = np.concatenate([hilbert_key(document_points(text[i:j]), BITS) for i, j in slices(text)] or [np.zeros(0, np.int64)])
        key = (key << SPREAD_BITS) | np.asarray(batch.column(2)).astype(np.int64)
        ids = pa.array([x.tobytes() for x in encode_documents(text)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), ids], names=["doc_id", "key", "ids"])


def _powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents sorted along the curve, whole ranges at a time, to pieces."""
    shard, seq, fill = None, 0, 0
    open_: list[tuple] = []  # pieces of the sequence that isn't full: doc_id, start, ids, doc_tokens
    out: list[tuple] = []

    def close(sizes: list[int]) -> None:
        nonlocal seq, open_, fill
        parts = iter(open_)
        doc, start, ids, whole = next(parts, (None, 0, (), 0))
        for size in sizes:
            at = 0
            while at < size:
                if not len(ids):
                    doc, start, ids, whole = next(parts)
                take = ids[:size - at]
                crc = zlib.crc32(take.astype("<u4").tobytes())
                out.append((doc, start, len(take), crc, whole, (shard << 40) + seq, at))
                start, ids, at = start + len(take), ids[len(take):], at + len(take)
            seq += 1
        open_, fill = [], 0

    def flushed():
        cols = list(zip(*out)) if out else [[]] * 7
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_PIECES)

    for batch in batches:
        shards, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for s, doc, raw in zip(shards, doc_ids, batch.column(2)):
            if s != shard:
                if open_:
                    close(_powers_of_two(fill))
                shard, seq = s, 0
            ids = np.frombuffer(raw.as_buffer(), np.uint16)
            start, whole = 0, len(ids)
            while start < whole:
                part = ids[start:start + SEQUENCE - fill]
                open_.append((doc, start, part, whole))
                start, fill = start + len(part), fill + len(part)
                if fill == SEQUENCE:
                    close([SEQUENCE])
        # the open sequence outlives the batch's buffers
        open_ = [(d, a, x.copy(), w) for d, a, x, w in open_]
        yield flushed()
    if open_:
        close(_powers_of_two(fill))
    yield flushed()


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents (doc_id, text): see the module's text.

    The encoded documents are written once to the shared folder; the range
    bounds come from all their keys."""
    spark = docs.sparkSession
    prepare(spark)
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("pack")), F.lit(1 << SPREAD_BITS))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = stored(d.select("doc_id", "text", spread.alias("spread")).mapInArrow(_encode, TOKENS_DDL), "packing-ids")
    n = partitions(spark)
    shard = range_of(range_bounds(coded, "key", n))
    return (coded.select(shard("key").alias("shard"), "doc_id", "ids", "key")
            .repartition(n, "shard")
            .sortWithinPartitions("shard", "key", "doc_id", "ids")
            .select("shard", "doc_id", "ids")
            .mapInArrow(_pack, PIECES_DDL))
