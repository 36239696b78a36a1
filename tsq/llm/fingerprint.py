"""Homomorphic multiset fingerprints of documents (operator 1).

A document is the multiset of its paragraphs (lines).  Each paragraph is
hashed to a wide vector, and a document's state is the sum of its paragraphs'
vectors, so the order of paragraphs does not matter, and adding or removing a
paragraph adds or subtracts its vector (:func:`add`, :func:`remove`).  A vector
has two parts:

* ``LANES`` lanes of an extendable hash of the paragraph's bytes, modulo 2**16:
  equal sums mean equal multisets (lattice hash);
* ``SKETCH`` lanes of +1 and -1 at places hashed from the paragraph's shingles
  of five words, modulo 2**32 (two 16-bit numbers each): the cosine of two such
  sums estimates the share of shingles that two documents have in common,
  copies counted (count sketch; standard error about 1 / sqrt(SKETCH)).  A text
  has less than 2**31 bytes, so no lane of a document wraps.

The fingerprint string is a digest of all lanes modulo 2**16.

Defined cases: a null text is the empty text, which has no paragraph and the
zero state; empty lines are paragraphs; likeness is 1 for equal states, else 0
if either has no words; rows with one id are ordered by text; null ids come
last; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import lines, partitions, plain, prepare, range_bounds, range_of, slices
from tsq.llm.hashing import shingles, words

LANES, SKETCH = 1024, 1024
EDIT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, n_paragraphs long")


def sketch(state: np.ndarray) -> np.ndarray:
    """View of the sketch lanes of one or more states (uint32)."""
    return state[..., LANES:].view(np.uint32)


def merge(state: np.ndarray, other: np.ndarray, sign: int = 1) -> np.ndarray:
    """``state`` with ``other`` added to it (or taken from it), in place."""
    change = np.add if sign > 0 else np.subtract
    change(state[..., :LANES], other[..., :LANES], out=state[..., :LANES])
    change(sketch(state), sketch(other), out=sketch(state))
    return state


def paragraph_vectors(parts: pa.Array, owner: np.ndarray, sign: np.ndarray, n: int) -> np.ndarray:
    """Signed sums of the vectors of paragraphs by owner (n x LANES + 2 SKETCH, uint16)."""
    out = np.zeros((n, LANES + 2 * SKETCH), np.uint16)
    counts = sketch(out)
    for i, j in slices(parts, 1 << 19):
        own, sg = owner[i:j], sign[i:j]
        for k in range(i, j, 2048):  # bounds the digests held at once
            raw = b"".join(hashlib.shake_128(p.as_buffer()).digest(2 * LANES) for p in parts[k:min(k + 2048, j)])
            rows = np.frombuffer(raw, "<u2").reshape(-1, LANES)
            at = owner[k:k + len(rows)]
            rows = np.where(sign[k:k + len(rows), None] < 0, np.negative(rows), rows)
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[cut], :LANES] += np.add.reduceat(rows, cut, axis=0, dtype=np.uint16)
        word, _, _, count = words(parts[i:j])
        h, made = shingles(word, count)
        if len(h):
            place = (h & np.uint64(SKETCH - 1)).astype(np.int64)
            weight = np.where(h >> np.uint64(63), 1, -1) * np.repeat(sg, made)
            own = np.repeat(own, made)
            low, high = own[0], own[-1] + 1
            sums = np.bincount((own - low) * SKETCH + place, weights=weight, minlength=(high - low) * SKETCH)
            counts[low:high] += sums.reshape(-1, SKETCH).astype(np.int64).astype(np.uint32)
    return out


def states(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """States of whole texts, and their numbers of paragraphs."""
    parts, count = lines(texts)
    return paragraph_vectors(parts, np.repeat(np.arange(len(texts)), count), np.ones(len(parts), np.int64), len(texts)), count


def add(state: np.ndarray, paragraph: str) -> np.ndarray:
    """The state with one more paragraph."""
    return merge(state.copy(), paragraph_vectors(pa.array([paragraph]), np.zeros(1, int), np.ones(1, int), 1)[0])


def remove(state: np.ndarray, paragraph: str) -> np.ndarray:
    """The state without one of its paragraphs."""
    return merge(state.copy(), paragraph_vectors(pa.array([paragraph]), np.zeros(1, int), np.ones(1, int), 1)[0], -1)


def digest(state: np.ndarray) -> str:
    lanes = np.concatenate([state[:LANES], sketch(state).astype(np.uint16)])
    return hashlib.blake2b(lanes.astype("<u2").tobytes(), digest_size=32).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise likeness (0 to 1) of two arrays of states."""
    x, y = (sketch(s).view(np.int32).astype(np.float64) for s in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0, 1))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column(1))
        for i, j in slices(texts, 1 << 20):
            s, n = states(texts[i:j])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([digest(x) for x in s], pa.string()), pa.array(n, pa.int64()),
                 pa.array([x.astype("<u2").tobytes() for x in s], pa.binary())],
                names=["doc_id", "fingerprint", "n_paragraphs", "state"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_paragraphs and the state itself of every text (no shuffle)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fingerprint string, n_paragraphs long, state binary")


def _edited(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all documents but the last, whose text only serves the one before it."""
    n = len(texts) - 1
    base = pa.array(texts, pa.string())
    parts, count = lines(base)
    own = np.repeat(np.arange(n + 1), count)
    total = paragraph_vectors(parts, own, np.ones(len(parts), np.int64), n + 1)
    # the edit takes away the paragraphs from the cut on, and adds what stands there then
    gone, gone_own, come, come_own, sha = [], [], [], [], []
    for d in range(n):
        text, k = texts[d], len(texts[d]) // 3
        cut = len(text) - k
        tail = texts[d + 1][:k]
        sha.append(hashlib.sha256((text[:cut] + tail).encode()).hexdigest())
        if not k:
            continue
        line = text.rfind("\n", 0, cut) + 1
        old, new = text[line:].split("\n"), (text[line:cut] + tail).split("\n")
        gone += old
        gone_own += [d] * len(old)
        come += new
        come_own += [d] * len(new)
    edit = total[:n].copy()
    for some, whose, sign in ((gone, gone_own, -1), (come, come_own, 1)):
        if some:
            merge(edit, paragraph_vectors(pa.array(some, pa.string()), np.array(whose), np.full(len(some), sign), n))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha, pa.string()),
         pa.array([digest(x) for x in total[:n]], pa.string()), pa.array([digest(x) for x in edit], pa.string()),
         pa.array(likeness(total[:n], edit)), pa.array(likeness(total[:n], total[1:])), pa.array(count[:n], pa.int64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents in order, each followed by the first document of
    the next block (``ahead``), to rows of the comparison."""
    block, closed, ids, texts, held = None, False, [], [], 0
    for batch in batches:
        for b, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if b != block:
                if len(texts) > 1:
                    yield _edited(ids, texts)
                block, closed, ids, texts, held = b, False, [], [], 0
            if closed:
                continue  # other candidates for the document ahead
            ids.append(doc_id)
            texts.append(text or "")
            held += len(texts[-1])
            closed = bool(ahead)
            if held > 1 << 20 and len(texts) > 1:
                yield _edited(ids, texts)
                ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _edited(ids, texts)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document (doc_id, text) against the next one in descending order
    of doc_id and against its own edited text.

    The texts are shuffled once, into ranges of doc_id; a range's first
    document goes to the range before it as well."""
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    which = range_of(range_bounds(d, "doc_id", 2 * n))
    # at most two rows per partition reach the driver: the last id (first in
    # descending order) of each range that has documents
    tops = [(r["b"], r["t"]) for r in d.select(which("doc_id").alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("t")).collect()]
    order = sorted((b for b, t in tops if t is not None), reverse=True) + [b for b, t in tops if t is None]
    before = dict(zip(order, [order[-1], *order[:-1]])) if order else {}
    first_of = {t: before[b] for b, t in tops}

    @F.arrow_udf("array<struct<block:long,ahead:int>>")
    def places(block: pa.Array, doc_id: pa.Array) -> pa.Array:
        out = []
        for b, i in zip(block.to_pylist(), doc_id.to_pylist()):
            own = [{"block": b, "ahead": 0}]
            out.append(own + [{"block": first_of[i], "ahead": 1}] if i in first_of else own)
        return pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("ahead", pa.int32())])))

    placed = (d.withColumn("b", which("doc_id")).withColumn("at", F.explode(places("b", "doc_id")))
              .select(F.col("at.block").alias("block"), F.col("at.ahead").alias("ahead"), "doc_id", "text"))
    return (placed.repartition(n, "block")
            .sortWithinPartitions("block", "ahead", F.col("doc_id").desc_nulls_last(), "text")
            .mapInArrow(_walk, EDIT_DDL))
