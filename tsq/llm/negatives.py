"""Hard negatives: rotated one-bit codes, interval filter, integer scores.

A row's integer vector (floor of 256 times each component) less the mean of
all rows is rotated (seeded signs and Hadamard transforms) and kept as the sign
bit of each coordinate, with the alignment: the cosine between the vector and
its sign code.  What the code leaves over is rotated and coded again, LEVELS
times.  For an anchor q, level by level, with the unit code vector o, the
coded vector r and its alignment a:

    <r, q>  =  |r| a <o, q>  +  |r| sqrt(1 - a^2) <e, q>,    e a unit vector orthogonal to o
    |<e, q>|  <=  sqrt(|q|^2 - <o, q>^2)    (Cauchy-Schwarz)

<o, q> comes from popcounts: q's coordinates are cut to 8 bits, and the code is
and-ed with each of their bit planes; the error of that cut is bounded by its
sum over the coordinates and widens the interval.  The intervals hold for
certain, not with some probability.  Rows whose interval can't enter an
anchor's first k are dropped after each level, all others are scored in 64-bit
integers, so results are exact whatever the rotation and the mean.

Two passes over the coded rows, in chunks (:func:`tsq.llm.vectors.against`):
the first finds each anchor's positives among the rows of its label, the second
the negatives within the window of each positive's score.  A chunk hands on the
first k of each list; lists of one anchor meet in a group of at most k rows for
each chunk.

At scale anchors times rows are compared, as the anchors are a stated share of
the rows; one popcount step takes the place of 64 multiplications.

Defined cases: rows without an id, a label or a vector, or with a null or
non-finite component, take no part; neither do vectors whose integers have a
squared norm over 2^55, as a score could leave the range of a long; shorter
vectors are continued with zeros (an empty one scores 0 with all); the anchor's
other rows are those with another id; a repeated row is a row of its own, but
equal anchors count once, and rows that share an anchor's id with another
vector or label are anchors of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm import vectors as V
from tsq.llm.base import prepare, stored

SCALE = 256
ANCHORS, FLIPPED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: One-bit codes of a row, each of what the one before it leaves over.
LEVELS = 4
#: Bits of an anchor's coordinate.
PLANES = 8
#: Squared norm of integer vectors that take part.
LARGEST = 2.0 ** 55
#: Vector components scored at once.
CELLS = 1 << 20

_CODED = "vec_id long, label long, ints binary, codes binary, facts binary"


def _seed(level: int) -> int:
    return 1100 + level


def encode(ints: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, LEVELS x words of 64 bits) and facts of integer vectors:
    scale |r| a of each level, |r| sqrt(1 - a^2) after it."""
    n, dim = ints.shape
    wide = V.width(dim)
    rest = np.pad(ints - mean, ((0, 0), (0, wide - dim)))
    codes, facts = [], []
    for level in range(LEVELS):
        sign = V.signs(wide, _seed(level))
        rest = V.rotate(rest, sign)
        up = rest >= 0
        codes.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
        scale = np.abs(rest).sum(axis=1) / np.sqrt(wide)  # |r| a
        rest = rest - np.where(up, scale[:, None], -scale[:, None]) / np.sqrt(wide)
        facts += [scale, np.sqrt((rest * rest).sum(axis=1))]
    return np.concatenate(codes, axis=1), np.stack(facts, axis=1)


class Anchors:
    """Bit planes of a batch of anchors for each level, and what bounds their scores."""

    def __init__(self, ints: np.ndarray, mean: np.ndarray):
        self.ints = ints.astype(np.int64)
        q = ints.astype(np.float64)
        self.norm2 = (q * q).sum(axis=1)
        self.base = q @ mean
        self.slack = 1e-6 + 1e-9 * np.sqrt(self.norm2) * (1 + np.sqrt(float(mean @ mean)))
        wide = V.width(q.shape[1])
        self.levels = []
        for level in range(LEVELS):
            q = V.rotate(q, V.signs(wide, _seed(level)))
            low = q.min(axis=1)
            step = (q.max(axis=1) - low) / (2 ** PLANES - 1)
            unit = np.rint((q - low[:, None]) / np.where(step > 0, step, 1.0)[:, None]).astype(np.int64)
            lost = np.abs(q - (low[:, None] + step[:, None] * unit)).sum(axis=1) / np.sqrt(wide) + 1e-9 * np.sqrt(self.norm2)
            plane = [np.packbits((unit >> b) & 1 == 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)]
            self.levels.append((low, step, unit.sum(axis=1), lost, plane))

    def along(self, i: int, level: int, code: np.ndarray) -> tuple[np.ndarray, float]:
        """Estimates of <o, q> for the i-th anchor by popcounts, and their largest error."""
        low, step, total, lost, plane = self.levels[level]
        wide = 64 * code.shape[1]
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        common = np.zeros(len(code), np.int64)
        for b, p in enumerate(plane):
            common += np.bitwise_count(code & p[i]).sum(axis=1, dtype=np.int64) << b
        return (low[i] * (2 * ones - wide) + step[i] * (2 * common - total[i])) / np.sqrt(wide), lost[i]


class Chunk:
    """Coded rows in order of their labels."""

    def __init__(self, rows: pa.Table, dim: int):
        rows = rows.sort_by("label")
        wide = V.width(dim)
        self.label = np.asarray(rows.column("label").combine_chunks())
        self.vec_id = np.asarray(rows.column("vec_id").combine_chunks())
        self.ints = V.unpacked(rows.column("ints"), np.int32, dim)
        self.codes = V.unpacked(rows.column("codes"), np.uint64, LEVELS * wide // 64)
        self.facts = V.unpacked(rows.column("facts"), np.float64, 2 * LEVELS)

    def first(self, anchors: Anchors, i: int, rows: np.ndarray, windows: list[tuple[int, int]] | None, k: int):
        """For each window of scores (None: one without bounds) the i-th
        anchor's first k rows in it, by score and then id: (row, score) arrays."""
        bounds = [(-np.inf, np.inf)] if windows is None else windows
        centre = np.full(len(rows), anchors.base[i])
        blur = np.zeros(len(rows))
        words = self.codes.shape[1] // LEVELS
        for level in range(LEVELS):
            if len(rows) <= k:
                break
            s, lost = anchors.along(i, level, self.codes[rows, level * words:(level + 1) * words])
            scale, left = self.facts[rows, 2 * level], self.facts[rows, 2 * level + 1]
            centre = centre + scale * s
            blur = blur + scale * lost
            short = np.maximum(np.abs(s) - lost, 0.0)
            margin = left * np.sqrt(np.maximum(anchors.norm2[i] - short * short, 0.0)) + blur + anchors.slack[i] * (1 + left)
            low, high = centre - margin, centre + margin
            alive = np.zeros(len(rows), bool)
            for least, most in bounds:
                inside = low[(low >= least) & (high <= most)]
                bar = max(least, np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else least
                alive |= (high >= bar) & (low <= most)
            rows, centre, blur = rows[alive], centre[alive], blur[alive]
        score = np.empty(len(rows), np.int64)
        step = max(CELLS // self.ints.shape[1], 1)
        for j in range(0, len(rows), step):
            score[j:j + step] = self.ints[rows[j:j + step]].astype(np.int64) @ anchors.ints[i]
        out = []
        for least, most in bounds:
            there = np.flatnonzero((score >= least) & (score <= most))
            best = there[np.lexsort((self.vec_id[rows[there]], -score[there]))[:k]]
            out.append((rows[best], score[best]))
        return out


def _coded(df: DataFrame, dim: int, mean: np.ndarray | None) -> DataFrame:
    """Rows that take part, coded (without a mean: with their integers alone)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(V.CHUNK_BYTES // (8 * V.width(dim)), 1)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                x, ok = V.matrix(batch.column(2), dim)
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * x)
                    ok &= (x * x).sum(axis=1) <= LARGEST
                batch, ints = batch.filter(pa.array(ok)), x[ok].astype(np.int32)
                codes, facts = encode(ints, mean)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), V.packed(ints), V.packed(codes), V.packed(facts)],
                                                 names=["vec_id", "label", "ints", "codes", "facts"])

    return df.mapInArrow(make, _CODED)


def _mean(df: DataFrame, dim: int) -> np.ndarray:
    """Mean integer vector (as many numbers as dimensions reach the driver)."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            x, ok = V.matrix(batch.column(2), dim)
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * x[ok])
                x = x[(x * x).sum(axis=1) <= LARGEST]
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "total": total, "n": pa.array([n] * dim, pa.int64())})

    found = df.mapInArrow(sums, "at int, total double, n long").groupBy("at").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect()
    mean = np.zeros(dim)
    for r in found:
        mean[r["at"]] = r["t"] / r["n"] if r["n"] else 0.0
    return mean


_FOUND = "key long, which int, vec_id long, score long"


def _searcher(dim: int, mean: np.ndarray, of_label: bool, k: int):
    """Search of a chunk: the first k rows of the anchor's own label, or of
    all other labels for each of its windows."""
    def search(chunk: Chunk, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        everything = np.arange(len(chunk.label))
        asked = Anchors(V.unpacked(anchors.column("ints"), np.int32, dim), mean)
        out = [[], [], [], []]
        for i, (key, vec_id, label, scores) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("key", "vec_id", "label", "scores")))):
            a, b = np.searchsorted(chunk.label, label), np.searchsorted(chunk.label, label, side="right")
            rows = everything[a:b] if of_label else np.concatenate([everything[:a], everything[b:]])
            rows = rows[chunk.vec_id[rows] != vec_id]
            if not len(rows):
                continue
            windows = None if of_label else [(-((-LOW * p) // 100), HIGH * p // 100) for p in scores]
            for w, (best, score) in enumerate(chunk.first(asked, i, rows, windows, k)):
                for part, x in zip(out, (np.full(len(best), key), np.full(len(best), w), chunk.vec_id[best], score)):
                    part.append(x)
        if out[0]:
            key, which, ids, score = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(which.astype(np.int32)), pa.array(ids), pa.array(score)],
                                             names=["key", "which", "vec_id", "score"])

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "which").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """Hard negatives of rows (vec_id, embedding, label); anchors are the ids
    that ``anchors`` divides.  Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    prepare(spark)
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    flipped = F.when(vec_id % FLIPPED == 0, (label + 1) % LABELS).otherwise(label)
    d = rows.select(vec_id.alias("vec_id"), flipped.alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    n, dim = V.shape(d, "embedding")
    mean = _mean(d, dim)
    coded = stored(_coded(d, dim, mean), "sign-codes")
    chunks = V.chunks_for(d, n, dim)
    extra = {"key": F.lit(None).cast("long"), "scores": F.lit(None).cast("array<long>")}
    library = coded.withColumns(extra)

    chosen = coded.where(F.col("vec_id") % anchors == 0).select("vec_id", "label", "ints").distinct()
    chosen = stored(chosen.withColumn("key", F.monotonically_increasing_id()), "anchors")
    blank = {"codes": F.lit(None).cast("binary"), "facts": F.lit(None).cast("binary")}
    asked = chosen.withColumns(blank | {"scores": extra["scores"]})
    build = lambda t: Chunk(t, dim)
    positive = _best(V.against(library, asked, chunks, build, _searcher(dim, mean, True, POSITIVES), _FOUND), POSITIVES)
    positive = stored(positive.select("key", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # at most POSITIVES scores for each anchor
    scores = positive.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = chosen.join(scores, "key").withColumns(blank)
    negative = _best(V.against(library, asked, chunks, build, _searcher(dim, mean, False, NEGATIVES), _FOUND), NEGATIVES)
    negative = negative.select("key", (F.col("which") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (negative.join(positive, ["key", "nth"]).join(chosen.select("key", F.col("vec_id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
