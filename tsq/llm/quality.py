"""Document quality by a linear-chain conditional random field (operator 4).

Every line of a text is good or bad.  A line's score comes from features of
the line, of its neighbours and of how often the text repeats it; a 2 x 2
matrix scores neighbouring labels.  Forward-backward gives each line's
probability of being good; their average weighted by length is the
document's raw quality, and a monotone map fitted on the training documents
(Platt's) turns it into the score.

The field is fitted by gradient ascent on the likelihood of the labels of at
most ``TRAIN_DOCS`` labelled documents (a line has its document's label), all
different in id or text, half of each kind, the first by a hash, of at most
``TRAIN_LINES`` lines together: a document that would go beyond is left out
whole.  Their features alone reach the driver (a line has ``N_FEATURES``
numbers).  Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text is one empty line; a document labelled
good and bad stands for both, with a null label for none; an id that stands
several times counts once for each of its texts; without labels of both kinds
the field is neutral and scores everything 0.5; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import first_by_hash, flat, fold_of, give_back, lines, plain, prepare, slices, stored, within
from tsq.llm.hashing import words

#: Labelled documents, and their lines, that the fit takes at most.
TRAIN_DOCS, TRAIN_LINES = 3000, 300_000
#: Score from which a document is predicted to be of good quality.
GOOD = 0.7

_CLASS = np.full(256, 4, np.uint8)  # other punctuation and symbols
_CLASS[[*range(97, 123), *range(128, 256)]] = 0  # letters; bytes of non-ASCII characters
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[32, 9, 13]] = 3
_CLASS[[*b".,;:?'\"-()"]] = 5
_END = np.zeros(256, bool)
_END[[*b".!?\"'):;"]] = True

N_OWN = 13
N_FEATURES = 3 * N_OWN + 3


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, then those of the line before and after),
    bytes of each line, and number of lines of each text."""
    parts, count = lines(text)
    if (count == 0).any():  # an empty text is one empty line
        at = np.repeat(np.arange(len(text)), np.maximum(count, 1))
        keep = np.repeat(count > 0, np.maximum(count, 1))
        pick = np.cumsum(keep) - 1
        parts = parts.take(pa.array(np.where(keep, pick, 0), mask=~keep)).fill_null("") if len(parts) else pa.array([""] * len(at))
        count = np.maximum(count, 1)
    data, off = flat(parts)
    size = np.diff(off)
    n = len(parts)
    full = np.flatnonzero(size)
    share = np.zeros((n, 6))
    if len(full):
        kind = _CLASS[data]
        for c in range(6):
            share[full, c] = np.add.reduceat(kind == c, off[full], dtype=np.int64)
    share /= np.maximum(size, 1)[:, None]
    ends = np.zeros(n)
    ends[full] = _END[data[off[full] + size[full] - 1]]
    h, start, end, many = words(parts)
    line = np.repeat(np.arange(n), many)
    # words that the line has already had, and words equal to the one before
    order = np.lexsort((h, line))
    same = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    again = np.bincount(line[order[1:]][same], minlength=n) / np.maximum(many, 1)
    run = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    runs = np.bincount(line[1:][run], minlength=n) / np.maximum(many, 1)
    letters = np.bincount(line, weights=end - start, minlength=n) / np.maximum(many, 1)
    # lines that the text has more than once
    key = np.zeros(n, np.uint64)
    w = np.flatnonzero(many)
    if len(w):
        key[w] = np.add.reduceat(h, (np.cumsum(many) - many)[w])
    doc = np.repeat(np.arange(len(text)), count)
    order = np.lexsort((key, doc))
    twin = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (many[order[1:]] > 0)
    repeated = np.zeros(n)
    repeated[order[1:][twin]] = 1
    repeated[order[:-1][twin]] = 1
    own = np.column_stack([share, ends, again, runs, np.minimum(letters, 20) / 10, repeated,
                           np.log1p(size) / 5, size == 0])
    inner = within(count)
    first, last = inner == 0, np.append(inner[1:] == 0, True)
    before = np.where(first[:, None], 0, np.roll(own, 1, 0))
    after = np.where(last[:, None], 0, np.roll(own, -1, 0))
    return np.column_stack([own, before, after, first, last, np.ones(n)]), size, count


@dataclass
class Field:
    """weight: features to the score of good against bad; pair: scores of
    (label, next label); mean, scale: of the features; a, b: of the map to the score."""

    weight: np.ndarray
    pair: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    a: float = 1.0
    b: float = 0.0

    @classmethod
    def neutral(cls) -> "Field":
        return cls(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0, 0.0)

    def lines(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * _logit(raw) + self.b, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sweep(local: np.ndarray, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Forward messages of all chains at once (n x 2, each row normalised):
    the k-th lines of all texts that have one are one step; the last few long
    texts go on one by one."""
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    sizes, at = count[order], begin[order]
    out = np.empty_like(local)
    m, k = local[at], 0
    live = int(np.searchsorted(-sizes, 0, side="left"))
    while live > 6:
        f = local[at[:live] + k]
        m = f if k == 0 else f * (m[:live] @ pair)
        m = m / m.sum(1, keepdims=True)
        out[at[:live] + k] = m
        k += 1
        live = int(np.searchsorted(-sizes, -k, side="left"))
    (aa, ab), (ba, bb) = pair.tolist()
    for c in range(live):
        rows = slice(int(at[c]) + k, int(at[c] + sizes[c]))
        x, y = m[c].tolist() if k else (0.0, 0.0)
        done = []
        for i, (f, g) in enumerate(local[rows].tolist(), k):
            x, y = (f, g) if i == 0 else (f * (x * aa + y * ba), g * (x * ab + y * bb))
            t = x + y
            x, y = x / t, y / t
            done.append((x, y))
        out[rows] = done
    return out


def marginals(score: np.ndarray, pair: np.ndarray, count: np.ndarray):
    """Each line's probability of being good, and of each pair of labels with
    the next line of its text (n x 2 x 2; nothing for last lines)."""
    local = np.exp(np.clip(np.column_stack([-score / 2, score / 2]), -30, 30))
    p = np.exp(pair)
    ahead = _sweep(local, p, count)
    # the same sweep over reversed lines gives the messages from behind
    back = _sweep(local[::-1], p.T, count[::-1])[::-1]
    rest = back / local  # without the line's own score
    node = ahead * rest
    node /= node.sum(1, keepdims=True)
    inner = within(count)
    here = np.flatnonzero(np.append(inner[1:] > 0, False)) if len(inner) else np.zeros(0, int)
    edge = np.zeros((len(score), 2, 2))
    if len(here):
        e = ahead[here][:, :, None] * p[None] * back[here + 1][:, None, :]
        edge[here] = e / e.sum((1, 2), keepdims=True)
    return node[:, 1], edge


def documents_quality(good: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Average of the lines' marginals by length (an empty line counts as one byte)."""
    w = size + 1.0
    begin = np.cumsum(count) - count
    return np.add.reduceat(good * w, begin) / np.add.reduceat(w, begin) if len(count) else np.zeros(0)


def fit(x: np.ndarray, size: np.ndarray, count: np.ndarray, label: np.ndarray, steps: int = 120,
        share_good: float | None = None) -> Field:
    """Maximum likelihood with a small ridge, by Adam over all lines at once.
    Every document weighs the same; the map to the score is fitted as if
    ``share_good`` of the documents were good."""
    if len(np.unique(label)) < 2:
        return Field.neutral()
    f = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), x.mean(0), x.std(0) + 1e-3)
    f.mean[-1], f.scale[-1] = 0, 1
    z = (x - f.mean) / f.scale
    y = np.repeat(label, count).astype(float)
    share = np.repeat(1 / np.maximum(count, 1), count) / len(count)
    same = np.zeros((len(y), 2, 2))
    inner = within(count)
    here = np.flatnonzero(np.append(inner[1:] > 0, False))
    same[here, y[here].astype(int), y[here + 1].astype(int)] = 1
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        good, edge = marginals(z @ theta[:-4], theta[-4:].reshape(2, 2), count)
        grad = np.append(z.T @ (share * (y - good)), (share[:, None, None] * (same - edge)).sum(0).ravel()) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    f.weight, f.pair = theta[:-4], theta[-4:].reshape(2, 2)
    good, _ = marginals(z @ f.weight, f.pair, count)
    raw = _logit(documents_quality(good, size, count))
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    good_docs = label.mean() if share_good is None else share_good
    weight = np.where(label == 1, good_docs / label.mean(), (1 - good_docs) / (1 - label.mean()))

    def loss(ab: np.ndarray) -> float:
        t = ab[0] * raw + ab[1]
        return float((weight * (np.logaddexp(0, t) - target * t)).sum() + (ab[0] - 1) ** 2 / 2)

    ab = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's steps of Platt's map, halved while they don't help
        p = 1 / (1 + np.exp(-np.clip(ab[0] * raw + ab[1], -30, 30)))
        g, w = weight * (target - p), weight * p * (1 - p)
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, [(g * raw).sum() - (ab[0] - 1), g.sum()])
        while np.abs(step).max() > 1e-9 and loss(ab + step) > loss(ab):
            step = step / 2
        ab = ab + step
    a, b = ab
    f.a, f.b = max(float(a), 1e-3), float(b)
    return f


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = plain(batch.column(1))
        for i, j in slices(text):
            x, size, count = line_features(text[i:j])
            stop = np.cumsum(count)
            rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(stop - count, stop)]
            sizes = [size[a:b].astype("<i8").tobytes() for a, b in zip(stop - count, stop)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())],
                                             names=["label", "x", "size"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field learned from ``docs`` (doc_id, text) with ``labels`` (doc_id,
    quality), without the held-out fold (crc32 of the id modulo 4 is 2)."""
    prepare(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")).where(
        (fold_of(F.col("doc_id"), 4) != 2) & F.col("quality").isin(0, 1))
    per = {r["quality"]: r["n"] for r in y.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(per) < 2:
        return Field.neutral()
    # half of the sample from each kind, the map to the score weighs them back;
    # first of the labels (few bytes), then of the texts that have their ids
    y = first_by_hash(y.select("doc_id", "quality"), "quality", TRAIN_DOCS // 2)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = first_by_hash(d.join(F.broadcast(y), "doc_id").select("doc_id", "quality", "text"), "quality", TRAIN_DOCS // 2)
    some = stored(some.select("quality", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")), "quality-sample")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    chosen, room = [], {k: TRAIN_LINES // 2 for k in per}
    for r in some.select("quality", "hash", n_lines.alias("n")).orderBy("hash", "quality").collect():  # TRAIN_DOCS rows at most
        if r["n"] <= room[r["quality"]]:
            room[r["quality"]] -= r["n"]
            chosen.append(r["hash"])
    rows = some.where(F.col("hash").isin(chosen)).select("quality", "text").mapInArrow(_features, "label long, x binary, size binary").collect()
    rows.sort(key=lambda r: (r["label"], r["size"], r["x"]))  # the same sums whatever order tasks end in
    if len({r["label"] for r in rows}) < 2:
        return Field.neutral()
    count = np.array([len(r["size"]) // 8 for r in rows])
    x = np.frombuffer(b"".join(r["x"] for r in rows), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
    size = np.frombuffer(b"".join(r["size"] for r in rows), "<i8")
    return fit(x, size, count, np.array([r["label"] for r in rows]), share_good=per[1] / (per[0] + per[1]))


def _scorer(field: Field):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        give_back()
        texts, out = plain(text), []
        for i, j in slices(texts):
            x, size, count = line_features(texts[i:j])
            good, _ = marginals(field.lines(x), field.pair, count)
            out.append(field.score(documents_quality(good, size, count)))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    field = train(docs, labels)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = d.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), _scorer(field)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns kept."""
    field = train(docs, labels)
    return docs.where(_scorer(field)(F.col("text").cast("string")) >= GOOD)
