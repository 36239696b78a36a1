"""Language identification (operator 9).

Sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3
letters, word edges marked, hashed to ``FEATURES``), trained with
follow-the-regularised-leader and elastic-net penalties, then temperature
calibration on documents not used for the weights.

Document frequencies and the counts of languages come from all learning
documents in one distributed pass.  The weights are fitted on at most
``TRAIN_PER_LANG`` + ``CALIBRATE_PER_LANG`` documents of each language, all
different in id or text, the first by a hash of both; only their sparse vectors
(at most ``FEATURES`` numbers each) reach the driver.  Prediction is one pass over whole
texts without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without any learning document everything is ``und``; ties of scores go to the
language that sorts first; a document that stands twice counts twice in the
document frequencies and once in the sample; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import first_by_hash, flat, fold_of, give_back, plain, prepare, slices

FEATURES = 1 << 15
TRAIN_PER_LANG, CALIBRATE_PER_LANG = 400, 100
UNKNOWN = "und"
#: Calibrated probability below which a filtering stage rejects a document.
SURE = 0.5
#: Text bytes taken at once: a character needs some 80 bytes here.
SLICE = 512 << 10


def letters(text: pa.Array) -> pa.Array:
    """Lower-cased texts with everything but letters turned to single spaces,
    and a space at either end."""
    low = pc.replace_substring_regex(pc.utf8_lower(text), r"[^\p{L}\p{M}]+", " ")
    return pc.binary_join_element_wise("", pc.utf8_trim_whitespace(low), "", " ")


def counts(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the hashed n-grams that it has, and how often."""
    data, off = flat(letters(text))
    # the bytes of one character are joined to one number
    lead = (data & 0xC0) != 0x80
    begin = np.flatnonzero(lead)
    code = data[begin].astype(np.uint64)
    size = np.diff(np.append(begin, len(data)))
    del lead
    for k in range(1, 4):
        has = size > k
        code[has] = code[has] << np.uint64(8) | data[begin[has] + k]
    char = np.searchsorted(begin, off)
    salt = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    one = code * salt
    two = (one[:-1] ^ code[1:]) * salt if len(code) > 1 else one[:0]
    three = (two[:-1] ^ code[2:]) * salt if len(code) > 2 else one[:0]
    grams = [(g >> shift).astype(np.int32) for g in (one, two, three)]
    del code, size, one, two, three
    for a, b in zip(char[:-1], char[1:]):
        if b - a < 3:  # the two edges alone
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        n = np.bincount(grams[0][a:b], minlength=FEATURES)
        n += np.bincount(grams[1][a:b - 1], minlength=FEATURES)
        n += np.bincount(grams[2][a:b - 2], minlength=FEATURES)
        f = np.flatnonzero(n)
        yield f, n[f]


def vector(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length."""
    v = (1 + np.log(np.maximum(n, 1))) * idf[f]
    return v / max(float(np.sqrt((v * v).sum())), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weight: np.ndarray  # FEATURES x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, f: np.ndarray, n: np.ndarray) -> np.ndarray:
        return vector(f, n, self.idf) @ self.weight[f] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, idf: np.ndarray, epochs: int = 3,
         alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-5, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal): per coordinate, z sums the
    gradients less the moves of the learning rate, n their squares; a weight
    is 0 while |z| <= l1 (per step), else the closed form below."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))  # the last row is the bias
    rng = np.random.default_rng(7)
    t = 0

    def leader(zi, ni):
        pull = l1 * max(t, 1)
        return np.where(np.abs(zi) <= pull, 0, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(ni)) / alpha + l2 * max(t, 1)))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            f, count, label = rows[r]
            at, x = np.append(f, FEATURES), np.append(vector(f, count, idf), 1.0)
            zi, ni = z[at], n[at]
            w = leader(zi, ni)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at], n[at] = zi + g - sigma * w, ni + g * g
            t += 1
    w = leader(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature (golden section over its logarithm) with the least log loss."""
    def loss(x: float) -> float:
        p = _softmax(logits / np.exp(x))[np.arange(len(label)), label]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition: one row for each feature that it has."""
    total, docs = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        text = plain(batch.column(0))
        for i, j in slices(text, SLICE):
            for f, _ in counts(text[i:j]):
                total[f] += 1
                docs += 1
    give_back()
    f = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(total[f], docs))], names=["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = plain(batch.column(2))
        got = [(f.astype("<i4").tobytes(), n.astype("<i4").tobytes()) for i, j in slices(text, SLICE) for f, n in counts(text[i:j])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in got], pa.binary()), pa.array([n for _, n in got], pa.binary())],
                                         names=["doc_id", "lang", "f", "n"])


def train(docs: DataFrame) -> Model | None:
    """The model learned from the text and lang of ``docs`` (doc_id, text,
    lang) outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    prepare(docs.sparkSession)
    d = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
         .where((fold_of(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    per = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    langs = sorted(per)
    df = np.zeros(FEATURES)
    total = 0
    for r in d.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 0.1
    want = TRAIN_PER_LANG + CALIBRATE_PER_LANG
    some = first_by_hash(d, "lang", want)
    rows = some.select("doc_id", "lang", "text").mapInArrow(_vectors, "doc_id long, lang string, f binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["f"]))
    found = [(np.frombuffer(r["f"], "<i4"), np.frombuffer(r["n"], "<i4"), langs.index(r["lang"])) for r in rows]
    found = [r for r in found if len(r[0])]
    own = CALIBRATE_PER_LANG / want
    spare = np.random.default_rng(11).random(len(found)) < own
    fit_rows = [r for r, s in zip(found, spare) if not s] or found
    weight, bias = ftrl(fit_rows, len(langs), idf)
    model = Model(langs, idf, weight.astype(np.float32), bias)
    held = [r for r, s in zip(found, spare) if s]
    if held and len(langs) > 1:
        model.temperature = temperature(np.array([model.logits(f, n) for f, n, _ in held]), np.array([y for _, _, y in held]))
    return model


PREDICTION = "struct<lang_pred:string,score:double>"
_PREDICTION = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def _predictor(spark, model: Model | None):
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(text: pa.Array) -> pa.Array:
        give_back()
        m, out = sent.value, []
        texts = plain(text)
        for i, j in slices(texts, SLICE):
            for f, n in counts(texts[i:j]):
                if m is None or not len(f):
                    out.append((UNKNOWN, 0.0))
                    continue
                p = _softmax(m.logits(f, n) / m.temperature)
                k = int(p.argmax())
                out.append((m.langs[k], float(p[k])))
        return pa.StructArray.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], fields=list(_PREDICTION))

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = d.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), _predictor(docs.sparkSession, model)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with some certainty, all columns kept."""
    model = train(docs)
    return docs.where(_predictor(docs.sparkSession, model)(F.col("text").cast("string"))["score"] >= SURE)
