"""Quality field and language model: exact parts by enumeration, held-out accuracy."""
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsq.llm import langid as L
from tsq.llm import quality as Q

SF = "/root/testdata/sf0.01"
ODD = [(90_001, None), (90_002, ""), (90_003, "\n\n"), (90_004, "1234 !!"), (90_005, "Licht " * 40_000), (90_005, "twice"), (None, "the end of it")]


@pytest.mark.parametrize("texts", [3, 15])
def test_marginals_equal_enumeration(texts):
    rng = np.random.default_rng(texts)
    count = rng.integers(1, 7, texts)
    score, pair = rng.normal(size=count.sum()) * 2, rng.normal(size=(2, 2))
    good, edge = Q.marginals(score, pair, count)
    at = 0
    for c in count:
        total, each, two = 0.0, np.zeros(c), np.zeros((c, 2, 2))
        for labels in itertools.product((0, 1), repeat=int(c)):
            w = np.exp(sum((y - 0.5) * s for y, s in zip(labels, score[at:at + c])) + sum(pair[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            each += w * np.array(labels)
            for i, (a, b) in enumerate(zip(labels, labels[1:])):
                two[i, a, b] += w
        assert np.allclose(good[at:at + c], each / total) and np.allclose(edge[at:at + c], two / total)
        at += c


def test_line_features_of_odd_texts():
    x, size, count = Q.line_features(pa.array(["", "a\n\nb b b", "x"]))
    assert count.tolist() == [1, 3, 1] and x.shape == (5, Q.N_FEATURES) and np.isfinite(x).all()
    assert size.tolist() == [0, 1, 0, 5, 1] and x[3, 8] > 0.5


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    return d.unionByName(more).selectExpr("*", "'x' as score", "1 as label", "2 as quality").cache()


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("*", "'y' as text")
    more = spark.createDataFrame([(90_001, None, 0, "z"), (None, 1, 0, "z"), (0, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    labels = labels.unionByName(more)
    rows = Q.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.93
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_documents(docs, none).collect()} == {0.5}
    assert Q.score_documents(docs.limit(0), none).count() == 0


def test_ngram_counts():
    def plain_counts(text):
        chars = L.letters(pa.array([text]))[0].as_py()
        return sorted(chars[i:i + k] for k in (1, 2, 3) for i in range(len(chars) - k + 1))
    for text in ("Élan 3x", "ab", "中文 é"):
        got = next(L.counts(pa.array([text])))
        assert got[1].sum() == len(plain_counts(text)) and len(got[0]) <= len(set(plain_counts(text)))
    assert [len(f) for f, _ in L.counts(pa.array(["", "12 .", "a"]))] == [0, 0, 5]


def test_language_held_out(spark, docs):
    rows = L.identify(docs).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out and truth.get(r.doc_id)]
    assert np.mean(held) > 0.97
    odd = {r.doc_id: r for r in rows if r.doc_id in (90_001, 90_002, 90_003, 90_004)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd.values()) and len(odd) == 4
    assert {r.lang_pred for r in rows if r.doc_id == 90_005} <= {"de", "en", "fr", "es"}
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= L.SURE for r in rows)


def test_language_without_learning_rows(spark, docs):
    rows = L.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in rows} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    from tsq.llm import base, quality
    rows = [(7, f"hot {i}", "a") for i in range(400)] + [(8, "same", "a")] * 400 + [(i, f"t {i}", "b") for i in range(30)] + [(None, None, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = {r.lang: r.n for r in base.first_by_hash(d, "lang", 50).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 50, "b": 30, "c": 1}
    assert base.first_by_hash(d, "lang", 500).count() == 401 + 30 + 1
    # one labelled document has more lines than the whole bound, and is left out of the fit alone
    monkeypatch.setattr(quality, "TRAIN_LINES", 2000)
    good = [(i, "A clean line of prose that ends well.\n" * 5) for i in range(1, 200)]
    bad = [(i, "zz 00 ## zz\n#### 11\n" * 3) for i in range(200, 400)] + [(9000, "#\n" * 100_000)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == 400 and min(got[i] for i in range(1, 200)) > 0.7 > max(got[i] for i in range(200, 400)) and got[9000] < 0.7
