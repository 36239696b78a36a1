"""Fingerprints: homomorphic laws, and the comparison against a plain loop."""
import hashlib

import numpy as np
import pyarrow as pa

from tsq.llm import fingerprint as fp


def _state(text):
    return fp.states(pa.array([text]))[0][0]


def test_order_insertion_and_deletion():
    a = _state("one two three four five six\nsecond paragraph here\nthird")
    assert fp.digest(a) == fp.digest(_state("third\none two three four five six\nsecond paragraph here"))
    assert (fp.add(a, "more") == _state("more\nthird\none two three four five six\nsecond paragraph here")).all()
    assert (fp.remove(a, "third") == _state("one two three four five six\nsecond paragraph here")).all()
    assert fp.digest(a) != fp.digest(_state("one two three four five six\nsecond paragraph here\nthird\nthird"))
    assert not _state("").any() and _state("\n").any()


def test_likeness():
    rng = np.random.default_rng(1)
    word = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    text = " ".join(word)
    half = " ".join(word[:1500] + [f"x{i}" for i in range(1500)])
    a, b, c = (fp.states(pa.array([t]))[0] for t in (text, half, " ".join(f"y{i}" for i in range(3000))))
    assert abs(fp.likeness(a, b)[0] - 0.5) < 0.12 and fp.likeness(a, c)[0] < 0.12 and fp.likeness(a, a)[0] == 1


def test_compare_with_next(spark):
    from tests.conftest import SF_SMALL
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "ab"), (5003, "\n\n\nq"), (5003, "twice"), (None, "no id"), (5004, "z " * 60_000)]
    d = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, block int, ahead int")
    got = {(r.doc_id, r.n_chars): r for r in fp.compare_with_next(d).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in rows]
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = got[(i, len(text))]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.digest(_state(text)) and r.edited_fingerprint == fp.digest(_state(edited))
        three = fp.states(pa.array([text, edited, after]))[0]
        assert abs(r.near_edited - fp.likeness(three[:1], three[1:2])[0]) < 1e-9
        assert abs(r.near_next - fp.likeness(three[:1], three[2:])[0]) < 1e-9


def test_one_and_no_document(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = fp.compare_with_next(one).collect()
    assert len(r) == 1 and r[0].near_next == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fp.compare_with_next(one.limit(0)).count() == 0
    assert fp.fingerprint_documents(one).first().fingerprint == fp.digest(_state("abcdef"))


def test_likeness_of_long_repetitive_texts(spark):
    """Against exact counts of shingles, more than 32,767 of one kind."""
    from collections import Counter

    def counts(text):
        lines = [line.split() for line in text.split("\n")]
        return Counter(tuple(w[i:i + 5]) for w in lines if w for i in range(max(1, len(w) - 4)))

    def cosine(a, b):
        dot = sum(n * b[s] for s, n in a.items())
        return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5

    other = " ".join(f"w{i}" for i in range(9000))
    texts = {3: "z " * 45_000, 2: other, 1: "z " * 70_000 + other, 0: "boiler plate line\n" * 40_000}
    got = {r.doc_id: r for r in fp.compare_with_next(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, text in texts.items():
        after = texts[(i - 1) % 4]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        assert got[i].edited_fingerprint == fp.digest(_state(edited))
        assert abs(got[i].near_edited - cosine(counts(text), counts(edited))) < 0.12
        assert abs(got[i].near_next - cosine(counts(text), counts(after))) < 0.12
    assert got[3].near_edited > 0.9
