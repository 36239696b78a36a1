"""The Jaccard join against brute force, with nodes cut into many blocks."""
import random
import re

import numpy as np
import pytest

from tsq.llm import jaccard as J


def _set(text):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows):
    """Per row: class id, documents linked, classes of equal texts linked, copies."""
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i].append(j)
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            low = min([root[i], *(root[j] for j in js)])
            changed |= low != root[i]
            root[i] = low
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc, min(ids) if ids else None, len(links[i]), len({sets[j] for j in links[i]} - {sets[i]}), 1 + sum(sets[j] == sets[i] for j in links[i])))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(5)
    word = [f"w{i}" for i in range(400)]
    rows, doc = [], 100
    for size, edits in ((70, 3), (12, 1), (5, 0), (2, 5), (30, 9)):
        base = [rng.choice(word) for _ in range(rng.randrange(60, 200))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = rng.choice(word)
            rows.append((doc, " ".join(t)))
            doc += 1
    rows += [(doc + i, " ".join(rng.choice(word) for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    rows += [(7, None), (8, ""), (9, "..."), (9, "..."), (1000, "one two"), (1001, "One, two!"), (None, rows[0][1]), (None, "no id at all"),
             (1002, "long " * 40_000), (1003, rows[70][1]), (1003, rows[70][1])]
    return rows


@pytest.mark.parametrize("block", [2048, 9])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = _rows()
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, class int")
    found = J.jaccard_classes(d, recall=0.9999)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.copies) for r in found.collect()), key=str)
    assert got == _brute(rows)


def test_one_of_each_group_stays(spark):
    rows = _rows()
    d = spark.createDataFrame([(1, *r) for r in rows], "gone int, doc_id long, text string")
    kept = J.keep_one_of_each(d)
    assert kept.columns == d.columns
    want = [i for i, c, *_ in _brute(rows) if i is None or i == c]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))
    assert J.jaccard_classes(d.limit(0)).count() == 0 and J.keep_one_of_each(d.limit(0)).count() == 0


def test_intersections_of_large_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**60, 80).astype(np.uint64)
    sets = [np.unique(np.append(rng.choice(base, 70, replace=False), rng.integers(1, 500, 5).astype(np.uint64))) for _ in range(300)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[:40]] for a in sets[:40]])
    got = J.shared(sets)[:40, :40]
    off = ~np.eye(40, dtype=bool)
    assert (got[off] == want[off]).all() and (J.shared(sets[:40])[off] == want[off]).all()


def test_components_of_a_long_chain(spark):
    n = 60
    edges = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(n)] + [(b"x", b"y")]
    d = spark.createDataFrame(edges, "u binary, v binary")
    got = {bytes(r.node): bytes(r.root) for r in J.components(d).collect()}
    assert got == {f"{i:03}".encode(): b"000" for i in range(1, n + 1)} | {b"y": b"x"}


def test_depth_reaches_the_recall():
    for recall in (0.9, 0.99, 0.999):
        k = J.depth_for(recall=recall)
        assert 1 - (1 - 0.8**k) ** J.TREES >= recall > 1 - (1 - 0.8 ** (k + 1)) ** J.TREES


def test_every_pair_at_the_threshold_is_a_candidate():
    """20,000 pairs of similarity 0.8 exactly (40 of 50 shingles), production defaults."""
    import pyarrow as pa
    depth, k, missed = J.depth_for(), 5, 0
    for a in range(0, 20_000, 2000):
        base = [[f"w{i}x{j}" for j in range(9 * k + 4)] for i in range(a, a + 2000)]
        other = [w[:8 * k + 4] + [f"v{i}x{j}" for j in range(k)] for i, w in enumerate(base, a)]
        x, y = (J.signatures(pa.array([" ".join(w) for w in t]), depth)[2] for t in (base, other))
        assert len(_set(" ".join(base[0])) & _set(" ".join(other[0]))) == 0.8 * len(_set(" ".join(base[0])) | _set(" ".join(other[0])))
        missed += int((~(x == y).any(1)).sum())
    assert missed == 0


def test_production_defaults_equal_brute_force(spark):
    rng = random.Random(8)
    word = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(150):  # links of similarity 0.8 exactly
        base = [rng.choice(word) for _ in range(49)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:44] + [f"v{i}x{j}" for j in range(5)]))]
    rows += [(i + 10_000, t) for i, t in _rows()[:60]]
    found = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.copies) for r in found.collect()), key=str)
    assert got == _brute(rows) and sum(r[2] for r in got) >= 300
