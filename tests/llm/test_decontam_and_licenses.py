"""Leaks against brute force over all windows, and license notices with edits."""
import random
import re
import time

import numpy as np
import pytest

from tsq.llm import decontam as D
from tsq.llm import licenses as L


def _edit_distance_within(window, text, k):
    """Whether some stretch of text is within k edits of the window (plain recurrence)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= k


def _brute(item, text):
    item, text = (re.sub(r"\s+", " ", x.lower()) for x in (item, text))
    w = min(len(item), D.WINDOW)
    k = w * D.EDITS // D.WINDOW
    return any(_edit_distance_within(item[s:s + w], text, k) for s in range(len(item) - w + 1))


def _garbled(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        p = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[p:p + 1] = [] if kind == 0 else ["q"] if kind == 1 else [s[p], "z"]
    return "".join(s)


def test_leaks_equal_brute_force():
    rng = random.Random(3)
    word = ["the", "of", "and", "tion", "ered", "inga", "thor", "é", "wh", "lyse"]
    prose = lambda n: " ".join(rng.choice(word) + rng.choice(word) for _ in range(n))
    items = [prose(14) for _ in range(4)] + [prose(3)]
    texts = []
    for i, item in enumerate(items):
        for edits in (0, 1, 3, 5, 9, 25):
            part = item[10:10 + 70] if i == 1 else item
            texts.append(prose(6) + " " + _garbled(rng, part, min(edits, len(part) // 12)) + ("\n" if edits else " ") + prose(5))
    texts += [prose(30), "", items[0][:50]]
    index = D.Index(list(enumerate(items)))
    own = D.Folded(texts)
    got = {(int(np.searchsorted(own.begin, r[1], side="right")) - 1, r[0]) for r in D.leaks(index, own)}
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if _brute(item, t)}
    assert len(want) > 10 and got == want


def test_other_scripts_equal_brute_force():
    rng = random.Random(9)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(n))
    slav = lambda n: " ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(6)) for _ in range(n))
    items = [han(64), slav(12), "\U00010400" * 3 + han(70), slav(4) + " " + han(50)]
    texts = []
    for item in items:
        for edits in (0, 2, 4, 6, 12):
            texts.append(han(20) + _garbled(rng, item, edits) + slav(3))
        texts.append(item.upper())
        # every character differs, but shares the filter's byte
        texts.append("".join(chr(ord(c) + 127) if c != " " else c for c in item))
    index, own = D.Index(list(enumerate(items))), D.Folded(texts)
    got = {(int(np.searchsorted(own.begin, r[1], side="right")) - 1, r[0]) for r in D.leaks(index, own)}
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if _brute(item, t)}
    assert len(want) > 10 and got == want


def test_wrapped_anew():
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly jinx a box of old pumpkins"
    word = item.split()
    text = "before\t" + "\n      ".join(" ".join(word[i:i + 4]) for i in range(0, len(word), 4)) + " after"
    index, own = D.Index([(1, item)]), D.Folded(["none", text])
    (_, a, b, lo, hi, edits), = D.leaks(index, own)
    start, end = own.places(a, b)
    assert edits == 0 and text[start:end].startswith("the quick") and text[start:end].endswith("pumpkins") and (lo, hi) == (0, len(item))


def test_hits_in_parts(monkeypatch):
    rng = random.Random(4)
    line = "a line that many items hold, common to all of them and repeated " * 2
    items = [line + "".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(30)]
    texts = [line * 8 + items[3] + line * 5, "z" * 300 + items[5], "a" * 2000]
    index, own = D.Index(list(enumerate([*items, "a" * 90]))), D.Folded(texts)
    whole = D.leaks(index, own)
    monkeypatch.setattr(D, "HITS", 700)
    assert len(whole) > 30 and sorted(D.leaks(index, own)) == sorted(whole)


def test_leak_queries(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly jinx a box of old pumpkins"
    docs = spark.createDataFrame(
        [(1, "abc " + item.upper() + " def", 0), (2, None, 0), (3, "", 0), (1, "clean again", 0), (None, item, 0),
         (5, "x " * 50_000 + item[:80].replace("fox", "fax"), 0), (6, item[:40], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "tiny", 1), (10, item, 1)], "item_id long, text string, doc_id int")
    rows = D.benchmark_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, 5, None) for i in (7, 10)}
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.doc_start, one.doc_end, one.edits) == (4, 4 + len(item), 0)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == ["", "", "clean again", item[:40]]
    assert D.benchmark_leaks(docs, bench.limit(0)).count() == 0 and D.benchmark_leaks(docs.limit(0), bench).count() == 0


def test_blocks_of_a_long_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    items = [f"item {i} " + " ".join(f"word{i}x{j}" for j in range(9)) for i in range(5)]
    docs = spark.createDataFrame([(i, "so " + t) for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.benchmark_leaks(docs, bench).collect()} == {(i, i) for i in range(5)}
    assert D.drop_contaminated(docs, bench).count() == 0


def test_repetitive_text_takes_bounded_time():
    index = D.Index([(0, "ab" * 100), (1, "a" * 100)])
    own = D.Folded(["a" * 20_000 + "ab" * 10_000])
    t0 = time.time()
    assert {r[0] for r in D.leaks(index, own)} == {0, 1}
    assert time.time() - t0 < 30


def test_license_notices(spark):
    mit = dict(L.TEMPLATES[:1])["MIT"]
    long = L.TEMPLATES[3][1]
    rows = [(1, "Some text.\nReleased under the MIT License. More text"), (2, "nothing released here"), (3, None), (4, ""),
            (5, "élan " + long.replace("compliance", "accordance").replace("obtain", "get") + " end"), (6, "released under the mit license\n" * 2),
            (7, "This work is licensed under the GNU General Public License, version 3."), (None, mit), (8, "w " * 60_000 + mit)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    got = L.license_notices(d).collect()
    assert sorted(((r.doc_id or -1), r.license) for r in got) == [(-1, "MIT"), (1, "MIT"), (5, "Apache-2.0"), (6, "MIT"), (6, "MIT"), (7, "GPL-3.0"), (8, "MIT")]
    text = dict(rows)
    for r in got:
        part = text[r.doc_id][r.start:r.end].lower()
        assert part.startswith(dict(enumerate(t.lower()[:8] for _, t in L.TEMPLATES))[r.template]) and r.coverage >= 0.8
    assert L.license_notices(d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_winnowing_guarantee(size):
    import numpy as np
    rng = np.random.default_rng(size)
    run = L.GRAM + L.WINNOW - 1
    shared = rng.integers(1, 2**60, run).astype(np.uint64)
    a = np.concatenate([rng.integers(1, 2**60, size).astype(np.uint64), shared])
    b = np.concatenate([shared, rng.integers(1, 2**60, size).astype(np.uint64)])
    x, _ = L.winnowed(a, np.array([len(a)]))
    y, _ = L.winnowed(b, np.array([len(b)]))
    assert len(np.intersect1d(x, y)) > 0


def _names(text):
    import pyarrow as pa
    return [f["license"] for f in sorted(L.Index(L.TEMPLATES).scan(pa.array([text]))[0], key=lambda f: f["start"])]


@pytest.mark.parametrize("text, name", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 9.", ["GPL"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY-NC 1.0.", ["CC-BY-NC"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("Released under the BSD License.", ["BSD"]), ("Released under the Foo License.", []),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", ["MIT", "CC-BY-NC-4.0", "CC-BY-4.0"])])
def test_sibling_licenses_have_their_own_names(text, name):
    assert _names(f"Some words. {text} More words follow.") == name


def test_every_template_has_its_name():
    for name, text in L.TEMPLATES:
        assert _names(f"Some words. {text} More words follow.") == [name]


@pytest.mark.parametrize("template", [4, 5, 7, 8, 12])
def test_notice_after_a_run_of_a_bigram_of_its_own(template):
    name, text = L.TEMPLATES[template]
    word = text.split()
    for k in range(5):
        assert name in _names(" ".join(word[k:k + 2] * 30) + " " + text)
