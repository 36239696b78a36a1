"""Merkle manifest: addresses, blocks and proofs against a plain tree of lists."""
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np

from tsq.llm import merkle as m
from tsq.session import scratch_path


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    """Root, and for each leaf the run it stands in on each level."""
    runs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % 8
            runs[i].append((p - first, level[first:first + 8]))
        level = [_h(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], runs


def _plain(rows):
    """The contract, row by row, over (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: _h(*map(field, r))
    low = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for r in rows:
        copy = (*r[:4], low(r[4])) if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 else r
        by[r[2]].append((r[0] is None, r[0] or 0, leaf(r), leaf(copy)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    sub = {x: _tree([r[2] for r in sorted(by[x])]) for x in langs}
    root, over = _tree([sub[x][0] for x in langs])
    out = []
    for x, above in zip(langs, over):
        for (null, i, own, copy), runs in zip(sorted(by[x]), sub[x][1]):
            levels = runs + above
            folded = copy
            for p, run in levels:
                folded = _h(*run[:p], folded, *run[p + 1:])
            out.append((None if null else i, own, sub[x][0], root, _h(*(d for p, run in levels for j, d in enumerate(run) if j != p)),
                        folded, folded == root))
    return sorted(map(str, out))


def test_addresses_are_a_permutation_and_split_at_half():
    for levels in range(1, 7):
        at = np.concatenate([m.address(levels, d, np.arange(8 ** d)) for d in range(levels)])
        assert (np.sort(at) == np.arange(m._size(levels))).all()
    # four levels: the upper two first, then each lower subtree in one stretch
    assert (m.address(4, 1, np.arange(8)) == np.arange(1, 9)).all()
    assert (m.address(4, 2, np.arange(64)) == 9 + 9 * np.arange(64)).all()
    assert (m.address(4, 3, np.arange(512)) == 9 + 9 * (np.arange(512) // 8) + 1 + np.arange(512) % 8).all()


def test_block_and_siblings():
    for n in (1, 2, 8, 9, 64, 65, 511, 512):
        leaves = [sha256(b"%d" % i).digest() for i in range(n)]
        for height in {m.height_of(n), 3}:
            nodes = m.build_block(leaves, height)
            for i in (0, n // 2, n - 1):
                assert m.fold(leaves[i], m.siblings(nodes, height, n, i)) == nodes[:32]
        if n > 1:
            assert m.build_block(leaves, m.height_of(n))[:32].hex() == _tree([d.hex() for d in leaves])[0]


def _run(spark, rows, schema="doc_id long, source string, lang string, n_chars int, text string"):
    d = spark.createDataFrame(rows, schema).withColumns({"leaf": m.F.lit("clash"), "pos": m.F.lit(1)})
    path = scratch_path(spark, "manifest")
    got = m.check_copies(spark, path, m.write_manifest(m.tampered(d), path))
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in got.collect())


def test_odd_cases(spark):
    rows = [(i, "s", "de", 3, f"Text {i}") for i in range(1300)]  # three blocks
    rows += [(i, None, None, None, None) for i in range(5)] + [(5, "x", "", 0, ""), (6, "x", "é", 0, "É"), (7, "x", "zz", 2, "A" * 100_000)]
    rows += [(8, "x", "fr", 1, "Same")] * 9 + [(8, "x", "fr", 1, "Other"), (None, "x", "fr", 1, "Q")]
    assert _run(spark, rows) == _plain(rows)


def test_many_trees(spark):
    rows = [(i, "s", f"l{i % 600}", 3, f"T {i}") for i in range(1200)]  # the tree of trees has two stages
    assert _run(spark, rows) == _plain(rows)


def test_one_row_and_none(spark):
    assert _run(spark, [(1, "s", "de", 3, "Abc")]) == _plain([(1, "s", "de", 3, "Abc")])
    assert _run(spark, []) == []


def test_whole_table(spark):
    from tests.conftest import SF_SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert _run(spark, rows, "doc_id long, source string, lang string, n_chars long, text string") == _plain(rows)
