"""Tokens, token files and packing against the library itself and exact round trips."""
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tsq.llm import dac, packing
from tsq.llm.hashing import shingles, words
from tsq.llm.tokens import encode_documents
from tsq.session import scratch_path

ODD = [None, "", "a", "\n\n", "don't x's  \t\x1c\x85 !!'s", "Ünḯ 中文 x é", "µªº²½ ÀÉß×÷ ", "x<|endoftext|>y", "\xa0x\xadÿ İI"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def docs(spark):
    from tests.conftest import SF_SMALL
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    more = [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_000, "same id"), (77_000, "word " * 30_000)]
    return d.union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 as shard", "2 as ids").cache()


def test_word_encoder_equals_library(library):
    got = [x.tolist() for x in encode_documents(pa.array([t or "" for t in ODD]))]
    assert got == [_ids(library, t) for t in ODD]


def test_words_and_shingles_of_small_texts():
    h, start, end, n = words(pa.array(["One two-3", "", "...", "a b c d e f", "élan x"]))
    assert n.tolist() == [3, 0, 0, 6, 2]
    s, m = shingles(h, n)
    assert m.tolist() == [1, 0, 0, 2, 1]
    again, _ = shingles(*(lambda w: (w[0], w[3]))(words(pa.array(["one TWO 3"]))))
    assert again[0] == s[0]


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 0, 65535, 65536, 2**32 - 1], list(range(5000))])
def test_codes_round_trip_and_random_access(ids):
    levels = dac.pack_ids(np.array(ids, np.uint32))
    assert dac.unpack_ids(levels).tolist() == ids
    assert [dac.id_at(levels, i) for i in range(len(ids))] == ids


def test_token_files(spark, docs, library):
    path = scratch_path(spark, "t5")
    dac.write_ids(docs, path)
    rows = dac.read_ids(spark, path).collect()
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text or "")):
        ids = _ids(library, r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files_of_no_documents(spark):
    path = scratch_path(spark, "t5")
    dac.write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert dac.read_ids(spark, path).count() == 0


def test_packing_keeps_every_id_once_without_padding(spark, docs, library):
    got = {}
    seqs = {}
    for r in packing.pack_documents(docs).collect():
        got.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    n = 0
    for r in docs.collect():
        ids = _ids(library, r.text)
        parts = sorted(got[(r.doc_id, len(ids))], key=lambda p: p.start)
        assert sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
        n += len(ids)
    assert sum(x for s in seqs.values() for _, x in s) == n
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_hilbert_key_walks_the_grid_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        path = grid[np.argsort(key)]
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_new_pieces_reach_the_library_many_in_one_text(monkeypatch):
    from tsq.llm import tokens

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("aeistrnÉüß'9.$µ"), 7)) for _ in range(3000)] + ["it's", "''ll", "a“b”", "œuf", "Ωmega", "x­", "", "12ab!?"]
    texts = [" ".join(draw.permutation(words)[:900]) for _ in range(6)] + [" ".join(words)]
    for most in (250_000, 500):  # words that are kept, and words made each time
        monkeypatch.setattr(tokens, "CACHE_WORDS", most)
        enc = tokens.WordEncoder()
        enc.lines, enc.piece, enc.whole = Counted(enc.lines), Counted(enc.piece), Counted(enc.whole)
        for text in texts:
            ids, count = enc.encode(pa.array([text, "", text[:50]]))
            want = [enc.whole.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text[:50])]
            assert ids.tolist() == sum(want, []) and count.tolist() == list(map(len, want))
        assert enc.piece.texts == 0 and enc.lines.texts < 100  # a text for each piece before
    # a piece without an end is told by the library itself
    enc.last[:] = False
    assert enc.encode(pa.array(["zqj xvk"]))[0].tolist() == enc.whole.tokenizer.encode("zqj xvk", add_special_tokens=False).ids
