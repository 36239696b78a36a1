"""Exact token ids of many texts with the tokenizers library, word by word.

The pre-tokenizer of ``word_bpe_49k.json`` never joins characters across a
space or line feed, so a text's ids are those of its space-separated words in
order.  Words repeat: a batch is split and its distinct words are found by
Arrow's dictionary encoding; words not met before are cut into pieces, of which
those not met before reach the library, many in one call.
Texts that may hold an added token (``<|``) are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tsq.llm.base import kept, slices

#: The tokenizer file, by the name that ``public_tokenizers.path`` takes.
TOKENIZER = "word_bpe_49k.json"
#: Id appended to every document.
END_ID = 2
#: Words kept by a worker (bounded memory); later ones are encoded each time they turn up.
CACHE_WORDS = 250_000

# Latin-1 words are cut as the file's own pattern does (a line for each word);
# other words go to the library's whole chain.
_LATIN = r"^[!-~\x{a1}-\x{ff}]+$"
_PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+"
                    r"|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\na-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Texts that the library encodes in one call, and pieces that it takes as one text.
_CALL_TEXTS, _TEXT_PIECES = 4096, 256


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of ids, one after the other, each as uint16 bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 2
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _ends(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an array of lists, and the bounds of the lists."""
    _, offsets, data = lists.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(lists) + 1, 8 * lists.offset) // 2
    ids = np.frombuffer(data, np.uint16) if data is not None else np.zeros(0, np.uint16)
    return ids[bounds[0]:bounds[-1]], bounds - bounds[0]


def _each(tokenizer, texts: list[str]) -> pa.Array:
    """The ids of each text."""
    ids, sizes = array("H"), []
    for i in range(0, len(texts), _CALL_TEXTS):
        for e in tokenizer.encode_batch_fast(texts[i:i + _CALL_TEXTS], add_special_tokens=False):
            sizes.append(len(e.ids))
            ids.extend(e.ids)
    return _lists(np.frombuffer(ids, np.uint16), np.cumsum(sizes, dtype=np.int64))


class _Met:
    """Ids of the texts met so far (up to CACHE_WORDS, later ones are made anew)."""

    def __init__(self, make: Callable[[pa.Array], pa.Array]):
        self.make = make
        self.texts, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __call__(self, texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.texts)
        unmet = at.is_null()
        new, known = coded.dictionary.filter(unmet), self.ids
        rows = np.array(at.fill_null(0)).astype(np.int64)
        if len(new):
            known = pa.concat_arrays([known, self.make(new)])
            rows[np.asarray(unmet)] = len(self.texts) + np.arange(len(new))
            room = CACHE_WORDS - len(self.texts)
            if room > 0:
                self.texts, self.ids = pa.concat_arrays([self.texts, new[:room]]), known[:CACHE_WORDS]
        return known.take(pa.array(rows)).take(coded.indices)


class WordEncoder:
    """Token ids of texts; one instance per worker and tokenizer file."""

    _made: dict[str, "WordEncoder"] = {}

    @classmethod
    def of(cls, name: str = TOKENIZER) -> "WordEncoder":
        if name not in cls._made:
            cls._made[name] = cls(name)
            kept("words", cls._made.clear)
        return cls._made[name]

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        byte_map = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the same model behind the byte map alone, for pieces already cut and lower-cased: one a text, or one a line
        self.piece, self.lines = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
        self.piece.pre_tokenizer = byte_map
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), byte_map])
        # ids that end a piece
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.pieces, self.words = _Met(self._new_pieces), _Met(self._new_words)

    def _new_pieces(self, new: pa.Array) -> pa.Array:
        pieces = new.to_pylist()
        lines = ["\n".join(pieces[i:i + _TEXT_PIECES]) for i in range(0, len(pieces), _TEXT_PIECES)]
        ids, _ = _ends(_each(self.lines, lines))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):  # no end in each piece
            return _each(self.piece, pieces)
        return _lists(ids, ends)

    def _new_words(self, new: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(new, _LATIN)
        words = new.filter(plain)
        parts = pa.array(_PIECE.findall("\n".join(words.to_pylist()).lower()), pa.string())
        breaks = np.asarray(pc.equal(parts, "\n"))
        ids, bounds = _ends(self.pieces(parts.filter(pa.array(~breaks))))
        stop = np.append(np.flatnonzero(breaks), len(parts))[:len(words)]
        out = _lists(ids, bounds[stop - np.arange(len(words))])
        if len(words) == len(new):
            return out
        plain = np.asarray(plain)
        rows = np.where(plain, np.cumsum(plain) - 1, len(words) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([out, _each(self.whole, new.filter(pa.array(~plain)).to_pylist())]).take(pa.array(rows))

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (uint16, no end id), and their number per text."""
        parts = pc.split_pattern(pc.replace_substring(arr, "\n", " "), " ")
        per_text = np.diff(np.asarray(parts.offsets)).astype(np.int64)
        ids, bounds = _ends(self.words(parts.flatten()))
        bound = bounds[np.concatenate([[0], np.cumsum(per_text)])]
        count = np.diff(bound)
        special = np.flatnonzero(np.asarray(pc.match_substring(arr, "<|")))
        if len(special):
            pieces = [ids[bound[i]:bound[i + 1]] for i in range(len(arr))]
            for i in special:
                pieces[i] = np.array(self.whole.encode(arr[int(i)].as_py(), add_special_tokens=False).ids, np.uint16)
            ids, count = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, count


def encode_documents(arr: pa.Array, name: str = TOKENIZER, end_id: int = END_ID):
    """Of each text in turn: its ids with the end id, as a uint16 array."""
    enc = WordEncoder.of(name)
    for i, j in slices(arr, 3 << 20):
        ids, count = enc.encode(arr[i:j])
        stop = np.cumsum(count)
        out = np.full(len(ids) + j - i, end_id, np.uint16)
        out[np.arange(len(ids)) + np.repeat(np.arange(j - i), count)] = ids
        at = 0
        for s in (stop + np.arange(1, j - i + 1)).tolist():
            yield out[at:s]
            at = s
