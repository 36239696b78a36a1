"""Vectorised 64-bit hashes of words and word shingles of many texts at once.

A word is a run of a-z, 0-9 or any non-ASCII character after lower-casing;
everything else separates words.  A shingle is k consecutive words of one
text; a text of 1 to k - 1 words has one shingle, of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tsq.llm.base import flat, within

U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, U), 1
    for i in range(n):
        out[i] = x
        x = x * base % 2**64
    return out


_POW = _powers(0xD6E8FEB86659FD93, 4096)
_BYTE = _powers(0xA0761D6478BD642F, 257)[1:]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit changes every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: hash, first byte, byte after the last one;
    and the number of words of each text."""
    data, off = flat(pc.utf8_lower(arr))
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, np.zeros(len(arr), np.int64)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, bool)  # a text begins here: no word runs across
    edge[off] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:n]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(start, off))
    if not len(start):
        return np.zeros(0, U), start, end, count
    size = end - start
    inside = within(size)
    term = _BYTE[data[is_word]] * _POW[inside & 4095]
    h = np.add.reduceat(term, np.cumsum(size) - size) + size.astype(U) * U(_ODD)
    return mix(h), start, end, count


def shingles(word: np.ndarray, count: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and their number for each text."""
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.cumsum(count) - count
    at = np.repeat(begin, made) + within(made)
    stop = np.repeat(begin + count, made)
    h = np.zeros(len(at), U)
    for j in range(k):
        there = at + j < stop
        w = np.where(there, word[np.minimum(at + j, len(word) - 1)], U(1)) if len(word) else h
        h = mix(h * U(_ODD) + w)
    return h, made
