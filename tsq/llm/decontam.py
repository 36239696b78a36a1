"""Benchmark decontamination by q-gram lemma filtering (operator 2).

A document is contaminated by a benchmark item if some ``WINDOW`` consecutive
characters of the item (the whole item if it is shorter) occur in it with at
most ``EDITS`` edits (in proportion for shorter items).  Characters are code
points, compared after lower-casing; a run of white space (and control
characters) is one space, so a passage that is wrapped anew is the same.
Reported offsets are those of the texts as they came.

1. Filter.  A window of w characters with k edits keeps at least
   w - q + 1 - q k of its q-grams, all within k diagonals.  Shared q-grams of a
   document and an item are counted in diagonal bands that overlap by k
   diagonals; stretches of w characters of a band with that many q-grams stay.
   Here a character is one byte that equal characters share, so the filter
   lets some more through.
2. Verification.  Banded alignment, on code points, of the item's windows of
   such a stretch, the one with most q-grams first, then all others.

The benchmark is the stated query set: it goes to the executors in blocks of
at most ``BLOCK_CHARS`` characters, each block against all documents, so its
size is bounded however long it is.  Leaks are found without a shuffle; a
benchmark of several blocks takes one pass for each, whose result is written,
and the filter then drops texts by their digests.  Hits of a very common
passage are expanded ``HITS`` at a time.

Defined cases: null or empty texts and items shorter than q characters (with
runs of white space as one) match nothing; repeated rows are judged each; equal
items are reported each; stretches of one item that meet are one row; a very
long text is taken alone, whole; empty tables give no leaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm.base import give_back, kept, plain, prepare, slices, stored, within

Q = 8
WINDOW, EDITS = 64, 4
#: Diagonals that a band holds besides those it shares with the next one.
BAND = 8
#: Characters of benchmark items that one pass over the documents takes.
BLOCK_CHARS = 2 << 20

SPANS = "array<struct<item_id:long,doc_start:int,doc_end:int,item_start:int,item_end:int,edits:int>>"
_SPAN = pa.struct([("item_id", pa.int64()), *[(c, pa.int32()) for c in ("doc_start", "doc_end", "item_start", "item_end", "edits")]])

#: Hits that are expanded to item positions at once.
HITS = 4 << 20

_FOLD: list[np.ndarray] = []


class Folded:
    """All texts as one row of characters, each text followed by EDITS + 1
    zeros (no alignment within the budget runs across): ``point`` their folded
    code points, ``code`` one byte for each (equal points have equal bytes),
    ``origin`` their place in the text as it came, ``begin`` and ``size`` of
    each text."""

    def __init__(self, texts: list[str]):
        if not _FOLD:
            point = np.arange(1 << 17, dtype=np.uint32)
            for c in range(1 << 17):
                if chr(c).isspace() or c < 32:
                    point[c] = 32
                elif not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
                    point[c] = ord(low)
            _FOLD.append(point)
        raw = np.frombuffer(("\0" * (EDITS + 1)).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + EDITS + 1) - size - EDITS - 1
        point = np.where(raw < 1 << 17, _FOLD[0][np.minimum(raw, (1 << 17) - 1)], raw)
        for i in range(EDITS + 1):
            point[begin + size + i] = 0
        again = np.zeros(len(point), bool)  # white space right after white space
        again[1:] = (point[1:] == 32) & (point[:-1] == 32)
        kept = np.cumsum(~again)
        self.origin = (np.arange(len(point)) - np.repeat(begin, size + EDITS + 1))[~again]
        self.point = point[~again]
        self.begin = kept[begin] - 1 if len(begin) else begin
        self.size = (kept[begin + size] - 1 - self.begin) if len(begin) else size
        self.code = np.where(self.point < 128, self.point, 128 + self.point % 127).astype(np.uint8)

    def places(self, a: int, b: int) -> tuple[int, int]:
        """Offsets in the text as it came of the characters from a to b."""
        return int(self.origin[a]), int(self.origin[b - 1]) + 1


def grams(code: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each character, as a 64-bit number (q = 8)."""
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    g = code.astype(np.uint64)
    g = g[:-1] | g[1:] << np.uint64(8)
    g = g[:-2] | g[2:] << np.uint64(16)
    return g[:-4] | g[4:] << np.uint64(32)


class Index:
    """q-gram index of a block of items."""

    TABLE_BITS = 22

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.text = Folded([t for _, t in items])
        self.begin, self.size = self.text.begin, self.text.size
        self.window = np.minimum(self.size, WINDOW)
        self.edits = self.window * EDITS // WINDOW
        self.least = np.maximum(self.window - Q + 1 - Q * self.edits, 1)
        count = np.maximum(self.size - Q + 1, 0)
        at = np.repeat(self.begin, count) + within(count)
        g = grams(self.text.code)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.at, self.item = at[order], np.repeat(np.arange(len(items)), count)[order]
        self.gram, self.first = np.unique(g[order], return_index=True)
        self.last = np.append(self.first[1:], len(g))
        self.table = np.zeros(1 << self.TABLE_BITS, bool)
        self.table[self._slot(self.gram)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.TABLE_BITS)

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of ``code`` where a q-gram of some item begins, and the gram's number."""
        g = grams(code)
        p = np.flatnonzero(self.table[self._slot(g)])
        k = np.searchsorted(self.gram, g[p])
        k[k == len(self.gram)] = 0
        real = self.gram[k] == g[p] if len(self.gram) else np.zeros(len(p), bool)
        return p[real], k[real]


def _crowded(index: Index, p: np.ndarray) -> np.ndarray:
    """Of ascending hit positions: whether some window of a text holds enough
    of them for any item."""
    least, span = int(index.least.min()), int((index.window + index.edits).max()) - Q
    if len(p) < least:
        return np.zeros(len(p), bool)
    start = np.flatnonzero(p[least - 1:] - p[:len(p) - least + 1] <= span)
    cover = np.zeros(len(p) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + least, -1)
    return np.cumsum(cover[:-1]) > 0


def _stretches(index: Index, p: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Stretches of bands that pass the filter: rows of item, band, first and
    last hit, the hits that begin the densest and the last window, and how many
    hits the densest has."""
    total = np.append(0, np.cumsum(index.last[gram] - index.first[gram]))
    reach = 2 * int((index.window + index.edits).max()) if len(index.window) else 0
    found, i = [], 0
    while i < len(p):
        j = max(int(np.searchsorted(total, total[i] + HITS, side="right")) - 1, i + 1)
        # what a window across the cut needs is looked at again
        back = int(np.searchsorted(p, p[i] - reach))
        found.append(_expanded(index, p[back:j], gram[back:j]))
        i = j
    if len(found) < 2:
        return found[0] if found else np.zeros((0, 7), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    out: list[list[int]] = []
    for row in rows.tolist():
        last = out[-1] if out else None
        if last and last[:2] == row[:2] and row[2] <= last[3]:
            if row[6] > last[6]:
                last[4], last[6] = row[4], row[6]
            last[3], last[5] = max(last[3], row[3]), max(last[5], row[5])
        else:
            out.append(row)
    return np.array(out, np.int64).reshape(-1, 7)


def _expanded(index: Index, p: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The stretches of so many hits."""
    none = np.zeros((0, 7), np.int64)
    many = index.last[gram] - index.first[gram]
    pos = np.repeat(p, many)
    post = np.repeat(index.first[gram], many) + within(many)
    item = index.item[post]
    diagonal = pos - (index.at[post] - index.begin[item])  # document position of the item's start
    band = diagonal // BAND
    low = diagonal - band * BAND < index.edits[item]  # in the shared part: also of the band before
    item, band, pos = (np.concatenate([item, item[low]]), np.concatenate([band, band[low] - 1]), np.concatenate([pos, pos[low]]))
    if not len(pos):
        return none
    order = np.lexsort((pos, band, item))
    item, band, pos = item[order], band[order], pos[order]
    turn = np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]))
    once = turn | np.append(True, pos[1:] != pos[:-1])  # a character counts once in a band
    lane = (np.cumsum(turn) - 1)[once]
    item, band, pos = item[once], band[once], pos[once]
    # one number per lane and position, with room for a window's span
    key = lane * (int(pos.max()) + 2 * WINDOW + 1) + pos
    need = index.least[item]
    ahead = np.arange(len(pos)) + need - 1
    there = np.minimum(ahead, len(pos) - 1)
    # k insertions may stretch the window in the document
    span = index.window[item] + index.edits[item] - Q
    start = np.flatnonzero((ahead < len(pos)) & (lane[there] == lane) & (pos[there] - pos <= span))
    if not len(start):
        return none
    stop = there[start]
    # windows that meet are one stretch
    new = np.append(True, (lane[start[1:]] != lane[start[:-1]]) | (start[1:] > stop[:-1] + 1))
    first = np.flatnonzero(new)
    dense = np.searchsorted(key, key[start] + span[start], side="right") - start
    group = np.cumsum(new) - 1
    best = np.lexsort((-dense, group))[first]
    last = np.append(first[1:], len(start)) - 1
    return np.stack([item[start[first]], band[start[first]], pos[start[first]], pos[stop[last]], pos[start[best]], pos[start[last]], dense[best]], 1)


def banded_edits(x: np.ndarray, code: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Least edits of each row of ``x`` (n windows of equal length) against any
    stretch of ``code`` whose path stays in ``width`` diagonals from ``left``
    (the document position of the window's first character on the lowest one)."""
    w = x.shape[1]
    place = left[:, None] + np.arange(w + width)
    inside = (place >= 0) & (place < len(code))
    y = np.where(inside, code[np.clip(place, 0, len(code) - 1)], 0)  # a zero equals no character of an item
    col = np.arange(width, dtype=np.int16)
    best = np.zeros((len(x), width), np.int16)
    for i in range(w):
        step = best + (y[:, i:i + width] != x[:, i:i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], best[:, 1:] + np.int16(1))  # the item's character has no partner: a diagonal lower
        # the document's characters without a partner: moves to higher diagonals
        best = np.minimum.accumulate(step - col, axis=1) + col
    return best.min(1)


def _windows_edits(index: Index, point: np.ndarray, item: np.ndarray, band: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least edits of the window from ``start`` of each item along its band."""
    out = np.empty(len(item), np.int64)
    for w in np.unique(index.window[item]):
        rows = np.flatnonzero(index.window[item] == w)
        k = int(index.edits[item[rows[0]]])
        for at in range(0, len(rows), 4096):
            r = rows[at:at + 4096]
            x = index.text.point[(index.begin[item[r]] + start[r])[:, None] + np.arange(w)]
            # the paths of a window's edits stay within k diagonals of its hits
            out[r] = banded_edits(x, point, start[r] + band[r] * BAND - k, BAND + 3 * k)
    return out


def leaks(index: Index, text: Folded) -> list[tuple]:
    """Verified matches in folded texts: item number, start and end in
    ``text``, item start and end, edits."""
    p, gram = index.hits(text.code)
    if not len(p):
        return []
    dense = _crowded(index, p)
    found = _stretches(index, p[dense], gram[dense])
    item, band, first, last, best, final, _ = found.T
    w, k, size = index.window[item], index.edits[item], index.size[item]
    where = np.clip(best - band * BAND - k, 0, size - w)
    edits = _windows_edits(index, text.point, item, band, where)
    # where the densest window fails, all windows of the stretch
    over = np.flatnonzero(edits > k)
    # a window within the budget has its first q-gram among its first q k + 1
    # characters, and that q-gram begins a crowded window
    low = np.clip(first[over] - (band[over] + 1) * BAND - 2 * k[over] - Q * k[over], 0, (size - w)[over])
    high = np.clip(final[over] - band[over] * BAND + k[over], low, (size - w)[over])
    for at in range(0, len(over), 256):
        some, lo, many = over[at:at + 256], low[at:at + 256], (high - low)[at:at + 256] + 1
        row = np.repeat(np.arange(len(some)), many)
        start = lo[row] + within(many)
        each = _windows_edits(index, text.point, item[some][row], band[some][row], start)
        pick = np.lexsort((each, row))[np.cumsum(many) - many]
        edits[some], where[some] = each[pick], start[pick]
    ok = edits <= k
    lo = np.maximum(np.minimum(first - band * BAND - BAND, where), 0)
    hi = np.minimum(np.maximum(last + Q - band * BAND, where + w), size)
    rows = np.stack([item, first, last + Q, lo, hi, edits], 1)[ok]
    # bands overlap: one row per item and meeting stretches
    merged: list[list] = []
    for row in sorted(rows.tolist()):
        if merged and merged[-1][0] == row[0] and row[1] <= merged[-1][2]:
            m = merged[-1]
            m[2], m[3], m[4], m[5] = max(m[2], row[2]), min(m[3], row[3]), max(m[4], row[4]), min(m[5], row[5])
        else:
            merged.append(row)
    return [tuple(m) for m in merged]


_BUILT: dict[str, Index] = {}


def _matcher(spark: SparkSession, block: list[tuple[int | None, str]]):
    """UDF: text to its leaks of the block's items (at most BLOCK_CHARS
    characters, sent once to each executor)."""
    sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    @F.arrow_udf(SPANS)
    def match(text: pa.Array) -> pa.Array:
        give_back("benchmark")
        if name not in _BUILT:  # a worker keeps the index of one block
            _BUILT.clear()
            _BUILT[name] = Index(sent.value)
            kept("benchmark", _BUILT.clear)
        index, texts, out = _BUILT[name], plain(text), []
        for i, j in slices(texts):
            own = Folded(texts[i:j].to_pylist())
            each = [[] for _ in range(j - i)]
            for item, a, b, lo, hi, edits in leaks(index, own):
                d = int(np.searchsorted(own.begin, a, side="right")) - 1
                start, end = own.places(a, b)
                lo, hi = index.text.places(index.begin[item] + lo, index.begin[item] + hi)
                each[d].append({"item_id": index.ids[item], "doc_start": start, "doc_end": end,
                                "item_start": lo, "item_end": hi, "edits": edits})
            out += each
        return pa.array(out, pa.list_(_SPAN))

    return match


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of at most BLOCK_CHARS characters (a longer item alone);
    the driver holds one block and one partition of the benchmark at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if text is None or len(text) < Q:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, doc_end, item_start, item_end, edits of every
    contaminated stretch (character offsets of the texts)."""
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    empty = spark.createDataFrame([], "doc_id long, item_id long, doc_start int, doc_end int, item_start int, item_end int, edits int")
    found, waiting = [], None
    for block in _blocks(benchmark):
        if waiting is not None:  # several blocks: a pass for each
            found.append(stored(waiting, "leaks"))
        waiting = d.select("doc_id", F.explode(_matcher(spark, block)("text")).alias("m")).select("doc_id", "m.*")
    if waiting is not None:
        found.append(stored(waiting, "leaks") if found else waiting)
    return reduce(DataFrame.unionByName, found, empty)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any leak, all columns kept."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col("text").cast("string")
    digest, found, waiting = F.md5(text.cast("binary")), [], None
    for block in _blocks(benchmark):
        if waiting is not None:
            found.append(stored(docs.where(F.size(waiting(text)) > 0).select(digest.alias("_digest")).distinct(), "leaking"))
        waiting = _matcher(spark, block)
    if waiting is None:
        return docs
    if not found:
        return docs.where(F.size(waiting(text)) == 0)
    found.append(stored(docs.where(F.size(waiting(text)) > 0).select(digest.alias("_digest")).distinct(), "leaking"))
    gone = reduce(DataFrame.unionByName, found).distinct()
    return docs.withColumn("_digest", digest).join(gone, "_digest", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
