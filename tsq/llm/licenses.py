"""License scan (operator 3).

Templates are winnowed: of the hashes of ``GRAM`` consecutive words, the least
one of every ``WINNOW`` consecutive hashes is a fingerprint, so a template and
a text that share ``GRAM + WINNOW - 1`` words in a row share a fingerprint.  An
inverted index of the templates' fingerprints gives candidates (template and
place); each is aligned with the text, word by word, in a band of diagonals
that holds all of every candidate's own, and reported if the alignment covers
``COVERAGE`` of the template's words, among them all ``TELLING`` ones (names,
versions, qualifiers), and skips no qualifier of a sibling license in the text.

Texts are scanned whole in one pass without a shuffle; the templates are a
fixed list (a parameter), so the index has a fixed size.

Defined cases: null or empty texts match nothing; a notice that stands twice is
reported twice; of notices that overlap, whatever their licenses, the one with
most matched words, less the words of template and text without a partner, is
reported (then the first in the list); a notice whose version is not in the
list has the license's name without a version.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import kept, plain, prepare, slices, within
from tsq.llm.hashing import shingles, words

GRAM, WINNOW = 2, 3
#: Diagonals to each side of a candidate's own that an alignment may use, for each 16 words.
BAND = 4
COVERAGE = 0.8

# Notices of public licenses, in their usual short wording.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

_MIT = TEMPLATES[1][1] + (", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                          "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_CLAUSES = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution.")
_ADVERT = (" 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
           "This product includes software developed by the organization.")
_NEITHER = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission.")
TEMPLATES += [
    ("MIT", _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included "
                   "in all copies or substantial portions of the Software."),
    ("MIT-0", _MIT + ". The software is provided \"as is\", without warranty of any kind"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD", "Released under the BSD License."),
    ("BSD-2-Clause", _CLAUSES),
    ("BSD-3-Clause", _CLAUSES + _NEITHER),
    ("BSD-4-Clause", _CLAUSES + _ADVERT + _NEITHER),
    ("Apache", "Licensed under the Apache License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
]
for _name, _title, _versions in (("GPL", "", ("1", "2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("LGPL", "Library ", ("2",)),
                                 ("AGPL", "Affero ", ("1", "3"))):
    for _version in ("", *_versions):
        _full = f"{_name}-{_version}" + (".0" if "." not in _version else "") if _version else _name
        _told = [(_full, f"This work is licensed under the GNU {_title}General Public License" + (f", version {_version}." if _version else "."))]
        for _kind in ("program", "library") if _version else ():
            _told.append((_full, f"This {_kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {_title}"
                                 f"General Public License as published by the Free Software Foundation; either version {_version} of the License"))
        # the wordings above come first
        TEMPLATES += [t for t in _told if t[1].replace(";", "") not in {x.replace(":", "").replace(";", "").replace("Foundation,", "Foundation") for _, x in TEMPLATES}]
for _name, _title in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                      ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _where in (("", ""), ("2.0", " Generic"), ("2.5", " Generic"), ("3.0", " Unported"), ("4.0", " International")):
        _full, _number = (f"CC-{_name}-{_version}", f" {_version}") if _version else (f"CC-{_name}", "")
        TEMPLATES += [t for t in ((_full, f"Licensed under CC {_name}{_number}."),
                                  (_full, f"This work is licensed under a Creative Commons {_title}{_number}{_where} License."))
                      if t not in TEMPLATES]

#: Words that tell licenses apart, besides numbers: a notice has all of its template's.
TELLING = ("mit apache bsd isc mozilla gnu lesser library affero cc nc sa nd commons attribution noncommercial sharealike "
           "noderivatives advertising endorse").split()
#: Qualifiers that make another license of a template with the first word, where the text has them and the template doesn't.
QUALIFIERS = {"gnu": "lesser affero".split(),
              "cc": "nc sa nd".split(),
              "commons": "noncommercial commercial sharealike alike noderivatives noderivs derivatives derivs".split()}

FOUND = "array<struct<license:string,template:int,coverage:double,matched:int,start:int,end:int>>"
_FOUND = pa.struct([("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("matched", pa.int32()),
                    ("start", pa.int32()), ("end", pa.int32())])


def winnowed(word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts given as word hashes, and the place of the first
    word of each among all words: the least hash of each window, the last of
    equal ones; a text with fewer hashes than a window is one window."""
    h, made = shingles(word, count, GRAM)
    if not len(h):
        return h, np.zeros(0, np.int64)
    begin = np.cumsum(made) - made
    windows = np.where(made >= WINNOW, made - WINNOW + 1, np.minimum(made, 1))
    at = np.repeat(begin, windows) + within(windows)
    stop = np.repeat(begin + made, windows)
    best, place = h[at], at
    for k in range(1, WINNOW):
        nxt = np.minimum(at + k, stop - 1)
        less = h[nxt] <= best
        best, place = np.where(less, h[nxt], best), np.where(less, nxt, place)
    place = np.unique(place)
    text = np.searchsorted(begin + made, place, side="right")
    return h[place], (np.cumsum(count) - count)[text] + place - begin[text]


#: Score of a matched word; a word of the text without a partner costs 1.
MATCH = 4
#: Score below which an alignment misses a telling word or skips a qualifier.
WRONG = -1 << 20


def banded_matches(x: np.ndarray, y: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, width: int,
                   must: np.ndarray, other: np.ndarray, need: float):
    """Alignments of the words ``x`` with stretches of ``y``: for each
    ``place`` of x's first word, over ``width`` diagonals to each side and words
    of y from ``low`` to ``high``.  All words of x in ``must`` have a partner,
    no word of the stretch that is in ``other`` is left without one, and
    ``need`` words match at least.  Row of ``place``, matched words, first and
    last matched word of y; one for each diagonal on which such an alignment ends."""
    row = np.arange(len(place))
    n, size = len(place), 2 * width + 1
    col = np.arange(-width, width + 1)
    score, got = np.zeros((n, size), np.int32), np.zeros((n, size), np.int32)
    first, last = np.full((n, size), -1, np.int64), np.full((n, size), -1, np.int64)
    for i in range(len(x)):
        if not must[:i].any():  # it may as well begin here
            first = np.where(score < 0, -1, first)
            got = np.where(score < 0, 0, got)
            score = np.maximum(score, 0)
        spot = place[row][:, None] + col + i
        word = y[np.clip(spot, 0, len(y) - 1)]
        inside = (spot >= low[row][:, None]) & (spot < high[row][:, None])
        same = inside & (word == x[i])
        # what a word of the text costs without a partner, once words have matched
        cost = np.where(inside & np.isin(word, other), -2 * WRONG, 1).astype(np.int32) if len(other) else np.ones(same.shape, np.int32)
        lost = -2 * WRONG if must[i] else 0
        up = (score[:, 1:] - lost, got[:, 1:].copy(), first[:, 1:].copy(), last[:, 1:].copy())
        score = np.where(same, score + MATCH, score - lost - np.where(first >= 0, cost, 0))
        got = got + same
        first, last = np.where(same & (first < 0), spot, first), np.where(same, spot, last)
        better = up[0] > score[:, :-1]  # the template's word has no partner: one diagonal lower
        for have, new in zip((score, got, first, last), up):
            np.copyto(have[:, :-1], new, where=better)
        if i + 1 < len(x):  # words of the text have no partner: higher diagonals
            paid = np.cumsum(cost, axis=1, dtype=np.int32)
            worth = score + paid
            most = np.maximum.accumulate(worth, axis=1)
            if (most > worth).any():
                source = np.maximum.accumulate(np.where(worth == most, np.arange(size), 0), axis=1)
                got, first, last = (np.take_along_axis(have, source, 1) for have in (got, first, last))
                score = most - paid
        np.maximum(score, 8 * WRONG, out=score)
        # each word to come adds one match at most
        able = ((got + (len(x) - 1 - i) >= need) & (score > WRONG)).any(1)
        if not able.all():
            row, score, got, first, last = row[able], score[able], got[able], first[able], last[able]
            if not len(row):
                break
    r, c = np.nonzero((got >= need) & (score > WRONG))
    found = np.unique(np.stack([row[r], got[r, c], first[r, c], last[r, c]], 1), axis=0)
    return found.T


def _hashes(word: list[str]) -> np.ndarray:
    return words(pa.array(word, pa.string()))[0]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        word, _, _, count = words(pa.array([t for _, t in templates], pa.string()))
        begin = np.cumsum(count) - count
        self.word = [word[a:a + n] for a, n in zip(begin, count)]
        h, at = winnowed(word, count)
        template = np.searchsorted(begin + count, at, side="right")
        order = np.argsort(h, kind="stable")
        self.hash, self.template, self.offset = h[order], template[order], (at - begin[template])[order]
        spelt = [re.findall(r"[a-z0-9]+", t.lower()) for _, t in templates]
        self.must, self.other = [], []
        for x, said in zip(self.word, spelt):
            tell = [w for w in said if w in TELLING or (w.isdigit() and "redistributions" not in said)]
            self.must.append(np.isin(x, _hashes(tell)))
            # a qualifier that the template has may stand twice in a text
            self.other.append(_hashes([w for k, ws in QUALIFIERS.items() if k in said for w in ws if w not in said]))

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        """Notices in each text; spans are character offsets."""
        word, start, end, count = words(texts)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        h, at = winnowed(word, count)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        many = hi - lo
        if not many.any():
            return out
        post = np.repeat(lo, many) + within(many)
        template, place = self.template[post], np.repeat(at, many) - self.offset[post]
        stop = np.cumsum(count)
        text = np.searchsorted(stop, np.repeat(at, many), side="right")
        found = []
        for t in np.unique(template):
            x = self.word[t]
            width = BAND * max(1, -(-len(x) // 16))
            mine = template == t
            # one alignment for each cell of neighbouring diagonals, in a band that holds the whole band of each of them
            cell = width // 2
            key = np.unique(np.stack([text[mine], place[mine] // cell], 1), axis=0)
            for a in range(0, len(key), 2048):
                d, p = key[a:a + 2048].T
                for k, got, first, last in zip(*banded_matches(x, word, p * cell + cell // 2, stop[d] - count[d], stop[d], width + cell // 2,
                                                               self.must[t], self.other[t], COVERAGE * len(x))):
                    # words of both without a partner count against it
                    net = 2 * got - len(x) - (last - first + 1 - got)
                    found.append((int(d[k]), int(net), int(got), int(t), int(first), int(last), float(got / len(x))))
        # the best alignment first; a stretch is told once
        found.sort(key=lambda r: (r[0], -r[1], -r[2], r[3], r[4]))
        told: dict[int, tuple[list[int], list[int]]] = {}
        low = pc.utf8_lower(texts)
        base = np.append(0, np.cumsum(np.asarray(pc.binary_length(low)).astype(np.int64)))

        def character(d: int, byte: int) -> int:
            return len(low[d].as_buffer().to_pybytes()[:byte - base[d]].decode(errors="ignore"))

        for d, _, got, t, a, b, coverage in found:
            begins, ends = told.setdefault(d, ([], []))
            k = bisect_left(begins, a)
            if (k and ends[k - 1] >= a) or (k < len(begins) and begins[k] <= b):
                continue
            begins.insert(k, a)
            ends.insert(k, b)
            out[d].append({"license": self.names[t], "template": t, "coverage": coverage, "matched": got,
                           "start": character(d, start[a]), "end": character(d, end[b])})
        return out


_BUILT: dict[str, Index] = {}


def _scanner(templates: list[tuple[str, str]]):
    key = repr(templates)

    @F.arrow_udf(FOUND)
    def scan(text: pa.Array) -> pa.Array:
        if key not in _BUILT:
            _BUILT[key] = Index(templates)
            kept("templates", _BUILT.clear)
        texts = plain(text)
        return pa.array([f for i, j in slices(texts) for f in _BUILT[key].scan(texts[i:j])], pa.list_(_FOUND))

    return scan


def license_notices(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, template, coverage, matched, start, end of every notice found."""
    prepare(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", F.explode(_scanner(templates)("text")).alias("m")).select("doc_id", "m.*")
