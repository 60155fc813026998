"""Licence scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits (and any non-ASCII characters), A-Z lower-cased. A template's K-word hashes are winnowed: of
each WINDOW neighbours the smallest is kept, so any K + WINDOW - 1 words that a document shares with it in a row hit the
index. Hits of a template whose offsets from it agree within the band are one candidate place. Templates of fewer than SHORT words
are searched by each of their words instead: a place is a candidate where enough of them for the coverage lie within the band. There, template and
document words are aligned with gaps and mismatches allowed inside the band; coverage is the share of the template's words that
are matched, the span reaches from the first to the last of them. Matches of at least MIN_COVERAGE are
reported; of overlapping ones that with more matched words stays, then that with the higher coverage, then the first by name.

The templates are a parameter and a catalogue: they are given on the driver and their index goes to the workers with the function.
Free style (Arrow batches). Edge cases: null and empty texts have no match; ids come out as they are, null ids too; a template without words never matches, and
without templates there are no rows; templates of equal wording are reported once, under the first name; columns named like those of the result
are left out; repeated rows match alike; a very long text is
scanned in linear time (only candidate places are aligned); an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._base import in_batches, ship
from ._words import MOST_REMEMBERED, mixed, odd_numbers

ship(__name__)

K, WINDOW, MIN_COVERAGE = 3, 3, 0.8
#: Templates of fewer words are searched by single words and their places.
SHORT = 15

# Wording of licence notices, as their licences give it.
TEMPLATES = {
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."
    ),
}

_WORD = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
#: Bytes of words stay, A-Z in lower case; the rest becomes white space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _hasher():
    """Text to word hashes; bytes above 127 are never white space for split()."""
    from xxhash import xxh3_64_intdigest

    class Seen(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = h = xxh3_64_intdigest(word)
            return h

    seen = Seen()

    def hashes(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
        if len(seen) > MOST_REMEMBERED:
            seen.clear()
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    return hashes


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return words[:0]
    by = odd_numbers(k, 31)
    out = words[: len(words) - k + 1] * by[0]
    for j in range(1, k):
        out += words[j : len(words) - k + 1 + j] * by[j]
    return mixed(out)


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest of each window of neighbours (the last of equal ones), each once."""
    places: list[int] = []
    for i in range(max(1, len(grams) - window + 1) if len(grams) else 0):
        part = grams[i : i + window]
        p = i + len(part) - 1 - int(np.argmin(part[::-1]))
        if not places or places[-1] != p:
            places.append(p)
    return places


def _band(template: np.ndarray) -> int:
    return 4 + len(template) // 8


class Index:
    """Inverted index of templates: hash of K words -> (template, place); short templates by word."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW, short: int = SHORT):
        hashes = _hasher()
        self.k = k
        self.words = {name: hashes(text) for name, text in sorted(templates.items())}
        self.at: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.short = {name: words for name, words in self.words.items() if 0 < len(words) < max(short, k)}
        for name, words in self.words.items():
            if len(words) and name not in self.short:
                grams = _grams(words, k)
                for p in winnow(grams, window):
                    self.at[int(grams[p])].append((name, p))
        self.keys = np.array(sorted(self.at), np.uint64)
        self.vocabulary = np.unique(np.concatenate([*self.short.values(), np.zeros(0, np.uint64)]))
        #: For each short template the places of each word of the vocabulary, as bits.
        self.bits = {name: np.bitwise_or.reduce(np.where(self.vocabulary[:, None] == words, 1 << np.arange(len(words)), 0), axis=1) for name, words in self.short.items()}

    def hits(self, words: np.ndarray) -> dict[str, list[int]]:
        """For each template of the grams the offsets (document place less template place) of its hits."""
        out: dict[str, list[int]] = defaultdict(list)
        grams = _grams(words, self.k)
        if len(grams) and len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            for p in np.flatnonzero(self.keys[slot] == grams).tolist():
                for name, q in self.at[int(grams[p])]:
                    out[name].append(p - q)
        return out

    def short_places(self, words: np.ndarray, min_coverage: float) -> Iterator[tuple[str, int, int]]:
        """(template, least and greatest offset) where enough of a short template's words have offsets within its band."""
        if not len(words) or not len(self.vocabulary):
            return
        slot = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[slot] == words)
        slot = slot[at]
        for name, template in self.short.items():
            m, band = len(template), _band(template)
            need = next(n for n in range(1, m + 2) if n >= min_coverage * m)
            bits = self.bits[name][slot]
            some = bits > 0
            p, bits = at[some], bits[some]
            if len(p) < need:
                continue
            # words of a place lie close together: runs of hits that are too thin are left out
            dense = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] < m + band)
            if not len(dense):
                continue
            near = np.zeros(len(p) + 1, np.int64)
            np.add.at(near, dense, 1)
            np.add.at(near, dense + need, -1)
            near = np.cumsum(near[:-1]) > 0
            masks: dict[int, int] = defaultdict(int)
            for place, b in zip(p[near].tolist(), bits[near].tolist(), strict=True):
                for q in range(m):
                    if b >> q & 1:
                        masks[place - q] |= 1 << q
            offsets, end = sorted(masks), 0
            for i, lo in enumerate(offsets):
                last = end
                while end < len(offsets) and offsets[end] - lo <= band:
                    end += 1
                if end == last:
                    continue  # all of these offsets were in the window before
                union = 0
                for o in offsets[i:end]:
                    union |= masks[o]
                if union.bit_count() >= need:
                    yield name, lo, offsets[end - 1]


def align(template: np.ndarray, words: np.ndarray, offset: int, band: int) -> tuple[int, int, int]:
    """(matched, first, last place in words) of the best alignment of the whole template whose offset from it stays within
    the band. A match earns 3, a mismatch or a skipped word costs 1; what precedes and follows in words is free."""
    m, n, width = len(template), len(words), 2 * band + 1
    score, trace = np.zeros(width, np.int64), np.zeros((m + 1, width), np.int8)
    lanes = np.arange(width)
    for i in range(1, m + 1):
        place = i - 1 + offset - band + lanes  # the document word that lane d pairs with template word i
        inside = (place >= 0) & (place < n)
        same = np.zeros(width, bool)
        same[inside] = words[place[inside]] == template[i - 1]
        pair = np.where(inside, score + np.where(same, 3, -1), -(10**9))
        skip_t = np.r_[score[1:], -(10**9)] - 1  # template word without a partner: one lane back
        best = np.maximum(pair, skip_t)
        step = np.where(pair >= skip_t, 1, 2)
        # skipped document words run along the lanes
        run = np.maximum.accumulate(best + lanes) - lanes
        trace[i] = np.where(run > best, 3, step)
        score = run
    d, i, places = int(np.argmax(score)), m, []
    while i > 0:
        how = trace[i, d]
        place = i - 1 + offset - band + d
        if how == 1:
            if 0 <= place < n and words[place] == template[i - 1]:
                places.append(place)
            i -= 1
        elif how == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return (len(places), places[-1], places[0]) if places else (0, 0, 0)


def matches(index: Index, text: str, words: np.ndarray, min_coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) in code points, not overlapping, by start."""
    found = []
    for name, lo, hi in index.short_places(words, min_coverage):
        matched, first, last = align(index.words[name], words, (lo + hi) // 2, _band(index.words[name]))
        if matched >= min_coverage * len(index.words[name]):
            found.append((-matched, -matched / len(index.words[name]), name, first, last))
    for name, offsets in index.hits(words).items():
        template = index.words[name]
        band = _band(template)
        offsets.sort()
        groups = [[offsets[0], offsets[0]]]
        for o in offsets[1:]:
            if o - groups[-1][0] <= band:
                groups[-1][1] = o
            else:
                groups.append([o, o])
        for lo, hi in groups:
            matched, first, last = align(template, words, (lo + hi) // 2, band)
            if matched >= min_coverage * len(template):
                found.append((-matched, -matched / len(template), name, first, last))
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[str, float, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for matched, coverage, name, first, last in sorted(found):
        if all(last < a or b < first for a, b in taken):
            taken.append((first, last))
            out.append((name, -coverage, -matched, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda x: x[3])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each match: key, license, coverage, matched_words, start_at, end_at. templates: name to text, None for the own catalogue."""
    index = Index(TEMPLATES if templates is None else templates)

    def make():
        hashes = _hasher()

        def work(texts: list) -> tuple[list, list]:
            at, rows = [], []
            for i, t in enumerate(texts):
                for m in matches(index, t, hashes(t), min_coverage) if t else ():
                    at.append(i)
                    rows.append(m)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            return at, [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else ([],) * 5, kinds, strict=True)]

        return work

    return in_batches(docs, make, text, "license string, coverage double, matched_words long, start_at long, end_at long", [key])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
