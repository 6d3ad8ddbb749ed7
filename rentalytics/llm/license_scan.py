"""License scans: winnowed fingerprints pick candidates, alignment confirms them.

The templates' word K-grams are winnowed into an inverted index (hash ->
template, place).  A document's own winnowed hashes look up templates and
diagonals; around each diagonal a banded local alignment of the template's
words with the document's gives the matched words, their share of the
template and the span in the document.

Neighbouring licences differ in a few words only (versions, NC, SA, Affero),
so besides its share of words a template has deciding runs of words that the
alignment must match each and unbroken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .shingles import mixed, word_hashes

K = 3
# A shared run of K + WINDOW - 1 = 4 words always shares a fingerprint, and with a fifth of
# 16 words or more replaced or left out such a run remains.
WINDOW = 2
BAND = 8
LEAST_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
NOTHING = (0, 0, 0, 0, None)  # an alignment's score, matched words, first and end word, and the pairs matched
BATCH_BYTES = 4 << 20

# Notices and license texts, as published.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
}
# Per template the runs of words that must be equal and unbroken; where none is named, the coverage alone decides.
DECIDING: dict[str, tuple[str, ...]] = {
    "MIT-notice": ("MIT License",),
    "Apache-2.0-notice": ("Apache License Version 2.0",),
    "Apache-2.0": ("Apache License Version 2.0",),
    "MPL-2.0": ("Mozilla Public License v. 2.0",),
    "ISC": ("copyright notice and this permission notice appear in all copies",),
}

# The further clauses of the BSD licences.
_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_ADVERTISING = """All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization."""
TEMPLATES["BSD-3-Clause"] = f"{TEMPLATES['BSD-2-Clause']} {_NAMES}"
TEMPLATES["BSD-4-Clause"] = f"{TEMPLATES['BSD-2-Clause']} {_ADVERTISING} {_NAMES}"
DECIDING["BSD-3-Clause"] = ("endorse or promote products derived from this software",)
DECIDING["BSD-4-Clause"] = ("advertising materials mentioning features or use of this software must display the following",
                            *DECIDING["BSD-3-Clause"])

# The GNU licences; the header of GPL-3.0 with their names and versions, "or later" and for one version.
for _name, _kind, _version in (
        ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")):
    _header = " ".join(TEMPLATES["GPL-3.0"].split()).replace("GNU General Public License", _kind)
    _later = "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    TEMPLATES[f"{_name}-notice"] = f"This work is licensed under the {_kind}, version {_version}."
    TEMPLATES[f"{_name}-only"] = _header.replace(_later, f"version {_version} as published by the Free Software Foundation.")
    if _name != "GPL-3.0":
        TEMPLATES[_name] = _header.replace(_later, _later.replace("version 3", f"version {_version}"))
    DECIDING[f"{_name}-notice"] = (f"{_kind} version {_version}",)
    DECIDING[f"{_name}-only"] = (f"{_kind} version {_version} as published",)
    DECIDING[_name] = (f"{_kind} as published", f"version {_version}")

# The Creative Commons licences' names.
for _kind, _name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _law in (("4.0", "International"), ("3.0", "Unported")):
        _title = f"{_name if _version == '4.0' else _name.replace('NoDerivatives', 'NoDerivs')} {_version} {_law}"
        TEMPLATES[f"CC-{_kind}-{_version}-notice"] = f"Licensed under CC {_kind} {_version}."
        TEMPLATES[f"CC-{_kind}-{_version}"] = f"This work is licensed under a Creative Commons {_title} License."
        DECIDING[f"CC-{_kind}-{_version}-notice"] = (f"CC {_kind} {_version}",)
        DECIDING[f"CC-{_kind}-{_version}"] = (_title,)

# Further notices and texts, as published.
TEMPLATES["CC0-1.0"] = """To the extent possible under law, the author has waived all copyright and related or neighboring
rights to this work."""
TEMPLATES["EPL-2.0"] = """This program and the accompanying materials are made available under the terms of the Eclipse
Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
TEMPLATES["BSL-1.0"] = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of
the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following:"""
TEMPLATES["Zlib"] = """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
DECIDING["CC0-1.0"] = ("waived all copyright and related",)
DECIDING["EPL-2.0"] = ("Eclipse Public License 2.0",)

# Identifiers that tags name.
for _name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", "EPL-2.0", "BSL-1.0", "Zlib",
              "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
              "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"):
    TEMPLATES[f"{_name}-tag"] = f"SPDX-License-Identifier: {_name}"
    DECIDING[f"{_name}-tag"] = (TEMPLATES[f"{_name}-tag"],)

# Punctuation separates words: its bytes are read as spaces.
_PLAIN = np.arange(256, dtype=np.uint8)
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _PLAIN[_c] = 32
_FACTORS = np.array([pow(0xDA942042E4DD58B5, i + 1, 1 << 64) for i in range(K)], np.uint64)


def fingerprints(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed K-gram hashes of texts (whose words begin at ``firsts``) and
    the place of each: in every WINDOW K-grams in a row the smallest, the last of equals."""
    n = max(len(words) - K + 1, 0)
    sums = np.zeros(n, np.uint64)
    for place in range(K):
        sums += words[place:place + n] * _FACTORS[place]
    grams = mixed(sums)
    text = np.searchsorted(firsts, np.arange(n), "right")
    whole = np.arange(n) + K <= np.append(firsts, len(words))[text]  # K-grams do not cross texts
    picked = np.zeros(n, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    if n:
        pad = np.full(WINDOW - 1, top, np.uint64)
        value = np.concatenate([pad, np.where(whole, grams, top), pad])
        owner = np.concatenate([np.full(WINDOW - 1, -1), text, np.full(WINDOW - 1, -1)])
        place = np.arange(n)
        # Place i is picked if in some window of its text that holds i it is smallest and last of equals.
        for back in range(WINDOW):
            wins = whole.copy()
            for step in range(-back, WINDOW - back):
                if step == 0:
                    continue
                other = place + step + WINDOW - 1
                same = owner[other] == text
                smaller = value[other] < grams if step < 0 else value[other] <= grams
                wins &= ~(same & smaller)
            picked |= wins
    at = np.flatnonzero(picked)
    return grams[at], at


def _words(data: np.ndarray, offsets: np.ndarray):
    return word_hashes(_PLAIN[data], offsets)


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


@dataclass(frozen=True)
class Match:
    template: str
    start: int  # words of the document, end exclusive
    end: int
    matched: int
    coverage: float


def align(template: np.ndarray, doc: np.ndarray, diagonal: int) -> tuple[int, int, int, dict[int, int]]:
    """Best local alignment of the template with ``doc`` (word hashes) within
    BAND of a diagonal (document place minus template place): matched words,
    first and end word in the document, and the document's place of each
    matched word of the template."""
    width = 2 * BAND + 1
    # Cell (i, b) pairs template word i with document word i + diagonal + b - BAND.
    above = [NOTHING] * width
    best = NOTHING
    for i, word in enumerate(template.tolist()):
        row, left = [], NOTHING
        for b in range(width):
            j = i + diagonal + b - BAND
            cell = NOTHING
            if 0 <= j < len(doc):
                score, matched, first, end, pairs = above[b]
                if doc[j] == word:
                    cell = (score + MATCH, matched + 1, first if matched else j, j + 1, (pairs, i, j))
                elif score + MISMATCH > 0:
                    cell = (score + MISMATCH, matched, first, end, pairs)
                for score, matched, first, end, pairs in (above[b + 1] if b + 1 < width else NOTHING, left):
                    if score + GAP > cell[0]:
                        cell = (score + GAP, matched, first, end, pairs)
                best = max(best, cell, key=lambda c: (c[0], -c[2]))
            row.append(cell)
            left = cell
        above = row
    places, pairs = {}, best[4]
    while pairs is not None:
        pairs, i, j = pairs
        places[i] = j
    return best[1], best[2], best[3], places


class Index:
    """Inverted index of the templates' fingerprints; ``deciding`` runs that a template does not have are left out."""

    def __init__(self, templates: dict[str, str], deciding: dict[str, tuple[str, ...]] = DECIDING):
        self.names = list(templates)
        self.words, self.deciding, hashes, owners, places = [], [], [], [], []
        for number, (name, text) in enumerate(templates.items()):
            words = _hashed(text)
            self.words.append(words)
            runs = [_hashed(run) for run in deciding.get(name, ())]
            firsts = [(place, place + len(run)) for run in runs for place in range(len(words) - len(run) + 1)
                      if np.array_equal(words[place:place + len(run)], run)]
            self.deciding.append(firsts)
            got, at = fingerprints(words, np.array([0]))
            hashes.append(got)
            owners.append(np.full(len(got), number))
            places.append(at)
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes, self.owners, self.places = (np.concatenate(v)[order] for v in (hashes, owners, places))
        # The longest deciding run of each template: its words -> (template, place in it).
        self.runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for number, firsts in enumerate(self.deciding):
            if firsts:
                a, b = max(firsts, key=lambda run: run[1] - run[0])
                run = tuple(self.words[number][a:b].tolist())
                self.runs.setdefault(run, []).extend((number, c) for c, d in firsts
                                                     if np.array_equal(self.words[number][c:d], run))
        self.run_starts = np.array(sorted({run[0] for run in self.runs}), np.uint64)

    def run_hits(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, template, diagonal) of every deciding run that is unbroken in a text."""
        near = np.flatnonzero(np.isin(words, self.run_starts))
        text = np.searchsorted(firsts, near, "right") - 1
        first, end = firsts[text], firsts[text + 1]
        for run, owners in self.runs.items():
            here = np.flatnonzero((words[near] == np.uint64(run[0])) & (near + len(run) <= end))
            for step, word in enumerate(run[1:], 1):
                here = here[words[near[here] + step] == np.uint64(word)]
            for template, place in owners:
                yield from zip(text[here].tolist(), [template] * len(here), (near[here] - first[here] - place).tolist(), strict=True)

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``found``, posting) of equal hashes."""
        low, high = (np.searchsorted(self.hashes, found, side) for side in ("left", "right"))
        counts = high - low
        which = np.repeat(np.arange(len(found)), counts)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]

    def possible(self, template: int, doc: np.ndarray, diagonal: int) -> bool:
        """False if the words in reach of the band cannot give a match: too few of the template, or not all deciding ones."""
        words = self.words[template]
        there = np.isin(words, doc[max(diagonal - BAND, 0):max(diagonal + len(words) + BAND, 0)])
        return there.sum() >= LEAST_COVERAGE * len(words) and all(there[a:b].all() for a, b in self.deciding[template])

    def decided(self, template: int, places: dict[int, int]) -> bool:
        """Whether every deciding run is matched word by word with nothing between."""
        return all(i in places and places[i] == places.get(a, -1) + i - a
                   for a, b in self.deciding[template] for i in range(a, b))

    def matches(self, doc: np.ndarray, candidates: set[tuple[int, int]]) -> list[Match]:
        """Confirmed matches of a document from its (template, diagonal)
        candidates; of overlapping ones the one with most matched words."""
        found, last = set(), (-1, 0)
        for template, diagonal in sorted(candidates):
            if template == last[0] and diagonal - last[1] <= BAND // 2:
                continue  # within the band of the alignment before
            last = (template, diagonal)
            words = self.words[template]
            parts = [(0, len(doc))]
            while parts:  # a short notice may stand in the band more than once: the words before and after one are searched again
                low, high = parts.pop()
                if not self.possible(template, doc[low:high], diagonal - low):
                    continue
                matched, first, end, places = align(words, doc[low:high], diagonal - low)
                if matched < LEAST_COVERAGE * len(words):
                    continue
                if self.decided(template, places):
                    found.add(Match(self.names[template], low + first, low + end, matched, matched / len(words)))
                parts += [(low, low + first), (low + end, high)]
        kept: list[Match] = []  # by start; they do not overlap, so only the neighbours of a place can
        for m in sorted(found, key=lambda m: (-m.matched, m.start, m.template)):
            at = bisect_left(kept, m.start, key=lambda o: o.start)
            if (at == 0 or kept[at - 1].end <= m.start) and (at == len(kept) or m.end <= kept[at].start):
                kept.insert(at, m)
        return kept

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[Match, int, int]]]:
        """Per text its matches with their first and end place in code points."""
        words, starts, ends, firsts = _words(data, offsets)
        found, at = fingerprints(words, firsts[:-1])
        which, posting = self.hits(found)
        doc = np.searchsorted(firsts, at[which], "right") - 1
        diagonals = at[which] - firsts[doc] - self.places[posting]
        candidates: dict[int, set[tuple[int, int]]] = {}
        for d, template, diagonal in zip(doc.tolist(), self.owners[posting].tolist(), diagonals.tolist(), strict=True):
            candidates.setdefault(d, set()).add((template, diagonal))
        for d, template, diagonal in self.run_hits(words, firsts):
            candidates.setdefault(d, set()).add((template, diagonal))
        out: list[list[tuple[Match, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for d, own in candidates.items():
            base = int(firsts[d])
            confirmed = self.matches(words[base:firsts[d + 1]], own)
            if not confirmed:
                continue
            # Code points before each byte of the text: bytes that go on with a character do not count.
            points = np.cumsum((data[offsets[d]:offsets[d + 1]] & 0xC0) != 0x80)
            for m in confirmed:
                a, b = int(starts[base + m.start] - offsets[d]), int(ends[base + m.end - 1] - offsets[d])
                out[d].append((m, int(points[a]) - 1, int(points[b - 1])))
        return out


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_licenses, licenses (distinct
    names, in order) and spans (name:start:end:matched percent of the
    template, code points, by start).

    Whole texts are scanned; null and empty texts have no match; repeated
    rows are reported each.  Templates need K words at least.
    """
    chosen = dict(templates or TEMPLATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in common.sized_batches(batches, "text", BATCH_BYTES):
            found = index.scan(*common.text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([",".join(dict.fromkeys(m.template for m, *_ in f)) for f in found], pa.string()),
                 pa.array([",".join(f"{m.template}:{a}:{b}:{m.coverage:.0%}" for m, a, b in f) for f in found], pa.string())],
                ["doc_id", "n_licenses", "licenses", "spans"])

    return common.small_batches(docs).select("doc_id", "text").mapInArrow(scan, "doc_id long, n_licenses long, licenses string, spans string")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(common.table(spark, sf_dir, "documents"))
