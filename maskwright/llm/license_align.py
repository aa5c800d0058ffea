"""License scans by patience alignment of a text's words with license templates.

Words are runs of a-z and 0-9 after lower-casing. Coverage is the share of the
template's words that are aligned, density the share of the aligned stretch of the
text. A hit is a stretch with coverage and density at the thresholds, so it is at most
template length / density long.

1. Seeds: from left to right, the stretch that ends first among those whose longest
   common subsequence with the template reaches the thresholds, and its last start;
   the next seed begins after it. No choice of disjoint stretches has more. Ends are
   tried only where enough of the template's words, each as often as the template has
   it, stand within a hit's length.
2. A seed's window reaches from the previous hit to the next seed, a hit's length at
   most. Within it: matching words at both ends are taken, then words that are unique
   both to the window and to the template are anchors; the longest increasing
   subsequence of their places keeps those in order, and the gaps between them are
   aligned in the same way.
3. Where that aligns fewer words than the window's longest common subsequence has, or
   misses a threshold, the stretches of the window are compared one by one.

Each seed gives one hit. Null and empty texts have no hits; ties between stretches go
to the first; repeated rows give repeated hits; an empty table gives no rows. Columns
other than the id and the text are not read. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from maskwright.llm.common import documents_of

# Public license notices ------------------------------------------
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
LEAST_COVERAGE, LEAST_DENSITY = 0.85, 0.7

_WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(place)
            piles.append(i)
        else:
            tops[pile], piles[pile] = place, i
    found = []
    i = piles[-1] if piles else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words of a and b, in order in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _unique(a, a0, a1), _unique(b, b0, b1)
        both = [(i, in_b[word]) for word, i in in_a.items() if word in in_b]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        pairs += anchors
        last_a, last_b = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
    return sorted(pairs)


def _unique(x: list[str], first: int, end: int) -> dict[str, int]:
    """The places of words that occur once, by place."""
    seen: dict[str, int] = {}
    for i in range(first, end):
        seen[x[i]] = -1 if x[i] in seen else i
    return {word: i for word, i in seen.items() if i >= 0}


def common(masks: dict[str, int], length: int, text: Iterator[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """(place, length of the longest common subsequence up to it) wherever that grows.

    ``masks`` has a bit for each place of a word among the ``length`` of the template."""
    full = open_ = (1 << length) - 1
    matched = 0
    for place, word in text:
        met = open_ & masks.get(word, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
        if (now := length - open_.bit_count()) > matched:
            matched = now
            yield place, matched


def _masks(template: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, word in enumerate(template):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


class Scanner:
    """Aligns texts with all templates; texts that share few words are passed over."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words(text) for name, text in templates.items()}
        self.counts = {name: Counter(x) for name, x in self.templates.items()}
        self.sets = {name: frozenset(x) for name, x in self.templates.items()}
        self.all = frozenset().union(*self.sets.values()) if self.sets else frozenset()

    def hits(self, text: str, least_coverage: float, least_density: float) -> Iterator[tuple[str, float, float, int, int, int]]:
        """(template, coverage, density, first word, end word, matched) of each copy."""
        own = words(text)
        shared = self.all.intersection(own)
        for name, template in self.templates.items():
            wanted = self.sets[name] & shared
            # each aligned word is in the set; the rest of the template is missing
            if not wanted or len(self.sets[name]) - len(wanted) > (1 - least_coverage) * len(template):
                continue
            size = len(template)
            least = next((n for n in range(1, size + 1) if n / size >= least_coverage), size + 1)
            longest = int(size / least_density) + 1 if least_density > 0 else len(own)
            places = [i for i, word in enumerate(own) if word in wanted]
            seeds = list(self._seeds(own, places, name, least, longest, least_density))
            done = 0
            for k, (start, end) in enumerate(seeds):
                first = max(done, end - longest)
                limit = min(seeds[k + 1][0] if k + 1 < len(seeds) else len(own), start + longest)
                coverage, density, low, high, matched = self._best(own[first:limit], template, least, least_density)
                low, done = low + first, high + first
                yield name, coverage, density, low, done, matched

    def _seeds(self, own: list[str], places: list[int], name: str, least: int, longest: int, least_density: float) -> Iterator[tuple[int, int]]:
        """(last start, end) of disjoint stretches at the thresholds, each ending first."""
        counts, size, masks = self.counts[name], len(self.templates[name]), _masks(self.templates[name][::-1])
        first = held = 0
        bag: Counter[str] = Counter()
        for k, place in enumerate(places):
            word = own[place]
            bag[word] += 1
            held += bag[word] <= counts[word]
            while places[first] <= place - longest:
                gone = own[places[first]]
                held -= bag[gone] <= counts[gone]
                bag[gone] -= 1
                first += 1
            if held < least:
                continue
            backwards = ((i, own[i]) for i in places[first : k + 1][::-1])
            for start, matched in common(masks, size, backwards):
                if matched >= least and matched / (place + 1 - start) >= least_density:
                    yield start, place + 1
                    bag.clear()
                    first, held = k + 1, 0
                    break

    @classmethod
    def _best(cls, window: list[str], template: list[str], least: int, least_density: float) -> tuple[float, float, int, int, int]:
        """The alignment of a window that holds a stretch at the thresholds."""
        found = [x for x in (cls._aligned(window, template), cls._mirrored(window, template)) if x[4] >= least and x[1] >= least_density]
        most = max((n for _, n in common(_masks(template), len(template), enumerate(window))), default=0)
        if not found or max(found)[4] < most:
            found.append(cls._compared(window, template, least, least_density))
        return max(found)

    @staticmethod
    def _compared(window: list[str], template: list[str], least: int, least_density: float) -> tuple[float, float, int, int, int]:
        """The stretch with most common words, then the shortest, then the first."""
        masks, size = _masks(template), len(template)
        best = (0, 0.0, 0, 0)
        for low, word in enumerate(window):
            if word in masks:
                for place, matched in common(masks, size, ((i, window[i]) for i in range(low, len(window)))):
                    density = matched / (place + 1 - low)
                    if matched >= least and density >= least_density and (matched, density) > best[:2]:
                        best = (matched, density, low, place + 1)
        matched, density, low, high = best
        return matched / size, density, low, high, matched

    @staticmethod
    def _aligned(window: list[str], template: list[str]) -> tuple[float, float, int, int, int]:
        """coverage, density, first and end of the aligned stretch, aligned words."""
        pairs = align(window, template)
        if not pairs:
            return 0.0, 0.0, 0, 0, 0
        low, high = pairs[0][0], pairs[-1][0] + 1
        return len(pairs) / len(template), len(pairs) / (high - low), low, high, len(pairs)

    @classmethod
    def _mirrored(cls, window: list[str], template: list[str]) -> tuple[float, float, int, int, int]:
        """The same from the end: a word before the notice may equal its first."""
        coverage, density, low, high, matched = cls._aligned(window[::-1], template[::-1])
        return coverage, density, len(window) - high, len(window) - low, matched


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least_coverage: float = LEAST_COVERAGE, least_density: float = LEAST_DENSITY) -> DataFrame:
    """(doc_id, template, coverage, density, first_word, end_word, matched) of each hit."""
    docs = documents_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                for hit in scanner.hits(text.as_py(), least_coverage, least_density):
                    rows.append(row)
                    found.append(hit)
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["doc_id", "template", "coverage", "density", "first_word", "end_word", "matched"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template string, coverage double, density double, first_word bigint, end_word bigint, matched bigint"
    return docs.mapInArrow(run, schema)
