"""License notices by winnowed fingerprints and banded alignment.

Words are compared lower-cased and without punctuation. Every run of ``GRAM`` words is hashed, and of every ``SLIDE`` consecutive
hashes the smallest is a fingerprint, so a shared run of ``GRAM + SLIDE - 1`` words always shares one. Of a template so short that a
match might leave no fingerprint, every hash is one (a match without any common run of GRAM words is not found). An inverted index of the
templates' fingerprints (a few kilobytes, broadcast) proposes places; nearby ones on nearby diagonals are one candidate if they
are as many as a match must leave (a missing word spoils GRAM fingerprints at most, a word between two others one fewer). A
banded alignment of the template against the text around it finds template words in order; the share of them is the coverage,
and the first and last of them give the span. Words in the span that the template lacks are ``inserted`` and count against it:
``matched / (words + inserted)`` must reach the threshold, and the alignment found is the one that exceeds it most.

Names and versions tell licenses apart, however alike the rest is: a template's words marked with ``*`` must stand in the span in
their order, and no marked word of a template with common wording may stand there that this one lacks.

Documents are scanned where they are read: one map, no shuffle, whatever notice a third of all documents carry.

Defined results: null and empty texts hold no notice; words of punctuation only (comment marks) are passed over; of overlapping
matches the one with more matched words stays (then fewer inserted, then higher coverage, then the first name); a notice whose
marked words are missing is none of that license; repeated rows each get theirs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.words import LOWER_BYTES, encode_words, rolling, text_chunks, word_hashes

GRAM, SLIDE = 3, 2
# The wordings of public licenses. A word that starts with * tells a license from those with similar wordings.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
MIT_KEEP = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or *substantial portions of the Software."
MIT_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_KEEP = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or promote products derived from this software "
    "without specific prior written permission."
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = "provided that the above copyright notice and this permission notice *appear in all copies."
ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
APACHE = (
    'Licensed under the *Apache License, Version *2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)
MPL = "This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2.0"
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
    "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
    "not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
GNU = {"GPL": ("", ("1", "2", "3")), "LGPL": ("*Lesser ", ("2.1", "3")), "AGPL": ("*Affero ", ("3",))}
CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_COMMONS_PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def gnu_wordings() -> dict[str, list[str]]:
    """Notices of the GNU licenses: headers and one-line forms, by family and version; without a version, the family alone."""
    out: dict[str, list[str]] = {}
    for family, (kind, versions) in GNU.items():
        name = f"*GNU {kind}General Public License"
        published = f"under the terms of the {name} as published by the Free Software Foundation"
        out[family] = [published]
        for version in versions:
            out[f"{family}-{version if '.' in version else version + '.0'}"] = [
                f"This program is free software: you can redistribute it and/or modify it {published}, either version *{version} of the License, or (at your option) any later version.",
                f"{published}, either version *{version} of the License",
                f"{published}; version *{version}",
                f"licensed under the {name}, version *{version}",
                f"{name}, version *{version}",
                f"{name} version *{version}.0",
            ]
    return out


def creative_commons_wordings() -> dict[str, list[str]]:
    return {
        f"CC-{kind}-{version}": [f"Licensed under *CC *{kind} *{version}", f"licensed under a Creative Commons *{long} *{version} {port} License"]
        for kind, long in CREATIVE_COMMONS.items()
        for version, port in CREATIVE_COMMONS_PORTS.items()
    }


TEMPLATES = {
    "Apache-1.0": ["Licensed under the *Apache License, Version *1.0"],
    "Apache-1.1": ["Licensed under the *Apache License, Version *1.1"],
    "Apache-2.0": ["Licensed under the *Apache License, Version *2.0", APACHE],
    "MIT": ["Released under the *MIT License", "Licensed under the *MIT License", MIT_GRANT[: MIT_GRANT.index(" (the")], f"{MIT_GRANT}, {MIT_KEEP} {MIT_AS_IS}"],
    "MIT-0": [f"{MIT_GRANT}. {MIT_AS_IS}"],
    "BSD": [BSD_GRANT, "Use of this source code is governed by a *BSD-style license"],
    "BSD-2-Clause": [f"{BSD_GRANT}: {BSD_KEEP} {BSD_AS_IS}"],
    "BSD-3-Clause": [f"{BSD_GRANT}: {BSD_KEEP} {BSD_NAMES} {BSD_AS_IS}"],
    **gnu_wordings(),
    "MPL-2.0": [MPL, f"{MPL}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    **creative_commons_wordings(),
    "CC0-1.0": ["dedicated to the public domain under *CC0 *1.0"],
    "ISC": [ISC_GRANT, f"{ISC_GRANT}, {ISC_KEEP} {ISC_AS_IS}"],
    "0BSD": [f"{ISC_GRANT}. {ISC_AS_IS}"],
    "Zlib": [ZLIB],
    "Unlicense": [UNLICENSE],
    "Proprietary": ["All rights reserved", "All rights reserved. No part of this publication may be reproduced"],
}
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_OUT = "id long, license string, coverage double, matched int, inserted int, words int, start long, stop long"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license, coverage, matched, inserted, words, start, stop`` (character offsets) of every notice that reaches ``least``."""
    index = _Index(templates or TEMPLATES, least)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            out, ids = list(_scan(table.column("text").to_pylist(), index, least)), table.column("id").to_pylist()
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = [[ids[m[0]] for m in out], *[[m[i] for m in out] for i in range(1, 8)]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "license", "coverage", "matched", "inserted", "words", "start", "stop"])

    return rows.mapInArrow(run, _OUT)


def bare(vocabulary: list[bytes]) -> list[bytes]:
    return [w.translate(LOWER_BYTES).strip(EDGES) for w in vocabulary]


def winnow(grams: np.ndarray) -> np.ndarray:
    """Whether a hash is the smallest of some window of SLIDE hashes (the only window, if there are fewer)."""
    chosen = np.zeros(len(grams), bool)
    slide = min(SLIDE, len(grams))
    if slide:
        windows = np.lib.stride_tricks.sliding_window_view(grams, slide)
        chosen[np.arange(len(windows)) + windows.argmin(axis=1)] = True
    return chosen


def spoiled(size: int, least: float) -> int:
    """Most runs of GRAM words that the edits of a match can change: GRAM a missing word, one fewer an inserted one."""
    return int(max(GRAM, (GRAM - 1) / least) * (1 - least) * size + 1e-9)


class _Index:
    def __init__(self, templates: dict[str, list[str]], least: float) -> None:
        self.names, self.hashes, self.marked, self.chosen = [], [], [], []
        places, grams_of = [], []
        for name, texts in templates.items():
            for text in texts:
                words = [w for w in text.encode().split() if bare([w])[0]]
                hashes = word_hashes(bare(words))
                grams = rolling(hashes, GRAM)
                fingerprints = np.flatnonzero(winnow(grams))
                if len(fingerprints) <= spoiled(len(hashes), least):
                    fingerprints = np.arange(len(grams))
                places += [(int(grams[i]), len(self.names), int(i)) for i in fingerprints]
                grams_of.append(set(grams.tolist()))
                self.names.append(name)
                self.hashes.append(hashes)
                self.marked.append([int(h) for h, w in zip(hashes, words, strict=True) if w.startswith(b"*")])
                self.chosen.append(len(fingerprints))
        places.sort()
        self.grams = np.array([p[0] for p in places], np.uint64)
        self.postings: dict[int, list] = {}
        for gram, template, at in places:
            self.postings.setdefault(gram, []).append((template, at))
        # Marked words of templates with a common run of GRAM words that the template itself lacks.
        self.foreign = [
            {w for other, grams in enumerate(grams_of) if grams & own for w in self.marked[other]} - set(self.hashes[t].tolist()) for t, own in enumerate(grams_of)
        ]

    def fits(self, template: int, span: list[int]) -> bool:
        """Whether a span holds the template's marked words in order and no foreign one."""
        rest = iter(span)
        return all(word in rest for word in self.marked[template]) and self.foreign[template].isdisjoint(span)


def _scan(texts: list[bytes], index: _Index, least: float) -> Iterator[tuple]:
    codes, counts, vocabulary = encode_words(texts)
    if not len(codes):
        return
    names = bare(vocabulary)
    places = np.flatnonzero(np.array([bool(w) for w in names])[codes])
    hashes = word_hashes(names)[codes][places]
    start = np.cumsum(counts) - counts
    first, ends = np.searchsorted(places, start), np.searchsorted(places, start + counts)
    grams = rolling(hashes, GRAM)
    # The index decides what can match: a text's hash is looked up whether or not it would be chosen there, which finds no less.
    hits = np.flatnonzero(np.isin(grams, index.grams)) if len(index.grams) else np.zeros(0, np.int64)
    owner = np.searchsorted(ends, hits, side="right")
    inside = hits + GRAM <= ends[owner]
    seeds: dict[tuple, list] = {}
    for at, doc in zip(hits[inside].tolist(), owner[inside].tolist(), strict=True):
        for template, place in index.postings[int(grams[at])]:
            seeds.setdefault((doc, template), []).append(at - place)
    found: dict[int, list] = {}
    for (doc, template), diagonals in seeds.items():
        size, reached = len(index.hashes[template]), None
        # What a match may lack or add moves it along the diagonals and spoils fingerprints: see the module's text.
        slack = max(2, int((1 - least) / least * size + 1e-9))
        needed = max(1, index.chosen[template] - spoiled(size, least))
        diagonals = np.sort(diagonals)
        for diagonal in np.unique(diagonals).tolist():
            if reached is not None and diagonal <= reached:
                continue
            reached = diagonal + slack
            if np.searchsorted(diagonals, diagonal + 2 * slack, side="right") - np.searchsorted(diagonals, diagonal) < needed:
                continue
            windows = [(max(int(first[doc]), diagonal - slack), min(int(ends[doc]), diagonal + size + 2 * slack))]
            while windows:
                low, high = windows.pop()
                match = align(index.hashes[template], hashes[low:high], diagonal - slack - low, 3 * slack, round(least * WORTH)) if high - low >= least * size else None
                if match is None:
                    continue
                matched, a, b = match[0], low + match[1], low + match[2]
                inserted = b - a + 1 - matched
                if matched + 1e-9 >= least * (size + inserted):
                    if index.fits(template, hashes[a : b + 1].tolist()):
                        found.setdefault(doc, []).append((-matched, inserted, -matched / size, index.names[template], a, b, size))
                    # The same notice may follow at once.
                    windows += [(low, a), (b + 1, high)]
    for doc, own in found.items():
        spans = None
        taken: list[tuple] = []
        for matched, inserted, coverage, name, a, b, size in sorted(own):
            if all(b < x or y < a for x, y in taken):
                taken.append((a, b))
                spans = spans or word_offsets(texts[doc])
                yield doc, name, -coverage, -matched, inserted, size, spans[places[a] - start[doc]][0], spans[places[b] - start[doc]][1]


#: A matched word's worth in an alignment, and the bits that hold its first word's place.
WORTH, _BITS = 1000, 21


def align(template: np.ndarray, text: np.ndarray, diagonal: int, width: int, gap: int = 0) -> tuple[int, int, int] | None:
    """Best alignment near a diagonal: its number of matched words and its first and last text word.

    A template word found in order is worth WORTH, a text word between two found ones costs ``gap``; of equal alignments the one
    that starts last and ends first counts. Cell (i, j) is in the band if ``0 <= j - i - diagonal <= width``. ``text`` is a
    window of fewer than 2^21 words.
    """
    size = len(text)
    # A cell holds worth and first word as one number; going on along a row costs the same everywhere, so a running maximum finds it.
    cost = (gap << _BITS) * np.arange(size, dtype=np.int64)
    best, row = (0, 0), np.zeros(size, np.int64)
    for i, word in enumerate(template):
        low, high = max(0, i + diagonal), min(size, i + diagonal + width + 1)
        new = np.zeros(size, np.int64)
        if low < high:
            part = row[low:high].copy()
            same = low + np.flatnonzero(text[low:high] == word)
            if len(same):
                head = np.maximum(np.where(same > 0, row[same - 1], 0), same)
                part[same - low] = np.maximum(part[same - low], head + (WORTH << _BITS))
            new[low:high] = np.maximum(np.maximum.accumulate(part + cost[low:high]) - cost[low:high], 0)
            at = int(new.argmax())
            best = max(best, (int(new[at]), -at))
        row = new
    worth, start, end = best[0] >> _BITS, best[0] & ((1 << _BITS) - 1), -best[1]
    return ((worth + gap * (end - start + 1)) // (WORTH + gap), start, end) if worth else None


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    import re

    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text.decode())]
