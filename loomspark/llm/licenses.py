"""License scans: known notices in texts, with the share of each that matched and where.

Templates are fingerprinted by winnowing: of every WINNOW words in a row the one with the least hash is kept, and an
inverted index maps kept words to the templates that they are of. Fingerprints are of one word each: whichever words of a
notice are changed, added or lost, its other words still stand in order, while longer fingerprints can all be broken. Of
every WINNOW words one is kept, so a text that matches a template at the least coverage can lack only so many of its
fingerprints: it is a candidate where a text, and then a diagonal (the place where the template's first word would
stand) with its band, has enough of them. So no text that reaches the coverage is passed over. What is left is bounded
by how many words of the template have an equal one in the band, then aligned word by word in the band around the
diagonal, so words may be changed, missing or added; what is matched gives the coverage, its first and last words give
the span. Matches of a template that reach the least coverage are reported, best first; the words of one are not used for
another of the same template, and what is left beside it is aligned again, so occurrences that stand close together are
all reported.

The index holds the templates alone, so it goes along with the task's code. Words are runs of ASCII letters and digits
and of all above U+007F, A-Z lower-cased. Spans are code points, ends exclusive. Whole texts are scanned, a few MB at a
time; work grows with a text's length and matches, not with their product. Of equal alignments the first place counts. A
null or empty text has no matches. Equal rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import WordHash, doc_id, keyed, slices

BAND = 6
COVERAGE = 0.7
WINNOW = 3
_ROWS = 4096  # diagonals bounded at a time

#: Notices as they are written beside licensed work.
TEMPLATES: dict[str, str] = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "artistic-2.0": "You may use, copy, modify and distribute this program under the terms of the Artistic License 2.0.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "cddl-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "eupl-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
    "gfdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-line": "Released under the MIT License",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "odbl-1.0": "This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License.",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl": "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def winnowed(hashes: np.ndarray, window: int = 3) -> np.ndarray:
    """The places of fingerprints: of each window of hashes the last of the least ones (all are one window if fewer)."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(seen)) + window - 1 - seen.argmin(1))


@dataclass
class Index:
    names: list[str]
    words: list[list[bytes]]
    marks: np.ndarray  # hashes of all words of templates, sorted
    has: np.ndarray  # (templates, marks): how many fingerprints of a template are of a word
    places: list[np.ndarray]  # the mark of each word of a template
    needed: list[int]  # how many fingerprints a match of the least coverage holds, at least
    coverage: float

    @classmethod
    def of(cls, templates: dict[str, str], coverage: float = COVERAGE) -> Index:
        known, names, words = WordHash(), [], []
        for name, text in sorted(templates.items()):
            ws = words_of(text.encode())
            if ws:
                names.append(name)
                words.append(ws)
        hashes = [known.of(ws) for ws in words]
        marks = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        places = [np.searchsorted(marks, h) for h in hashes]
        # The narrowest windows that keep a word beyond those that a match may lack; all words where none do.
        kept, needed = [], []
        for h, p in zip(hashes, places):
            lacking = len(h) - math.ceil(max(1, coverage * len(h)))
            at = next((w for w in (winnowed(h, n) for n in (WINNOW, 2)) if len(w) > lacking), np.arange(len(h)))
            kept.append(p[at])
            needed.append(len(at) - lacking)
        has = np.array([np.bincount(p, minlength=len(marks)) for p in kept]).reshape(len(names), len(marks))
        return cls(names, words, marks, has, places, needed, coverage)

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        """The mark of each word of a text, -1 for words of no template."""
        if not len(self.marks):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.marks, hashes), len(self.marks) - 1)
        return np.where(self.marks[at] == hashes, at, -1)

    def least(self, t: int) -> float:
        """The words to be matched of a template; one at least."""
        return max(1, self.coverage * len(self.words[t]))

    def padded(self, t: int, marks: np.ndarray) -> np.ndarray:
        """marks with room for the bands of all diagonals from -size on; word i stands at size + BAND + i."""
        size = len(self.words[t])
        return np.concatenate([np.full(size + BAND, -1), marks, np.full(size + 2 * BAND, -1)])

    def bounds(self, t: int, padded: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
        """How many words of a template have an equal one within the band of each diagonal."""
        size = len(self.words[t])
        seen = np.lib.stride_tricks.sliding_window_view(padded, size + 2 * BAND)[diagonals + size]
        out = np.zeros((len(diagonals), size), bool)
        for o in range(2 * BAND + 1):
            out |= seen[:, o : o + size] == self.places[t]
        return out.sum(1)

    def candidates(self, marks: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """For templates worth an alignment, (bound, diagonal) of all whose band can hold a match of the least coverage:
        with enough of the template's fingerprints first, then with enough of its words in place."""
        found = np.bincount(marks[marks >= 0], minlength=len(self.marks))
        enough = np.minimum(self.has, found).sum(1)
        out = []
        for t, size in enumerate(map(len, self.words)):
            if enough[t] < self.needed[t]:
                continue
            own = np.append(self.has[t] > 0, False)[marks]
            run = np.concatenate([np.zeros(size + BAND + 1, np.int64), np.cumsum(own), np.full(size + 2 * BAND, own.sum())])
            # Fingerprints of the template in the text that each diagonal's band covers, from diagonal -size on.
            count = run[size + 2 * BAND :] - run[: -size - 2 * BAND]
            near = np.flatnonzero(count >= self.needed[t]) - size
            padded, places = self.padded(t, marks), []
            for i in range(0, len(near), _ROWS):
                n = self.bounds(t, padded, near[i : i + _ROWS])
                places += [(int(n[j]), int(near[i + j])) for j in np.flatnonzero(n >= self.least(t))]
            if places:
                out.append((t, places))
        return out


def aligned(template: list[bytes], words: list[bytes | None], diagonal: int, band: int = BAND, least: float = 0) -> tuple[int, int, int]:
    """(matched words, first word, end word) of the best local alignment within band of the diagonal, of those with the
    least matched words: a match is worth 2, a changed, missing or added word costs 1. Of equal scores the one
    with more matches counts. No alignment crosses a None. first == end where nothing matches."""
    best, result, prev = (0, 0), (0, 0, 0), {}
    for i, a in enumerate(template):
        cur = {}
        lo, hi = max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)
        for j in range(lo, hi):
            if words[j] is None:
                continue
            same = a == words[j]
            ways = [(0, 0, j)]  # score, matched, first word
            s, m, f = prev.get(j - 1, (0, 0, j))
            ways.append((s + (2 if same else -1), m + same, f if s else j))
            if j in prev:
                s, m, f = prev[j]
                ways.append((s - 1, m, f))
            if j - 1 in cur:
                s, m, f = cur[j - 1]
                ways.append((s - 1, m, f))
            cur[j] = top = max(ways, key=lambda x: (x[0], x[1], -x[2]))
            if top[:2] > best and top[1] >= least:
                best, result = top[:2], (top[1], top[2], j + 1)
        prev = cur
    return result


def occurrences(index: Index, t: int, words: list[bytes], marks: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched words, first word, end word) of a template's matches, none of which overlap: the best alignment is taken
    first, then the best of what the words left allow."""
    left, padded, least, out = list(words), index.padded(t, marks), index.least(t), []
    at = len(index.words[t]) + BAND
    # (-matched words, 0, first, end, diagonal) of an alignment; (-bound, 1, diagonal, 0, diagonal) of a place.
    queue = [(-n, 1, d, 0, d) for n, d in places]
    heapq.heapify(queue)
    while queue:
        n, place, first, end, d = heapq.heappop(queue)
        if not place and None not in left[first:end]:
            out.append((-n, first, end))
            left[first:end] = [None] * (end - first)
            padded[at + first : at + end] = -1
        bound = int(index.bounds(t, padded, np.array([d]))[0]) if out else -n
        if bound < least:
            continue
        if not place or bound < -n:
            heapq.heappush(queue, (-bound, 1, d, 0, d))
            continue
        m, first, end = aligned(index.words[t], left, d, least=least)
        if m >= least:
            heapq.heappush(queue, (-m, 0, first, end, d))
    return out


def matches(index: Index, text: bytes, known: WordHash) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of reported matches, by start."""
    words = words_of(text)
    if not words:
        return []
    marks = index.marked(known.of(words))
    kept = [(n / len(index.words[t]), t, first, end) for t, places in index.candidates(marks) for n, first, end in occurrences(index, t, words, marks, places)]
    if not kept:
        return []
    places = [m.span() for m in _WORD.finditer(text.lower())]
    # Code points before each byte: bytes that begin one, added up once.
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return sorted((index.names[t], round(c, 4), int(chars[places[first][0]]), int(chars[places[end - 1][1]])) for c, t, first, end in kept)


MATCH = "array<struct<license:string,coverage:double,start:int,end:int>>"


def license_matches(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row a document: k, found."""
    index = Index.of(templates or TEMPLATES, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        known = WordHash()
        for b in (part for whole in batches for part in slices(whole)):
            out = [[dict(zip(("license", "coverage", "start", "end"), m)) for m in matches(index, t, known)] for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "found": pa.array(out, kind)})

    return keyed(docs).select("k", "text").mapInArrow(run, f"k long, found {MATCH}")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (name:coverage:start:end, comma-joined)."""
    each = F.transform("found", lambda m: F.concat_ws(":", m["license"], F.format_number(m["coverage"], 4), m["start"], m["end"]))
    return rows.select(doc_id(), F.size("found").cast("long").alias("n_matches"), F.array_join(each, ",").alias("licenses"))
