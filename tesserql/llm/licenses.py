"""License scans by patience alignment of texts with license templates.

A template of m words is found in a stretch of at most `reach(m)` words of a text if an alignment of both matches at least COVERAGE of it: words that are
unique on both sides are anchors, the longest increasing subsequence of the anchors stays, and the gaps between them are aligned in the same way;
equal words at both ends of a gap match first. Stretches of the whole text are candidates wherever enough of their words are words of the template, and as many as the template has of each,
which no stretch with a find can lack. A text is looked at if it holds one of a few words of a template of which any find must have one: so many of its longest that the others alone don't reach COVERAGE.
Overlapping finds of several templates leave the one with most matched words; of one license and place, the best.

Templates are an argument; those given are one-sentence notices, the usual file headers and the short licenses' whole bodies, not the bodies of the long licenses (Apache, GPL, LGPL, AGPL, MPL), whose headers or
notices stand for them.

Defined results: a null or empty text has no finds, and so no rows; each row is scanned by itself, repeated rows alike; an empty table gives an empty result; further
columns are ignored. A long text costs in proportion to its words: only what is dense in a template's words is aligned.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import raw_texts, table

COVERAGE = 0.85

# Notices, file headers and bodies of public licenses.
WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details."
)
GNU_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GNU_TERMS.format("General Public", 3)),
    ("GPL-3.0", GNU_HEADER.format("General Public", 3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GNU_TERMS.format("General Public", 2)),
    ("GPL-2.0", GNU_HEADER.format("General Public", 2)),
    ("LGPL-3.0", GNU_TERMS.format("Lesser General Public", 3)),
    ("LGPL-3.0", GNU_HEADER.format("Lesser General Public", 3)),
    ("LGPL-2.1", GNU_TERMS.format("Lesser General Public", 2.1)),
    ("LGPL-2.1", GNU_HEADER.format("Lesser General Public", 2.1)),
    ("AGPL-3.0", GNU_TERMS.format("Affero General Public", 3)),
    ("AGPL-3.0", GNU_HEADER.format("Affero General Public", 3)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", BSD_TERMS + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_TERMS + BSD_NAMES + BSD_WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def reach(words: int) -> int:
    """Words of a text that a find of a template of so many words may spread over."""
    return words + max(8, words // 2)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, [w for w, _, _ in words_of(text)]
        self.counts, self.reach = Counter(self.words), reach(len(self.words))
        self.need = next(n for n in range(len(self.words) + 1) if n / len(self.words) >= COVERAGE)
        # Any `need` words of the template have one of these.
        self.marks, left = [], len(self.words)
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            if left >= self.need:
                self.marks.append(w)
                left -= self.counts[w]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in the order of their first place, a longest part whose second places rise: patience sorting with back links."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = longest_increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in at])
        found += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors and k > i + 1 and m > j + 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def candidates(words: list[str], t: Template) -> list[list[int]]:
    """Groups of places from which `reach` words have enough words of the template; a group's stretches overlap, the densest first."""
    known = np.fromiter((w in t.counts for w in words), dtype=bool, count=len(words))
    upto = np.concatenate([[0], np.cumsum(known)])
    many = upto[np.minimum(np.arange(len(words)) + t.reach, len(words))] - upto[:-1]
    starts = np.flatnonzero(known & (many >= t.need))
    cuts = np.flatnonzero(np.diff(starts) > t.reach) + 1
    return [group[np.argsort(-many[group], kind="stable")].tolist() for group in np.split(starts, cuts) if len(group)]


def finds_of(words: list[str], t: Template) -> Iterator[tuple[int, int, int]]:
    """(first, last, matched words) of stretches that don't overlap, the densest first."""
    for group in candidates(words, t):
        taken: list[tuple[int, int]] = []
        for at in group:
            end = min(at + t.reach, len(words))
            if any(at <= hi and lo < end for lo, hi in taken):
                continue
            # At most so many words can match, with repeats.
            if (Counter(words[at:end]) & t.counts).total() < t.need:
                continue
            pairs = align(words[at:end], t.words)
            if len(pairs) >= t.need:
                taken.append((at + pairs[0][0], at + pairs[-1][0]))
                yield *taken[-1], len(pairs)


def scan(text: str, templates: list[Template]) -> list[tuple[str, int, int, int, float]]:
    """(license, start, end, matched words, coverage) of what a text holds, in order; offsets count characters."""
    low = text.lower()
    templates = [t for t in templates if any(w in low for w in t.marks)]
    if not templates:
        return []
    words = words_of(text)
    plain = [w for w, _, _ in words]
    finds = [(t.name, words[lo][1], words[hi][2], n, n / len(t.words)) for t in templates for lo, hi, n in finds_of(plain, t)]
    out: list[tuple] = []
    for f in sorted(finds, key=lambda f: (-f[3], -f[4], f[1], f[0])):
        if all(f[2] <= o[1] or f[1] >= o[2] for o in out):
            out.append(f)
    return sorted(out, key=lambda f: f[1])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, start, end, matched, coverage of every template (name, text) found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Template(*t) for t in templates]
        marks = {w.encode() for t in own for w in t.marks if w.isascii()}
        plain = all(w.isascii() for t in own for w in t.marks)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), raw_texts(b["text"]), strict=True):
                text = text or b""
                # Letters beyond ASCII may become ASCII when lower-cased.
                if not plain or not text.isascii() or any(w in low for low in (text.lower(),) for w in marks):
                    rows += [(doc, *f) for f in scan(text.decode("utf-8", "replace"), own)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "start", "end", "matched", "coverage"])

    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return texts.mapInArrow(run, "doc_id long, license string, start int, end int, matched int, coverage double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
