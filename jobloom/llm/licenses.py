"""License scans: patience alignment of texts with license templates.

Words (letters and digits, lower-cased) that occur once in a stretch of text and
once in the template are anchors; the longest increasing subsequence of their
positions is kept; gaps between anchors are aligned in the same way, after equal
words at both ends are taken off. Coverage is the share of the template's words
that are aligned.

A first pass in Spark's own expressions keeps texts with a key word: of each
template the rarest words, as many as no text that reaches the threshold can
lack, so nothing above it is lost. Whole texts are scanned; the stretches to be
aligned lie around occurrences of key words. No shuffle: rows are scanned where
they lie, so skew of any column does not matter.

Defined results: null and empty texts have no rows, nor has an empty table;
repeated rows give repeated results; each template is looked for by itself, so a
text that holds another's has rows for both; extra columns are ignored; of overlapping stretches with one template
the one with the highest coverage counts, of equal ones the shortest, then the
first; where tighter stretches are more in number, or as many with more coverage in all, they count.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import kernels

#: Public license notices and texts (SPDX identifier, text).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
}
#: Words that are no key words where others suffice.
COMMON = frozenset("this that with from have will your more should even later into anyone means such which been than only other some what when they were also there their people data deal special direct language along version".split())
#: Share of a template's words that must be aligned.
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both, by patience alignment."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        there = {w: x for x, w in enumerate(b[k:m], k) if cb[w] == 1}
        pairs = [(x, there[w]) for x, w in enumerate(a[i:j], i) if ca[w] == 1 and w in there]
        if not pairs:
            continue
        anchors = [pairs[x] for x in increasing([p[1] for p in pairs])]
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.words = {k: words(v)[0] for k, v in texts.items()}
        spread = Counter(w for ws in self.words.values() for w in set(ws))
        self.keys: dict[str, set[str]] = {}
        for name, ws in self.words.items():
            count, keys, held = Counter(ws), set(), 0
            # Texts that reach the coverage lack fewer words than the key words' occurrences.
            may_lack = len(ws) - self._least(ws)
            for w in sorted(count, key=lambda w: (len(w) < 4 and not w.isdigit() and w not in ("mit", "gnu", "mpl"), w in COMMON, spread[w], -len(w), w)):
                if held > may_lack:
                    break
                keys.add(w)
                held += count[w]
            self.keys[name] = keys
        self.every = sorted(set().union(*self.keys.values()))

    def _least(self, ws: list[str]) -> int:
        return next(n for n in range(len(ws) + 1) if n >= self.coverage * len(ws))

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in code points) of the stretches that reach the coverage."""
        ws, spans = words(text)
        where: dict[str, list[int]] = {}
        wanted = set(self.every)
        for i, w in enumerate(ws):
            if w in wanted:
                where.setdefault(w, []).append(i)
        out = []
        for name, template in self.words.items():
            hits = sorted(i for w in self.keys[name] for i in where.get(w, ()))
            for cover, a, b in self._stretches(ws, 0, len(ws), template, hits):
                out.append((name, cover, spans[a][0], spans[b - 1][1]))
        return sorted(out, key=lambda x: (x[2], x[0]))

    def _stretches(self, ws: list[str], lo: int, hi: int, template: list[str], hits: list[int]) -> list[tuple[float, int, int]]:
        """Stretches of words lo to hi that do not overlap. Between those found the search goes on until none reaches the coverage."""
        orders = (lambda x: (-x[0], x[2] - x[1], x[1]), lambda x: (x[2] - x[1] > len(template), -x[0], x[2] - x[1], x[1]))
        found: list[tuple[float, int, int]] = []
        fits: dict[tuple[int, int], set[tuple[float, int, int]]] = {}
        for order in orders:
            own, todo = [], [(lo, hi)]
            while todo:
                x, y = todo.pop()
                if (x, y) not in fits:
                    fits[x, y] = self._fits(ws, x, y, template, hits[bisect_left(hits, x) : bisect_left(hits, y)])
                taken: list[tuple[float, int, int]] = []
                for fit in sorted(fits[x, y], key=order):
                    if all(fit[2] <= c or d <= fit[1] for _, c, d in taken):
                        taken.append(fit)
                if taken:
                    edges = [x, *sorted(z for _, c, d in taken for z in (c, d)), y]
                    todo += zip(edges[::2], edges[1::2], strict=True)
                own += taken
            # Loose alignments can join two copies; the order by tightness counts where it parts them.
            if (len(own), sum(f[0] for f in own)) > (len(found), sum(f[0] for f in found)):
                found = own
        return found

    def _fits(self, ws: list[str], lo: int, hi: int, template: list[str], hits: list[int]) -> set[tuple[float, int, int]]:
        """(coverage, start, end) of alignments of windows of lo to hi that reach the coverage."""
        n, least, count = len(template), self._least(template), Counter(template)
        reach, step, windows, i = n + n // 4, max(1, n // 8), set(), 0
        places: dict[str, list[int]] = {}
        for p, w in enumerate(template):
            places.setdefault(w, []).append(p)
        # Around hits that lie together: words that recur around a narrow window are unique in it.
        while i < len(hits):
            k = i
            while k + 1 < len(hits) and hits[k + 1] - hits[i] <= reach:
                k += 1
            p = places[ws[hits[i]]][0]
            windows |= {(hits[i] - reach, hits[k] + reach + 1), (hits[i] - p - n // 8, hits[i] - p + n + n // 8 + 1), (hits[k] - n, hits[k] + n), (hits[i] - n // 4, hits[k] + n // 4 + 1)}
            i = k + 1
        # Where a copy starts to which a hit belongs.
        starts = Counter(h - p for h in hits for p in places[ws[h]])
        windows |= {(s, s + n) for s in starts}
        windows |= {(s // step * step - step, s // step * step + n + 2 * step) for s in starts}
        out = set()
        for x, y in {(max(lo, x), min(hi, y)) for x, y in windows}:
            if y - x < least or sum((Counter(ws[x:y]) & count).values()) < least:
                continue
            pairs = align(ws[x:y], template)
            if len(pairs) >= least:
                out.add((len(pairs) / n, x + pairs[0][0], x + pairs[-1][0] + 1))
        return out


def templates_of(rows: DataFrame) -> dict[str, str]:
    """Templates from a table (license, text) of at most 2,000 rows: every worker gets them."""
    found = rows.select("license", "text").filter("license is not null and text is not null").limit(2001).collect()
    if len(found) > 2000:
        raise ValueError("more than 2,000 templates are not sent to every worker")
    return {r.license: r.text for r in found}


_FOUND = "doc_id long, license string, coverage double, start long, end long"


def _boundless(keys: str) -> str:
    """A pattern of all texts that hold a key as a word, and some more.

    What ends a word to Python (``[^\\W_]``) and to Java differs (marks, joiners,
    letters newer than one of them); no ASCII letter or digit ends one to either.
    """
    return f"(?iu)(?<![A-Za-z0-9])(?:{keys})(?![A-Za-z0-9])"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end (code points) of every stretch that reaches the coverage."""
    keys = "|".join(map(re.escape, Templates(templates, coverage).every))
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(_boundless(keys)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, coverage)
        for batch in kernels.pieces(batches, "text"):
            rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in known.find(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return near.mapInArrow(work, _FOUND)


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
