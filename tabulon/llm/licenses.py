"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports spans.

Words are runs of letters and digits, lower-cased. Each run of GRAM words has a hash; of every WINDOW runs the least
hash is a fingerprint, so any GRAM + WINDOW - 1 equal words in a row share one with the template. The index maps a
fingerprint to its places in the templates, which are a parameter and so of bounded size; it is broadcast. A text's
fingerprints that are in the index are anchors; a longest chain of anchors of one template, each on a diagonal near
the one before and further on in text and template, is one candidate, if its anchors are as many as a match of the
least coverage would mostly leave. A candidate is aligned word by word within BAND of
its diagonals: equal words gain 2, other steps lose 1, and the best local alignment gives the span and the coverage -
equal words as a share of the template's. A match with BAND words or more left out in a row counts as two parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy_batches

WORD = re.compile(r"[^\W_]+")
GRAM, WINDOW, BAND = 2, 2, 8
EQUAL, OTHER = 2, -1

# Public license notices and texts, as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
}


class WordNumbers(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fingerprints(numbers: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the least hash in each `window` runs of `gram` words; of fewer runs, the least of all."""
    n = len(numbers) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = numbers[:n].copy()
    for i in range(1, gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    w = min(window, n)
    least = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(n - w + 1) + least.argmin(axis=1))
    return h[at], at


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """Best local alignment with text place - template place in [low, high]: score, equal words, and text span [from, to), then the template's first place."""
    width = high - low + 1
    score, equal, begun, first = ([0] * (width + 2) for _ in range(4))
    best = (0, 0, 0, 0, 0)
    for j in range(len(template)):
        new = [[0] * (width + 2) for _ in range(4)]
        for d in range(1, width + 1):
            i = j + low + d - 1
            if not 0 <= i < len(text):
                continue
            same = text[i] == template[j]
            # diagonal: same place in the band; a template word more: place d + 1 of the row before; a text word more: d - 1 of this row
            s, e, b, f = score[d], equal[d], begun[d], first[d]
            if s == 0:
                e, b, f = 0, i, j
            s, e = (s + EQUAL, e + 1) if same else (s + OTHER, e)
            if score[d + 1] + OTHER > s:
                s, e, b, f = score[d + 1] + OTHER, equal[d + 1], begun[d + 1], first[d + 1]
            if new[0][d - 1] + OTHER > s:
                s, e, b, f = new[0][d - 1] + OTHER, new[1][d - 1], new[2][d - 1], new[3][d - 1]
            if s > 0:
                new[0][d], new[1][d], new[2][d], new[3][d] = s, e, b, f
                if s > best[0]:
                    best = (s, e, b, i + 1, f)
        score, equal, begun, first = new
    return best


def least_anchors(n: int, least: float) -> int:
    """Anchors that a candidate needs for a template of n words: half of the windows that (1 - least) * n changed words leave whole, and one."""
    return max(1, (n - GRAM + 1 - GRAM * int((1 - least) * n)) // (2 * WINDOW))


def chains(anchors: list[tuple[int, int]], reach: int, need: int) -> Iterator[list[tuple[int, int]]]:
    """Chains of `need` or more anchors (diagonal, text place; in order of the text), longest first, no anchor in two.

    An anchor follows the longest chain that ends within `reach` diagonals and before it in both text and template; so
    stray anchors, of which there are many if a template repeats its words, neither split a chain nor hide it.
    """
    if len(anchors) < need:
        return
    latest: dict[int, int] = {}
    length, before = [0] * len(anchors), [-1] * len(anchors)
    for i, (d, at) in enumerate(anchors):
        most, near = 0, -1
        for e in range(d - reach, d + reach + 1):
            if (j := latest.get(e)) is not None and anchors[j][1] < at and anchors[j][1] - e < at - d and (length[j] > most or length[j] == most and abs(e - d) < abs(anchors[near][0] - d)):
                most, near = length[j], j
        length[i], before[i], latest[d] = most + 1, near, i
    free = [True] * len(anchors)
    for i in sorted(range(len(anchors)), key=lambda i: -length[i]):
        if length[i] < need:
            break
        chain = []
        while i >= 0 and free[i]:
            free[i] = False
            chain.append(anchors[i])
            i = before[i]
        if len(chain) >= need:
            yield chain[::-1]


def scan_text(numbers: np.ndarray, templates: list[np.ndarray], index: dict[int, list[tuple[int, int]]], least: float) -> list[tuple[int, float, int, int, int]]:
    """Template number, coverage, equal words and word span [from, to) of each match with coverage of `least` or more."""
    h, at = fingerprints(numbers)
    anchors: dict[int, list[tuple[int, int]]] = {}
    known = index["known"]
    for i in np.flatnonzero(np.isin(h, known)).tolist():
        for k, place in index[int(h[i])]:
            anchors.setdefault(k, []).append((int(at[i]) - place, int(at[i])))
    found = []
    for k, mine in sorted(anchors.items()):
        template = templates[k]
        reach, need = min(BAND, len(template) // 2), least_anchors(len(template), least)
        mine.sort(key=lambda x: x[1])
        taken: set[int] = set()
        for g in chains(mine, reach, need):
            done = 0
            while len(g) >= need:
                exact = Counter(d for d, _ in g).most_common(1)[0][0]
                if exact >= 0 and np.array_equal(numbers[exact : exact + len(template)], template):
                    equal, start, end = len(template), exact, exact + len(template)
                else:
                    low, high = min(d for d, _ in g) - reach, max(d for d, _ in g) + reach
                    begin = max(done, low)
                    _, equal, start, end, _ = align(numbers[begin : high + len(template) + 1], template, low - begin, high - begin)
                    start, end = start + begin, end + begin
                if equal / len(template) < least:
                    break
                if start not in taken:
                    taken.add(start)
                    found.append((k, equal / len(template), equal, start, end))
                # what stands after the match may be another
                done = end
                g = [x for x in g if x[1] >= end]
    return sorted(found, key=lambda m: (m[0], m[3]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75) -> DataFrame:
    """A row for each match of a template in a row of `docs` (doc_id, text): doc_id, license, coverage, words (equal
    ones), start_word, end_word, start_char, end_char (from, to; in the text as it is).

    Null and empty texts match nothing; a template may match many times in a text. Templates of fewer than GRAM
    words are an error, as they have no fingerprint. Repeated rows and rows without an id have their matches each, an
    empty table has none; more columns are not looked at. start_char and end_char are null where lower-casing changes
    the number of words, so that places can't be carried over.
    """
    named = sorted((TEMPLATES if templates is None else templates).items())
    if short := [n for n, t in named if len(words_of(t)) < GRAM]:
        raise ValueError(f"templates of fewer than {GRAM} words: {short}")
    numbers = [np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(t)], np.uint64) for _, t in named]
    index: dict = {}
    for k, n in enumerate(numbers):
        for h, at in zip(*fingerprints(n), strict=True):
            index.setdefault(int(h), []).append((k, int(at)))
    index["known"] = np.array(sorted(index), np.uint64)
    known = docs.sparkSession.sparkContext.broadcast(([n for n, _ in named], numbers, index))
    schema = "doc_id long, license string, coverage double, words int, start_word long, end_word long, start_char long, end_char long"
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32()] + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, all_numbers, found_in = known.value
        hashes = WordNumbers()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < GRAM:
                    continue
                matches = scan_text(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), all_numbers, found_in, least)
                if matches:
                    # lower() can change a text's length, so places of characters are found in the text as it is
                    spans = [m.span() for m in WORD.finditer(text)]
                    whole = len(spans) == len(words)
                    rows += [(doc_id, names[k], c, n, a, b, spans[a][0] if whole else None, spans[b - 1][1] if whole else None) for k, c, n, a, b in matches]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy_batches(run), schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
