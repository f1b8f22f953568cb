"""License scans: Dice coefficient over word bigrams against licence templates.

Candidates are the whole text, each paragraph (between empty lines), each line, and
windows of consecutive words, whatever lines or paragraphs they run over. A candidate
is normalised (lower case, words of letters, digits and dots, without copyright
lines' years and names), and compared to every template whose size the bounds allow:
with b bigrams in a template and Dice of at least t, a candidate has from
b * t / (2 - t) to b * (2 - t) / t bigrams. Bigrams count as often as they occur.
Before that, a candidate whose bigrams meet none of any template is done with.

All windows inside the size bounds count: the best one begins and ends with a bigram of
the template, and one that falls short by as many words as the bounds allow isn't tried.
For templates of up to SENTENCE bigrams a window counts as at least as long as the
template, as else "licensed under the MIT" would do. Windows of a template don't overlap
(the best one first). A window goes if a stronger match (of more shared bigrams) has more
than half of the bigrams it rests on, and so does a text, paragraph or line if that match
is a window: half of a licence line may look like another one.

The result is exact for these candidates; each text gets its best match (the highest
Dice, then the template's name) and all licences that match. Null and empty texts
match none; texts are scanned whole; repeated rows each give a row; extra columns are
ignored.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map

#: A match has this Dice coefficient at least.
DICE = 0.8
#: Templates of up to so many bigrams are sentences; windows of larger ones than LONG are counted in arrays.
SENTENCE, LONG = 20, 64
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
COPYRIGHT = re.compile(r"^\s*(?:copyright|\(c\)|©).*$", re.I | re.M)
#: Whole texts of licences, as files in texts/, by the licence's name.
WHOLE = {
    "Apache-2.0": "Apache-2.0.txt",
    "Artistic-1.0-Perl": "Artistic.txt",
    "CC0-1.0": "CC0-1.0.txt",
    "GFDL-1.3": "GFDL-1.3.txt",
    "GPL-2.0": "GPL-2.txt",
    "GPL-3.0": "GPL-3.txt",
    "LGPL-2.1": "LGPL-2.1.txt",
    "LGPL-3.0": "LGPL-3.txt",
    "MPL-1.1": "MPL-1.1.txt",
    "MPL-2.0": "MPL-2.0.txt",
}
#: Notices and short texts of common licences.
TEMPLATES = {
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT line": "Licensed under the MIT License.",
    "MIT release line": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0 work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All rights reserved line": "All rights reserved.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
# the third condition stands between the second and the disclaimer
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED""", 1)
# the notices of this family differ in the licence's name and version only
TEMPLATES["GPL-2.0 notice"] = TEMPLATES["GPL-3.0 notice"].replace("version 3", "version 2")
TEMPLATES["LGPL-3.0 notice"] = TEMPLATES["GPL-3.0 notice"].replace("General Public", "Lesser General Public")
TEMPLATES["AGPL-3.0 notice"] = TEMPLATES["GPL-3.0 notice"].replace("General Public", "Affero General Public")
TEMPLATES |= {name: pkgutil.get_data("marginalia.llm", f"texts/{file}").decode("utf-8") for name, file in WHOLE.items()}


def words_of(text: str) -> list[str]:
    return WORD.findall(COPYRIGHT.sub(" ", text).lower() if "opyright" in text or "©" in text or "(c)" in text.lower() or "OPYRIGHT" in text else text.lower())


def word_places(text: str) -> list[tuple[int, int]]:
    """The spans in text of words_of(text)."""
    low = COPYRIGHT.sub(lambda m: " " * len(m[0]), text).lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) != len(text):
        # a letter that becomes two in lower case
        back = [i for i, c in enumerate(text) for _ in c.lower()]
        spans = [(back[a], back[b - 1] + 1) for a, b in spans]
    return spans


class Matcher:
    """Templates with their bigrams and size bounds."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = DICE):
        self.least = least
        self.grams = {name: Counter(zip(w, w[1:])) for name, text in sorted(templates.items()) if len(w := words_of(text)) > 1}
        self.sizes = {name: sum(c.values()) for name, c in self.grams.items()}
        # a hair wider, as a candidate may be just on a bound
        self.bounds = {name: (n * least / (2 - least) - 1e-6, n * (2 - least) / least + 1e-6) for name, n in self.sizes.items()}
        self.smallest, self.largest = min(b[0] for b in self.bounds.values()), max(b[1] for b in self.bounds.values())
        self.holders: dict[tuple[str, str], list[str]] = {}
        for name, c in self.grams.items():
            for g in c:
                self.holders.setdefault(g, []).append(name)
        # sizes between two edges have the same templates, so there are no more sets than two for each template and one
        self.edges = sorted({e for low, high in self.bounds.values() for e in (ceil(low), floor(high) + 1)})
        self.of_range: dict[int, tuple[list[str], set[tuple[str, str]]]] = {}

    def eligible(self, n: int) -> tuple[list[str], set[tuple[str, str]]]:
        """The templates that n bigrams may match, and all of their bigrams."""
        at = bisect_right(self.edges, n)
        if at not in self.of_range:
            names = [name for name, (low, high) in self.bounds.items() if low <= n <= high]
            self.of_range[at] = names, set().union(*(self.grams[x] for x in names))
        return self.of_range[at]

    def best(self, words: list[str]) -> tuple[float, str, int] | None:
        """(Dice, template, templates compared) of a candidate's best template, if it is close enough."""
        n = len(words) - 1
        if not self.smallest <= n <= self.largest:
            return None
        names, any_of = self.eligible(n)
        if any_of.isdisjoint(zip(words, words[1:])):
            return None
        grams, found = Counter(zip(words, words[1:])), (0.0, "")
        for name in names:
            dice = 2 * (grams & self.grams[name]).total() / (n + self.sizes[name])
            if dice >= self.least and dice > found[0]:
                found = dice, name
        return (*found, len(names)) if found[1] else None

    def scan(self, text: str) -> list[tuple[float, str, int, int]]:
        """(Dice, template, start, end) of the candidates that match; spans are code points."""
        out = []
        seen = set()
        for start, end in candidates(text):
            if (start, end) in seen:
                continue
            seen.add((start, end))
            if (m := self.best(words_of(text[start:end]))) is not None:
                out.append((m[0], m[1], start, end))
        return self.settled(text, out)

    def windows(self, words: list[str]) -> list[tuple[int, float, str, int, int]]:
        """(shared bigrams, Dice, template, first bigram, last) of the best windows that don't overlap, for each template."""
        at: dict[str, list[tuple[int, tuple[str, str]]]] = {name: [] for name, (low, _) in self.bounds.items() if low <= len(words) - 1}
        for i, g in enumerate(zip(words, words[1:])):
            for name in self.holders.get(g, ()):
                if name in at:
                    at[name].append((i, g))
        out = []
        for name, hits in at.items():
            if len(hits) >= self.bounds[name][0]:
                taken = bytearray(len(words))
                for dice, shared, i, j in sorted(self._from_each(name, hits), key=lambda x: (-x[0], x[2], -x[3])):
                    if 1 not in taken[i : j + 1]:
                        taken[i : j + 1] = b"\1" * (j + 1 - i)
                        out.append((shared, dice, name, i, j))
        return out

    def _from_each(self, name: str, hits: list[tuple[int, tuple[str, str]]]) -> Iterator[tuple[float, int, int, int]]:
        """(Dice, shared, first, last) of the best window from each hit, if it is close enough."""
        grams, size, (low, high) = self.grams[name], self.sizes[name], self.bounds[name]
        least_n = size if size <= SENTENCE else 0
        if size > LONG:
            yield from self._in_arrays(name, hits)
            return
        # what the longest window from a hit shares bounds all windows from there
        held, shared, end = Counter(), 0, 0
        for k, (i, first) in enumerate(hits):
            while end < len(hits) and hits[end][0] - i + 1 <= high:
                g = hits[end][1]
                held[g] += 1
                shared += held[g] <= grams[g]
                end += 1
            if shared >= low:
                best, seen, both = (0.0, 0, 0), Counter(), 0
                for j, g in hits[k:end]:
                    seen[g] += 1
                    if seen[g] <= grams[g]:
                        both += 1
                        dice = 2 * both / (max(j - i + 1, least_n) + size)
                        if dice > best[0]:
                            best = dice, both, j
                if best[0] >= self.least:
                    yield best[0], best[1], i, best[2]
            shared -= held[first] <= grams[first]
            held[first] -= 1

    def _in_arrays(self, name: str, hits: list[tuple[int, tuple[str, str]]]) -> Iterator[tuple[float, int, int, int]]:
        """What _from_each gives for a template of many bigrams, in arrays of a window's hits.

        A hit counts in a window unless the template's number of that bigram is reached
        there before it, that is, if the window begins after the hit so many of the same before.
        """
        grams, size, (low, high) = self.grams[name], self.sizes[name], self.bounds[name]
        seen: dict[tuple[str, str], list[int]] = {}
        before = np.full(len(hits), -1)
        for h, (_, g) in enumerate(hits):
            own = seen.setdefault(g, [])
            if len(own) >= grams[g]:
                before[h] = own[-grams[g]]
            own.append(h)
        places = np.array([i for i, _ in hits])
        ends = np.searchsorted(places, places + int(high) - 1, side="right")
        for k in np.flatnonzero(ends - np.arange(len(hits)) >= low):
            both = np.cumsum(before[k : ends[k]] < k)
            if both[-1] >= low:
                dice = 2 * both / (places[k : ends[k]] - places[k] + 1 + size)
                j = int(dice.argmax())
                if dice[j] >= self.least:
                    yield float(dice[j]), int(both[j]), int(places[k]), int(places[k + j])

    def settled(self, text: str, whole: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
        """whole, the matches of the other candidates, and the windows, as (Dice, template, start, end), without those that a stronger one explains."""
        words = words_of(text)
        found = self.windows(words)
        if not found:
            return whole
        places = word_places(text)
        starts = [a for a, _ in places]
        entries = [(-shared, 1, -dice, name, i, j, places[i][0], places[j + 1][1]) for shared, dice, name, i, j in found]
        for dice, name, a, b in whole:
            i, j = bisect_left(starts, a), bisect_left(starts, b) - 2
            shared = (Counter(zip(words[i : j + 1], words[i + 1 : j + 2])) & self.grams[name]).total()
            entries.append((-shared, 0, -dice, name, i, j, a, b))
        kept, covers = set(), ({}, {})
        for entry in sorted(entries):
            _, window, dice, name, i, j, a, b = entry
            rests = [(p, g) for p in range(i, j + 1) if (g := (words[p], words[p + 1])) in self.grams[name]]
            # only windows explain a whole text, paragraph or line
            stronger = [covers[1], covers[0]] if window else [covers[1]]
            explained = Counter(other for p, g in rests for other in set().union(*(c.get(p, ()) for c in stronger)) if g in self.grams[other])
            if 2 * max(explained.values(), default=0) <= len(rests):
                kept.add((-dice, name, a, b))
                for p, _ in rests:
                    covers[window].setdefault(p, set()).add(name)
        return [m for m in whole if m in kept] + sorted(kept.difference(whole), key=lambda m: m[2:])


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """The whole text, its paragraphs and its lines, as spans."""
    if not text:
        return
    yield 0, len(text)
    at = 0
    for m in re.finditer(r"\n[ \t\r]*\n", text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at:
        yield at, len(text)
    at = 0
    for line in text.split("\n"):
        if line:
            yield at, at + len(line)
        at += len(line) + 1


@lru_cache(1)
def matcher() -> Matcher:
    return Matcher()


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = DICE) -> DataFrame:
    """The id, best licence, its Dice and span, and all licences that match (comma-joined, sorted) for each row of df."""
    own = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = f"`{id_col}` {own.schema[0].dataType.simpleString()}, licence string, dice double, start long, end long, licences string, n_matches long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher() if templates is None and least == DICE else Matcher(templates or TEMPLATES, least)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = m.scan(text or "")
                top = min(found, key=lambda x: (-x[0], x[1], x[2])) if found else None
                name = top[1] if top else None
                rows.append((name, top[0] if top else None, top[2] if top else None, top[3] if top else None, ",".join(sorted({x[1] for x in found})), len(found)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "licence", "dice", "start", "end", "licences", "n_matches"])

    return arrow_map(own, run, schema)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
