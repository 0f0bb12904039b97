"""License scans by patience alignment.

Texts and templates are words of letters and digits, A-Z in lower case.  Where a
stretch of a text holds enough of a template's words, the two are aligned:
words that occur once in each are anchors, the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned in the same way;
a gap without anchors gives what its ends share.  Coverage is the share of the
template's words that have a partner.  A stretch of COVERAGE or more is a match
if the words that name the license are there as well, side by side and without
another license's name before them or a word after them that makes it another.
Only a long notice may have a word in place of its name that names no license.

Rows: null text has no words; texts of any length are scanned whole; several
matches of one or more licenses are all listed, in order; repeated rows give
repeated rows; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile("[a-z0-9]+")
COVERAGE, ENOUGH, STRETCH = 0.8, 0.6, 1.5

#: Notices, headers and whole texts of common licenses.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU_NOTICE = """{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."""
GNU_HEAD = "GNU {0} Version 3, {1} 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", APACHE_NOTICE
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", GNU_NOTICE.format("This program", "Affero General Public License"), GNU_HEAD.format("AFFERO GENERAL PUBLIC LICENSE", "19 November")
    ],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "\n".join((BSD_HEAD, BSD_TAIL)), "\n".join((BSD_HEAD, BSD_NAMES, BSD_TAIL))],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "EPL": ["Licensed under the Eclipse Public License, Version 2.0.", "made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", GNU_NOTICE.format("This program", "General Public License"), GNU_HEAD.format("GENERAL PUBLIC LICENSE", "29 June")
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ISC_TEXT],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation", GNU_NOTICE.format("This library", "Lesser General Public License"), GNU_HEAD.format("LESSER GENERAL PUBLIC LICENSE", "29 June")
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", MIT_TEXT
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", UNLICENSE_TEXT],
    "Zlib": [ZLIB_TEXT],
}
#: Words side by side that name the license, for those of its templates that hold them.
NAMES = {
    "AGPL": ["gnu affero general"],
    "Apache-2.0": ["apache", "2"],
    "BSD": ["bsd"],
    "CC-BY": ["cc by", "commons attribution"],
    "CC-BY-NC": ["cc by nc", "commons attribution noncommercial"],
    "CC-BY-SA": ["cc by sa", "commons attribution sharealike"],
    "CC0": ["cc0"],
    "EPL": ["eclipse public"],
    "GPL": ["gnu general"],
    "ISC": ["with or without fee"],
    "LGPL": ["gnu lesser general", "gnu library general"],
    "MIT": ["mit"],
    "MPL": ["mozilla public"],
    "Unlicense": ["unencumbered software"],
}
#: Words right behind a name that make it another license's.
TURNS = dict.fromkeys(("CC-BY", "CC-BY-NC", "CC-BY-SA"), set("nc nd sa no non noncommercial noderivatives noderivs share sharealike".split())) | {"MIT": {"0", "no"}}
#: Words of licenses' names; a template of LONG words is known without its name unless one of them stands for it.
OTHERS = set("affero agpl apache artistic boost bsd cc cc0 cddl cecill ecl eclipse educational epl eupl european gnu gpl isc lesser lgpl mit mozilla mpl mulan ncsa ofl osl php python sil unlicense zlib zope".split())
LONG = 20
#: Words that don't tell a license.
COMMON = set("a an and any are as at be by can for free in is it not of or that the this to under use version with work you 0 2 3 4".split())

Pair = tuple[int, int]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(pairs: list[Pair]) -> list[Pair]:
    """The longest subsequence that also increases in the second place, by patience sorting; first places increase already."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
        before[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[Pair]:
    """Places of words that patience alignment pairs, in order."""
    out, stack = [], [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if theirs[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if ours[w] == 1 and w in place])
        for i, j in anchors:
            out.append((i, j))
            stack.append((a, i, c, j))
            a, c = i + 1, j + 1
        if anchors:
            stack.append((a, b, c, d))
    return sorted(out)


class Name:
    """Words from place ``at`` of a template that name its license."""

    def __init__(self, words: list[str], at: int, template: list[str], license: str):
        self.at, self.end, self.turns = at, at + len(words), TURNS.get(license, set())
        self.needed = set() if len(template) >= LONG and words == ["apache"] else set(words)

    def stands(self, text: list[str], pairs: list[Pair]) -> bool:
        """Is the name in the text as the pairs have it?"""
        before = max((i for i, j in pairs if j < self.at), default=-1)
        places = [i for i, j in pairs if self.at <= j < self.end]
        if len(places) < self.end - self.at:
            behind = min((i for i, j in pairs if j >= self.end), default=len(text))
            return not self.needed and before >= 0 and OTHERS.isdisjoint(text[before + 1 : behind])
        if places[-1] - places[0] >= len(places) or before >= 0 and not OTHERS.isdisjoint(text[before + 1 : places[0]]):
            return False
        return places[-1] + 1 == len(text) or text[places[-1] + 1] not in self.turns


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.templates = []
        for name, texts in (TEMPLATES if templates is None else templates).items():
            for text in texts:
                words = words_of(text)
                if words:
                    named = []
                    for said in map(str.split, NAMES.get(name, ()) if templates is None else ()):
                        at = next((i for i in range(len(words)) if words[i : i + len(said)] == said), None)
                        if at is not None:
                            named.append(Name(said, at, words, name))
                    self.templates.append((name, words, set(words), (set(words) - COMMON) or set(words), named, set().union(*(n.needed for n in named))))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, end, coverage) of every match; of matches of one license that overlap, the longest."""
        words = words_of(text)
        have = set(words)
        found: list[tuple[str, int, int, float]] = []
        for name, template, vocabulary, telling, named, needed in self.templates:
            if not needed <= have or len(telling & have) < ENOUGH * len(telling):
                continue
            places = [i for i, w in enumerate(words) if w in vocabulary]
            span, k = int(STRETCH * len(template)) + 2, 0
            while k < len(places):
                end = bisect_left(places, places[k] + span)
                if len({words[i] for i in places[k:end]}) >= ENOUGH * len(vocabulary):
                    start = places[k]
                    pairs = align(words[start : start + span], template)
                    if len(pairs) >= COVERAGE * len(template) and all(n.stands(words[start : start + span], pairs) for n in named):
                        stop = start + pairs[-1][0] + 1
                        found.append((name, start + pairs[0][0], stop, len(pairs) / len(template)))
                        k = bisect_left(places, stop)
                        continue
                k += 1
        found.sort(key=lambda m: (m[1] - m[2], m[1], m[0]))
        out: list[tuple[str, int, int, float]] = []
        for m in found:
            if not any(m[0] == o[0] and m[1] < o[2] and o[1] < m[2] for o in out):
                out.append(m)
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


MATCH = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, matches array of (license, start, end, coverage)) of every document."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("matches", MATCH)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches):
        scanner = Scanner(templates)
        names = ("license", "start", "end", "coverage")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [[dict(zip(names, m)) for m in scanner.scan(x)] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words_of(x)) for x in texts], pa.int64()), pa.array(found, kind)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def summary(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_matches, licenses, best_coverage, covered_words) of every document; licenses are distinct, sorted and comma-joined."""
    m = F.col("matches")
    return scan(docs, templates, key, text).select(
        key,
        "n_words",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(m["license"])), ",").alias("licenses"),
        F.round(F.array_max(m["coverage"]), 6).alias("best_coverage"),
        F.aggregate(m, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("covered_words"),
    )
