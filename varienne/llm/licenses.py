"""License scan by conditional compression and exact wording differences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import renamed

#: Public notices and license texts that are looked for.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "ISC-notice": "Released under the ISC License.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/. SPDX-License-Identifier: EPL-2.0""",
}
#: Words of which every template holds one; blocks lie around them.
CUES = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|public domain|all rights"
#: Bytes by which sizes differ without telling anything: one literal or a code that is a bit longer.
GRAIN = 4
#: Bytes that zstandard takes as a dictionary at least.
LEAST_DICTIONARY = 8
#: Wording differences per word.
MOST_DIFFERENCES = 0.2

_CUE, _WORD = re.compile(CUES), re.compile(r"[^\W_]+(?:\.\d+)*")
FOUND = "id bigint, template string, start bigint, end bigint, gain bigint, plain_size bigint, differences bigint, template_words bigint, missing array<string>, added array<string>"


def reach_of(templates: dict[str, str]) -> int:
    """Code points around a cue that hold a template: its longest stretch without one, half as much again."""
    longest = 0
    for t in templates.values():
        edges = [0, *(x for m in _CUE.finditer(t) for x in m.span()), len(t)]
        longest = max(longest, *(b - a for a, b in zip(edges[::2], edges[1::2])))
    return longest * 3 // 2 + 20


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Stretches of text around cues; stretches that meet are one."""
    out: list[list[int]] = []
    for m in _CUE.finditer(text):
        lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tuple(b) for b in out]


def align(wanted: list[str], found: list[str]) -> tuple[int, int, int]:
    """Fewest word insertions, deletions and replacements that turn a stretch of ``found`` into ``wanted``.

    Returns that number and the stretch (first, end); of equal ones the first that ends.
    """
    n = len(found)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    words = np.array(found, object)
    for w in wanted:
        step = cost[:-1] + (words != w) if n else np.zeros(0, np.int64)
        new, source = cost + 1, origin.copy()
        better = step < new[1:]
        new[1:][better], source[1:][better] = step[better], origin[:-1][better]
        # Words skipped in the text add one each: a running minimum of cost minus place.
        best = np.minimum.accumulate(new - np.arange(n + 1))
        at = np.maximum.accumulate(np.where(new - np.arange(n + 1) == best, np.arange(n + 1), 0))
        cost, origin = new[at] + np.arange(n + 1) - at, source[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def differences(wanted: list[str], found: list[str]) -> tuple[list[str], list[str]]:
    """Words that are missing from and added to a template in one stretch."""
    from difflib import SequenceMatcher

    missing, added = [], []
    for kind, a, b, c, d in SequenceMatcher(None, wanted, found, autojunk=False).get_opcodes():
        if kind != "equal":
            missing += wanted[a:b]
            added += found[c:d]
    return missing, added


def stretches(inside: np.ndarray, size: int, most: float) -> list[tuple[int, int]]:
    """Stretches of words that may hold a template of ``size`` words; ``inside`` says which words it has.

    A passage with so few differences has at most (1 + most) * size words, at least (1 - most) * size of
    them the template's own, so that no passage is lost.
    """
    n, allowed = len(inside), int(most * size)
    width = min(size + allowed, n)
    sums = np.concatenate([[0], np.cumsum(inside)])
    begin = np.flatnonzero(sums[width:] - sums[:n - width + 1] >= size - allowed)
    if not len(begin):
        return []
    cuts = np.flatnonzero(np.diff(begin) > width)
    return list(zip(begin[np.append(0, cuts + 1)].tolist(), (begin[np.append(cuts, len(begin) - 1)] + width).tolist()))


class Scanner:
    """Templates as text, as words and as raw zstandard dictionaries."""

    def __init__(self, templates: dict[str, str], level: int = 6):
        import zstandard as z

        # One set of parameters: those that a level implies depend on the sizes of input and dictionary.
        self.parameters = z.ZstdCompressionParameters.from_level(level, source_size=1 << 17)
        self.plain = z.ZstdCompressor(compression_params=self.parameters)
        self.names = list(templates)
        self.texts = [t.lower().encode() for t in templates.values()]
        self.words = [[w.lower() for w in _WORD.findall(t)] for t in templates.values()]
        self.with_template = [self.given(t) for t in self.texts]
        self.numbers = {w: k for k, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.holds = np.zeros((len(self.words), len(self.numbers) + 1), bool)
        for i, t in enumerate(self.words):
            self.holds[i, [self.numbers[w] for w in t]] = True

    def given(self, content: bytes):
        """A compressor with some bytes as raw dictionary."""
        import zstandard as z

        return z.ZstdCompressor(compression_params=self.parameters, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT))

    def ranked(self, text: str, spans: list[tuple], most: float) -> list[tuple]:
        """Candidate stretches of every template, best first: (score, template, first word, end word, gain, plain size).

        A stretch is compressed plainly and with the template as dictionary, and the template with the stretch as dictionary.  What the template saves,
        less what it has beyond the stretch, orders the candidates: a template that the stretch holds whole comes before its parts and
        before others of which something is missing.
        """
        numbers = np.array([self.numbers.get(s[2], -1) for s in spans], np.int64)
        out = []
        for i, wanted in enumerate(self.words):
            for first, last in stretches(self.holds[i][numbers], len(wanted), most):
                part = text[spans[first][0]:spans[last - 1][1]].lower().encode()
                plain = len(self.plain.compress(part))
                gain = plain - len(self.with_template[i].compress(part))
                beyond = len(self.given(part).compress(self.texts[i])) if len(part) >= LEAST_DICTIONARY else len(self.texts[i])
                out.append((beyond - gain, -len(wanted), i, first, last, gain, plain))
        return [(x[0], *x[2:]) for x in sorted(out)]

    def confirmed(self, spans: list[tuple], taken: np.ndarray, candidate: tuple, most: float) -> tuple | None:
        """The closest passage of a candidate among words that are not taken: (differences per word, -words, differences, first, end)."""
        _, i, first, last, *_ = candidate
        wanted, best = self.words[i], None
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken[first:last], [True]]).astype(np.int8)))
        for x, y in zip((first + edges[::2]).tolist(), (first + edges[1::2]).tolist()):
            if y - x >= (1 - most) * len(wanted):
                n, a, b = align(wanted, [s[2] for s in spans[x:y]])
                if n <= most * len(wanted) and b > a and (best is None or n < best[2]):
                    best = (n / len(wanted), -len(wanted), n, x + a, x + b)
        return best

    def scan(self, text: str, reach: int, most: float) -> list[tuple]:
        """Notices of a text.

        The best ranked candidate and those at the same place whose scores differ from it by no more than the grain of the compressor are the winners; the one with the
        closest wording is confirmed and takes its words.  Winners without a passage close enough leave the ranking.
        """
        out = []
        for lo, hi in blocks(text, reach):
            spans = [(m.start() + lo, m.end() + lo, m[0].lower()) for m in _WORD.finditer(text[lo:hi])]
            taken = np.zeros(len(spans), bool)
            pending = self.ranked(text, spans, most)
            while pending:
                score, _, first, last, gain, _ = pending[0]
                limit = score + GRAIN + max(gain, 0) // 16
                winners = [c for c in pending if c[0] <= limit and c[2] < last and c[3] > first]
                passages = [(p, c) for c in winners if (p := self.confirmed(spans, taken, c, most))]
                lost = {c for c in winners} - {c for _, c in passages}
                pending = [c for c in pending if c not in lost]
                if passages:
                    (_, _, n, a, b), (_, i, _, _, gain, plain) = min(passages)
                    taken[a:b] = True
                    out.append((self.names[i], spans[a][0], spans[b - 1][1], gain, plain, n, len(self.words[i]), *differences(self.words[i], [s[2] for s in spans[a:b]])))
        return sorted(out, key=lambda x: (x[1], x[0]))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  most_differences: float = MOST_DIFFERENCES) -> DataFrame:
    """License notices in every whole text: a row per notice, with its exact wording differences.

    Returns id_col, template, start and end (code points), gain and plain_size (bytes), differences (words
    inserted, deleted or replaced), template_words, missing and added.

    Blocks lie around cue words.  Stretches of a block that have enough of a template's words are candidates; one that has fewer cannot hold a passage
    with at most ``most_differences`` of the template's words differing.  Every candidate is compressed plainly and with the template
    as raw zstandard dictionary, in lower case and with equal parameters: plain_size, and gain, the bytes that the template saves.  Candidates are ranked by
    gain less the size of the template when it is compressed with the candidate as dictionary.  In this order winners are aligned word by word, and a passage close enough
    is confirmed with its exact differences; of overlapping notices the one that compresses best wins, of those equal up to the grain of the compressor the
    closest wording.  No gain is asked for, so nothing
    that alignment of all templates would find is lost but to a better ranked notice at the same place.  A notice is found as often as it
    occurs.  Every template must hold a cue; a block with a cue is searched whole, however long.

    One pass without a shuffle.  Null or empty texts give no rows; null ids and repeated rows are reported
    for themselves.  Ties go to the longer template, then to the better ranked one.  An empty table gives no rows.  Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    for name, t in templates.items():
        if not _CUE.search(t):
            raise ValueError(f"template {name} holds no cue word")
    source = renamed(docs, id_col, text_col, to=("id", "text")).withColumn("id", F.col("id").cast("bigint"))
    reach = reach_of(templates)

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(batch.column(1), CUES), False).to_numpy(zero_copy_only=False))
            rows = [(batch.column(0)[i].as_py(), *r) for i in hit for r in scanner.scan(batch.column(1)[i].as_py(), reach, most_differences)]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.string()), pa.list_(pa.string())]
            names = ["id", "template", "start", "end", "gain", "plain_size", "differences", "template_words", "missing", "added"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return source.mapInArrow(run, FOUND).withColumnRenamed("id", id_col)
