"""Licence scan: a generalised suffix automaton of licence words gives the matching statistics of each text.

Words are runs of digits, letters and non-ASCII characters, ASCII-lowered. The automaton holds the words of every template;
fed with a text, it knows at each word the longest stretch ending there that some template contains. Stretches that cannot
grow are laid onto their template and chained in order; a template is found where a chain covers enough of it. Base phrases
are short templates: each place where a whole phrase ends counts.

A stretch of two or more words needs each pair of neighbours to stand in some template, so the automaton only steps through
runs of such pairs; elsewhere the statistic is at most 1 and no match that counts is lost.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

# Phrases whose places are counted, with their labels, and wordings of common licences.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("bsl", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
)
LEAST = 3  #: words of a stretch that is chained
WORD = re.compile("[0-9a-z]+")
COVER = 0.7  #: of a template's words for its label


class Automaton:
    """Suffix automaton of several word sequences; words are small numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        self.whole: list[list[int]] = []  #: of each state: sequences that are suffixes of what ends there
        ends = []
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word, places)
                places[last].add((k, i))
            ends.append(last)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            places[self.link[s]] |= places[s]
        self.places = [sorted(p) for p in places]
        self.whole = [[] for _ in self.next]
        for k, s in enumerate(ends):
            self.whole[s].append(k)
        for s in reversed(order):
            self.whole[s] = self.whole[s] + self.whole[self.link[s]]

    def _extend(self, last: int, word: int, places: list) -> int:
        if word in self.next[last]:
            to = self.next[last][word]
            if self.length[to] == self.length[last] + 1:
                return to
            return self._clone(last, word, to, places)
        new = self._state(self.length[last] + 1, {}, places)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            to = self.next[last][word]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self._clone(last, word, to, places)
        return new

    def _state(self, length: int, following: dict[int, int], places: list) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        places.append(set())
        return len(self.next) - 1

    def _clone(self, last: int, word: int, to: int, places: list) -> int:
        twin = self._state(self.length[last] + 1, dict(self.next[to]), places)
        self.link[twin], self.link[to] = self.link[to], twin
        while last >= 0 and self.next[last].get(word) == to:
            self.next[last][word] = twin
            last = self.link[last]
        return twin

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """For each word: the state and length of the longest stretch ending there."""
        out, state, length = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                length = 0
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.base = len(phrases)
        texts = [WORD.findall(t.lower()) for t in [*(t for t, _ in phrases), *(t for _, t in templates)]]
        vocabulary = sorted({w for t in texts for w in t})
        c = next(tk.chunks(pa.array(vocabulary)))
        hashes = tk.words(c, np.ones(256, bool)).hash
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.hashes >> np.uint64(48)] = True
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[number[w] for w in t] for t in texts]
        self.automaton = Automaton(self.sequences)
        self.pairs = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)
        for s in self.sequences:
            self.pairs[s[:-1], s[1:]] = True
        # A run of two words only matters if they are a whole template.
        self.short = np.zeros_like(self.pairs)
        for s in self.sequences:
            if len(s) == 2:
                self.short[s[0], s[1]] = True

    def runs(self, w: tk.Words) -> list[tuple[int, int, list[int]]]:
        """(first word, end, word numbers) of runs that the automaton steps through; none spans two texts."""
        number = np.full(len(w.hash), -1)
        near = np.flatnonzero(self.sieve[w.hash >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.hashes, w.hash[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == w.hash[near]
        number[near[hit]] = self.order[at[hit]]
        if len(number) < 2:
            return []
        joined = self.pairs[number[:-1], number[1:]] & (number[:-1] >= 0)
        inner = w.first[(w.first > 0) & (w.first < len(number))]
        joined[inner - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2] + 1
        keep = (b - a > 2) | self.short[number[a], number[np.minimum(a + 1, len(number) - 1)]]
        return [(s, e, number[s:e].tolist()) for s, e in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]

    def scan(self, c: tk.Chunk) -> list[dict]:
        """For each text: its words, base places (start, phrase) and matches (start, length, template, place in it)."""
        w = tk.words(c, tk.ALNUM)
        out = [{"words": int(n), "base": [], "matches": []} for n in np.diff(w.first)]
        for first, end, sequence in self.runs(w):
            d = int(np.searchsorted(w.first, first, "right")) - 1
            found = self.automaton.statistics(sequence)
            for i, (state, length) in enumerate(found):
                at = first + i - int(w.first[d])
                for k in self.automaton.whole[state]:
                    if k < self.base and len(self.sequences[k]) <= length:
                        out[d]["base"].append((at - len(self.sequences[k]) + 1, k))
                if length >= LEAST and (i + 1 == len(found) or found[i + 1][1] <= length):
                    for k, place in self.automaton.places[state]:
                        out[d]["matches"].append((at - length + 1, length, k, place - length + 1))
        return out

    def covered(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[float, int, int, int]]:
        """(share, template, first word, end) of each template's best chain: matches in the text's and the template's order.

        A text's matches with a template form clusters, parted where a gap is longer than the template; each is chained alone.
        """
        best: dict[int, tuple[float, int, int, int]] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, k, place in matches:
            by.setdefault(k, []).append((start, length, place))
        for k, own in by.items():
            size, own = len(self.sequences[k]), sorted(own)
            cluster: list[tuple[int, int, int]] = []
            for m in [*own, None]:
                if cluster and (m is None or m[0] - (cluster[-1][0] + cluster[-1][1]) > size or m[0] - cluster[0][0] > 3 * size):
                    total, begin = [], []
                    for j, (s, n, p) in enumerate(cluster):
                        most, first = n, s
                        for i in range(j):
                            s0, n0, p0 = cluster[i]
                            over = max(0, s0 + n0 - s, p0 + n0 - p)
                            if s0 < s and p0 < p and over < n and total[i] + n - over > most:
                                most, first = total[i] + n - over, begin[i]
                        total.append(most)
                        begin.append(first)
                    j = max(range(len(cluster)), key=total.__getitem__)
                    share = min(1.0, total[j] / size)
                    if share > best.get(k, (0,))[0]:
                        best[k] = (share, k, begin[j], cluster[j][0] + cluster[j][1])
                    cluster = []
                if m is not None:
                    cluster.append(m)
        return sorted(best.values(), key=lambda x: (-x[0], x[1]))


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,share:double>>"


def _scanned(column: pa.Array) -> pa.Array:
    own, rows = scanner(), []
    for c in tk.chunks(column):
        for found in own.scan(c):
            base, chains = found["base"], own.covered(found["matches"])
            base_labels = {own.labels[k] for _, k in base}
            spans = [{"label": own.labels[k], "first": a, "end": b, "share": s} for s, k, a, b in chains if s >= COVER]
            starts = [s for s, _ in base]
            rows.append({"n_words": found["words"], "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {x["label"] for x in spans})), "score": 1.0 if base else max((s for s, *_ in chains), default=0.0), "spans": spans})
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])))])
    return pa.array(rows, kind)


def scan(text: Column) -> Column:
    """Struct RESULT for a text column; a null text is an empty one, with no words and the score 0."""
    return F.arrow_udf(_scanned, RESULT)(text)


def op4(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the digest; labels are distinct, sorted and comma-joined, empty if there are none.

    A null or empty text has no words, no labels and the score 0. A text of any length is scanned whole. Rows with one id, equal
    rows and rows without an id each give their own row; of chains that cover as much, the first counts. Extra columns are left
    out. An empty table gives no rows.
    """
    return docs.select("doc_id", scan(F.col("text")).alias("s")).select("doc_id", *(f"s.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))
