"""Licence scans by a generalised suffix automaton over licence tokens.

One automaton holds every factor of all templates. A text is streamed through it: at each word it gives
the matching statistics, the length of the longest template factor that ends there and its state.
Long matches are chained, per template, into spans covering a good part of it. The base
phrases are templates too; a phrase ends where the state of its whole string is an ancestor of the
state reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import common as K

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices, as their publishers word them.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)

# Whole licences, as their publishers word them, from the first grant to the end.
LICENCES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
)
TEMPLATES = (*TEMPLATES, *LICENCES)

MIN_MATCH = 4
COVERED = 0.75
MAX_GAP = 6


class Automaton:
    """Suffix automaton of several word sequences, with the states where phrases and prefixes end."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, K.alnum_words(text)) for label, text in templates]
        self.phrases = [(label, K.alnum_words(text)) for text, label in phrases.items()]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: By state: (template, end) of every template place that it stands for.
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, (_, words) in enumerate([*self.templates, *self.phrases]):
            self._add(k, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        # Phrases that end at a state: those whose own state is the state or one of its ancestors.
        own: dict[int, tuple[int, int]] = {}
        for k, (_, words) in enumerate(self.phrases):
            s = 0
            for w in words:
                s = self.next[s][self.vocab[w]]
            own[s] = (k, len(words))
        self.phrase_ends: list[list[tuple[int, int]]] = []
        for s in range(len(self.next)):
            found, t = [], s
            while t > 0:
                if t in own:
                    found.append(own[t])
                t = self.link[t]
            self.phrase_ends.append(found)

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p's transition on c may share: a shorter copy of it where needed."""
        q = self.next[p][c]
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, k: int, codes: list[int]) -> None:
        last = 0
        for at, c in enumerate(codes):
            if c in self.next[last]:
                new = self._split(last, c)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                self.link[new] = self._split(p, c) if p >= 0 else 0
            last = new
            self.ends[last].append((k, at + 1))

    def scan(self, codes: list[int], start: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Matches (state, length, end) that no longer one continues, and phrases (phrase, start) in a run of words."""
        matches, phrases = [], []
        state = length = 0
        for i, c in enumerate(codes):
            before = (state, length)
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            if before[1] >= MIN_MATCH and length <= before[1]:
                matches.append((*before, start + i))
            for k, n in self.phrase_ends[state]:
                if length >= n:
                    phrases.append((k, start + i + 1 - n))
        if length >= MIN_MATCH:
            matches.append((state, length, start + len(codes)))
        return matches, phrases

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, share of the template covered) of matches in order, per template."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for state, length, end in matches:
            for k, t_end in self.ends[state]:
                if k < len(self.templates):
                    by.setdefault(k, []).append((end - length, end, t_end))
        out = []
        for k, spans in by.items():
            size = len(self.templates[k][1])
            open_: list[tuple[int, int, int, int]] = []  # start, end, template end, words covered
            for a, b, t in sorted(spans):
                t_start = t - (b - a)
                best = max((x for x in open_ if x[1] <= a <= x[1] + MAX_GAP and x[2] <= t_start <= x[2] + MAX_GAP), key=lambda x: x[3], default=None)
                open_.append((best[0], b, t, best[3] + b - a) if best else (a, b, t, b - a))
                open_ = [x for x in open_ if x[1] + MAX_GAP >= a] if len(open_) > 64 else open_
                s, e, _, n = open_[-1]
                if n >= COVERED * size:
                    out.append((k, s, e, n / size))
        return out


def find(text: str | None, automaton: Automaton) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
    """(number of words, phrases (phrase, start), covered spans (template, start, end, share)) of a whole text."""
    words = K.alnum_words(text)
    codes = np.fromiter((automaton.vocab.get(w, -1) for w in words), np.int64, len(words))
    known = np.concatenate([[0], (codes >= 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    phrases, matches = [], []
    # Only runs of template words can match; the automaton starts anew after any other word.
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= 2:
            m, p = automaton.scan(codes[a:b].tolist(), a)
            matches += m
            phrases += p
    return len(words), phrases, automaton.chains(matches)


def scan(docs: DataFrame, text: str = "text", into: str = "licence", templates=TEMPLATES) -> DataFrame:
    """Every row of `docs` with a struct column `into`.

    n_words; n_base, first_word, last_word and base_labels for the base phrases; labels with the
    covered templates' too; spans (template label:start word:end word); score, the largest covered
    share, 1 for a base phrase. Null and empty texts have no word: counts 0, places null, labels
    empty, score 0. Rows are kept as they are, repeated ones too. No shuffle.
    """
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans string, score double"

    @F.pandas_udf(kind)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(templates)
        for s in batches:
            rows = []
            for t in s:
                n, phrases, covered = find(t, automaton)
                at = [p for _, p in phrases]
                base = {automaton.phrases[k][0] for k, _ in phrases}
                more = {automaton.templates[k][0] for k, *_ in covered}
                spans = sorted({(a, b, automaton.templates[k][0]) for k, a, b, _ in covered})
                score = 1.0 if at else max((x for *_, x in covered), default=0.0)
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), ",".join(f"{x}:{a}:{b}" for a, b, x in spans), min(score, 1.0)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(into, scanned(F.col(text)))
