"""Operator 5: licence scans with a generalised suffix automaton of licence words.

All templates (licence texts, notices and the base phrases) go into one suffix
automaton over words. A text is streamed through it once and gives its matching
statistics: at each word the longest match ending there. Matches that cannot be extended
are the maximal common passages; long ones are chained, in order in both the text and
the template, to covered template spans. A template of which a chain covers the share
``COVERAGE``, or ``CERTAIN`` words, adds its label. Base phrases are found at each place where the automaton's state,
or a state on its chain of suffix links, is the end of a whole phrase.

Plan: one pass over the documents without a shuffle; the automaton has at most two
states a template word and goes to the tasks. A text's words are not in the templates for
the most part: such words end all matches, so only runs of known words are walked.

Edge cases: null text is empty; texts without words score 0 and have empty labels; repeated
rows each come back; very long texts are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, COVERAGE, GAP, CERTAIN = 4, 0.6, 12, 10

#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Opening words and notices of public licences.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]

#: Whole texts of short public licences.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
     in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
     and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
     in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
     WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
     OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
     source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
     notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
     holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
     PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
     FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
     CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
     ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
     THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
     permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
     MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
     USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
     software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
     following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
     an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
     as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
     at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
     WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
     either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
     implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General
     Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
     either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
TEMPLATES = NOTICES + TEXTS

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"

SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))


def words_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of 0-9, a-z and all signs beyond ASCII."""
    return _words((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the ends of each state's string."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        for t, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word, ends)
                ends[last].add((t, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _new(self, length: int, ends: list, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, source: int, word: int, ends: list) -> int:
        """The state of source's longest string and the word, apart from longer strings."""
        target = self.next[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        clone = self._new(self.length[source] + 1, ends, target)
        self.link[target] = clone
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = clone
            source = self.link[source]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        state = self._new(self.length[last] + 1, ends)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        self.link[state] = 0 if last < 0 else self._split(last, word, ends)
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Matching statistics: the longest match that ends with this word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, long: int = LONG, coverage: float = COVERAGE, gap: int = GAP):
        self.long, self.coverage, self.gap = long, coverage, gap
        self.base, self.templates = base, templates
        texts = [words_of(t) for t, _ in base] + [words_of(t) for _, t in templates]
        self.size = [len(t) for t in texts]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.automaton = a = SuffixAutomaton([[self.number[w] for w in t] for t in texts])
        # of each state: the base phrases that end in it or in a state on its links
        whole = {}
        for k in range(len(base)):
            state = 0
            for w in texts[k]:
                state = a.next[state][self.number[w]]
            whole.setdefault(state, []).append(k)
        self.phrases = [()] * len(a.next)
        for state in sorted(range(1, len(a.next)), key=lambda s: a.length[s]):
            self.phrases[state] = (*whole.get(state, ()), *self.phrases[a.link[state]])

    def scan(self, text: str | None):
        words = words_of(text)
        get, a = self.number.get, self.automaton
        numbers = [get(w, 0) for w in words]
        places: list[tuple[int, int]] = []  # (first word, phrase)
        matches: list[tuple[int, int, int]] = []  # (last word, length, state), maximal ones
        state = length = 0
        run, i, n = self.long, 0, len(numbers)
        for i, word in enumerate(numbers):
            if not word:
                if length >= run:
                    matches.append((i - 1, length, state))
                state = length = 0
                continue
            before, was = state, length
            state, length = a.step(state, length, word)
            if was >= run and length <= was:
                matches.append((i - 1, was, before))
            for k in self.phrases[state]:
                if self.size[k] <= length:
                    places.append((i - self.size[k] + 1, k))
        if length >= run:
            matches.append((n - 1, length, state))
        return n, places, self._chain(matches)

    def _chain(self, matches):
        """Chains of matches in order in text and template: label, first, last word, covered share."""
        chains: dict[int, list] = {}
        best: dict[int, tuple] = {}
        for last, length, state in matches:
            for t, end in self.automaton.ends[state]:
                k = t - len(self.base)
                if k < 0:
                    continue
                start = last - length + 1
                now = chains.get(t)
                if now and start - now[1] <= self.gap and end - length + 1 > now[3]:
                    now[1], now[2], now[3] = last, now[2] + length, end
                else:
                    chains[t] = now = [start, last, length, end]
                share = min(1.0, now[2] / self.size[t])
                if share > best.get(t, (0,))[0]:
                    best[t] = (share, now[0], last)
        named = [(self.templates[t - len(self.base)][0], first, last, share, share * self.size[t]) for t, (share, first, last) in sorted(best.items())]
        return [(*s[:4], s[3] >= self.coverage or s[4] > CERTAIN - 0.5) for s in named]

    def row(self, text: str | None):
        n, places, spans = self.scan(text)
        base = sorted({self.base[k][1] for _, k in places})
        found = sorted({*base, *(s[0] for s in spans if s[4])})
        starts = [p for p, _ in places]
        score = 1.0 if places else max((s[3] for s in spans), default=0.0)
        return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(found), score, [dict(zip(("label", "first", "last", "share"), s)) for s in spans if s[4]]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, long: int = LONG, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id and SCHEMA."""
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS)]

    def run(batches):
        scanner = Scanner(templates, base, long, coverage, gap)
        for batch in batches:
            rows = [scanner.row(t) for t in batch.column("text").to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *(n for n, _ in fields)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + SCHEMA)
