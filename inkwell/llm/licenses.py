"""License scans: words of whole texts run through a suffix automaton of templates.

The automaton holds every run of words of all license templates.  A text's words stream
through it; at each word it knows the longest run of some template that ends there (the
matching statistics).  Runs that cannot be made longer and have enough words are chained
where they follow each other in the text and in a template alike; a chain that covers
enough of its template is a span of that license.  Phrases are templates too: one ends
wherever its state is among the suffixes of the longest run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .automaton import SuffixAutomaton
from .shared import slices

#: Label and words of the phrases that count as such wherever they stand.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Label and text of the templates; several may have one label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0", "Licensed under CC0 1.0 Universal Public Domain Dedication"),
)


@dataclass(frozen=True)
class Scan:
    """``least``: words of a match that counts; ``gap``: words that may differ between
    two matches of a chain, in text and template; ``percent``: words of a template that
    a chain must cover to be a span."""

    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    least: int = 4
    gap: int = 12
    percent: int = 80


#: Bytes of words are kept in lower case, all others become spaces.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


@dataclass
class Chain:
    """Matches of one template that follow each other; places are inclusive."""

    first: int
    last: int
    place: int
    covered: int


class Scanner:
    def __init__(self, scan: Scan):
        self.scan = scan
        self.labels = [x for x, _ in (*scan.templates, *scan.phrases)]
        sequences = [words_of(x) for _, x in (*scan.templates, *scan.phrases)]
        self.sizes = list(map(len, sequences))
        if not all(self.sizes):
            raise ValueError("a template or phrase has no word")
        self.automaton = SuffixAutomaton(sequences, scan.least)
        ended: dict[int, list[tuple[str, int]]] = {}
        for (label, _), own in zip(scan.phrases, sequences[len(scan.templates) :], strict=True):
            ended.setdefault(self.automaton.state_of(own), []).append((label, len(own)))
        #: Of each state, the phrases that its runs end with.
        self.phrases = [[p for s in self.automaton.chain(state) for p in ended.get(s, ())] for state in range(len(self.automaton.next))]

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """Longest runs as (last place, words, state), and the phrases' (start, label)."""
        runs, places, least, phrases = [], [], self.scan.least, self.phrases
        before = (0, 0)
        for i, now in enumerate(self.automaton.statistics(words)):
            if before[1] >= least and now[1] != before[1] + 1:
                runs.append((i - 1, before[1], before[0]))
            if phrases[now[0]]:
                places += [(i + 1 - n, label) for label, n in phrases[now[0]] if n <= now[1]]
            before = now
        if before[1] >= least:
            runs.append((len(words) - 1, before[1], before[0]))
        return runs, places

    def chains(self, runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, Chain]]:
        """All chains, with their template's number, as they end.

        A run goes on the chain with which it covers most, or starts one.  Of the chains
        that have come to one place of a template, the one that covers most is kept, so
        no more are open than the templates have words."""
        open_: dict[int, dict[int, Chain]] = {}
        gap = self.scan.gap
        for last, n, state in runs:
            first = last - n + 1
            for k in [k for k, c in open_.items() if all(x.last + gap < first - 1 for x in c.values())]:
                yield from ((k, x) for x in open_.pop(k).values())
            for k, place in self.automaton.ends[state]:
                if k >= len(self.scan.templates):
                    continue
                own, best = open_.setdefault(k, {}), Chain(first, last, place, n)
                for x in list(own.values()):
                    if x.last + gap < first - 1:
                        yield k, own.pop(x.place)
                    elif x.last < last and x.place < place and place - n - x.place <= gap:
                        more = min(n, last - x.last, place - x.place)
                        if x.covered + more > best.covered:
                            best = Chain(x.first, last, place, x.covered + more)
                if place in own and own[place].covered >= best.covered and own[place].last == last:
                    continue
                if place in own:
                    yield k, own.pop(place)
                own[place] = best
        for k, c in open_.items():
            yield from ((k, x) for x in c.values())

    def of(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = words_of(text)
        runs, places = self.matches(words)
        base = sorted({label for _, label in places})
        score, found = float(bool(places)), []
        for k, c in self.chains(runs):
            score = max(score, min(1.0, c.covered / self.sizes[k]))
            if 100 * c.covered >= self.scan.percent * self.sizes[k]:
                found.append((self.labels[k], c.first, -c.covered, c.last, k))
        spans: list[dict] = []
        for label, first, covered, last, k in sorted(found):
            span = {"label": label, "first_word": first, "last_word": last, "covered": -covered, "share": min(1.0, -covered / self.sizes[k])}
            if spans and spans[-1]["label"] == label and first <= spans[-1]["last_word"]:
                if span["covered"] > spans[-1]["covered"]:
                    spans[-1] = span
            else:
                spans.append(span)
        starts = [p for p, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(s["label"] for s in spans)})), score, spans


@lru_cache(maxsize=4)
def scanner(scan: Scan) -> Scanner:
    """Built once in each worker."""
    return Scanner(scan)


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, covered: long, share: double>>"


def scan_licenses(docs: DataFrame, scan: Scan | None = None) -> DataFrame:
    """doc_id and what every text of ``docs`` (doc_id, text; other columns are not read)
    holds of licenses.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the first
    and last of them (words from 0; null where there is none), ``base_labels`` their labels;
    ``labels`` has those of the spans too, ``score`` is the largest share of a template that
    a chain covers (1 where a phrase stands).  Of overlapping spans with one label the one
    that covers more stays.  A null or empty text has no words, no labels and score 0;
    repeated rows give equal rows; an empty table gives none.
    """
    s = scan or Scan()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}"
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(s)
        for b in slices(batches):
            rows = [own.of(t.as_py()) for t in b.column("text")]
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), list(fields)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
