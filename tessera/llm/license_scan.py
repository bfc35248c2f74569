"""License scans with a generalised suffix automaton over the words of templates.

The automaton of all templates' word sequences is walked once per text: after
each word it gives the longest run of words ending there that occurs in some
template, and by the state's suffix links in each one (the matching statistics). A phrase stands at a place exactly when the
statistic there is at least its length and the automaton's state has it as a
suffix. Runs of ``LEAST`` words or more that cannot be prolonged within a template
are its pieces, one for each place where it has them. The best chain of pieces, in order in both
text and template with at most ``GAP`` words of text between them, is found by
dynamic programming for each piece that may end one; a chain that covers ``COVERED``
of a template adds the template's label. Templates are whole public licences as well
as the sentences by which texts refer to them.

Defined results: null and empty texts have no words, no places and score 0;
repeated rows and equal texts get equal values; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Passages of public licences and notices, by label.
TEMPLATES = {
    "agpl": "gnu affero general public license version 3",
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "gnu lesser general public license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: Words of a match that takes part in a chain; words of text between chained matches; share of a template to cover.
LEAST, GAP, COVERED = 3, 12, 0.6

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: template -> the places, in words, where the state's runs end in it.
    ends: dict[int, set[int]] = field(default_factory=dict)
    #: (words, base label) of the phrases that end here.
    phrases: list[tuple[int, str]] = field(default_factory=list)


class Automaton:
    """Of the base phrases and the templates, which come after them in ``names``."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base_count = len(base)
        sequences = [p.encode().split() for p in base] + [t.encode().split() for t in templates.values()]
        self.names = [*base.values(), *templates]
        self.lengths = [len(s) for s in sequences]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.states = [State(0)]
        for k, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, self.vocabulary[word])
                self.states[last].ends.setdefault(k, set()).add(at + 1)
        for s in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            up = self.states[self.states[s].link]
            for k, places in self.states[s].ends.items():
                up.ends.setdefault(k, set()).update(places)
        self.states[0].ends.clear()
        self._at: dict[int, list[tuple[int, int]]] = {}
        for phrase, label in base.items():
            s = 0
            for word in phrase.encode().split():
                s = self.states[s].next[self.vocabulary[word]]
            self.states[s].phrases.append((len(phrase.split()), label))
        for s in sorted(range(1, len(self.states)), key=lambda i: self.states[i].length):
            self.states[s].phrases = self.states[s].phrases + self.states[self.states[s].link].phrases

    def _extend(self, last: int, word: int) -> int:
        st = self.states
        if word in st[last].next:
            to = st[last].next[word]
            return to if st[to].length == st[last].length + 1 else self._split(last, word, to)
        new = len(st)
        st.append(State(st[last].length + 1))
        p = last
        while p >= 0 and word not in st[p].next:
            st[p].next[word] = new
            p = st[p].link
        if p < 0:
            st[new].link = 0
        else:
            to = st[p].next[word]
            st[new].link = to if st[to].length == st[p].length + 1 else self._split(p, word, to)
        return new

    def _split(self, p: int, word: int, to: int) -> int:
        """The part of state ``to`` that is reached from p's runs gets a state of its own."""
        st = self.states
        part = len(st)
        st.append(State(st[p].length + 1, st[to].link, dict(st[to].next)))
        st[to].link = part
        while p >= 0 and st[p].next.get(word) == to:
            st[p].next[word] = part
            p = st[p].link
        return part

    def templates_at(self, state: int) -> list[tuple[int, int]]:
        """(template, state) of every template that holds a suffix of the state's runs, each with its longest such state."""
        got = self._at.get(state)
        if got is None:
            seen: dict[int, int] = {}
            up = state
            while up > 0:
                for k in self.states[up].ends:
                    seen.setdefault(k, up)
                up = self.states[up].link
            got = self._at[state] = sorted(seen.items())
        return got

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) after each word of the templates' vocabulary; other words end every match."""
        st, state, length, before = self.states, 0, 0, -2
        for at, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                continue
            if at != before + 1:
                state = length = 0
            before = at
            while state and w not in st[state].next:
                state = st[state].link
                length = st[state].length
            to = st[state].next.get(w)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield at, state, length


def chains(pieces: list[tuple[int, int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(text start, text end, template words covered) of the best chains, none sharing a place of the text; the best one comes first.

    A piece may follow one that ends before it in both text and template, at most ``gap``
    words of text earlier; where they overlap, only what is new counts.
    """
    pieces = sorted(set(pieces), key=lambda p: (p[1], p[3]))
    covered, start = [p[1] - p[0] for p in pieces], [p[0] for p in pieces]
    longest = max((p[1] - p[0] for p in pieces), default=0)
    low = 0
    for i, p in enumerate(pieces):
        while pieces[low][1] < p[1] - longest - gap:  # ends too early for any piece from here on
            low += 1
        for j in range(low, i):
            q = pieces[j]
            if p[0] - q[1] <= gap and q[1] < p[1] and q[3] < p[3]:
                new = covered[j] + min(p[1] - p[0], p[1] - q[1], p[3] - q[3])
                if new > covered[i] or (new == covered[i] and start[j] > start[i]):
                    covered[i], start[i] = new, start[j]
    out: list[tuple[int, int, int]] = []
    for i in sorted(range(len(pieces)), key=lambda i: (-covered[i], pieces[i][1])):
        a, b = start[i], pieces[i][1]
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, covered[i]))
    return out


def scan(machine: Automaton, words: list[bytes]) -> dict:
    """Base places, spans of chained matches, and the labels and score they give."""
    places: list[tuple[int, str]] = []
    pieces: dict[int, list[tuple[int, int, int, int]]] = {}  # template: (text start, text end, template start, template end)
    held: dict[int, tuple[int, int, int]] = {}  # template: place, state and length of the run that ends there

    def close(k: int) -> None:
        at, state, length = held.pop(k)
        pieces.setdefault(k, []).extend((at - length + 1, at + 1, end - length, end) for end in machine.states[state].ends[k])

    for at, state, length in machine.statistics(words):
        now = {k: (at, own, min(length, machine.states[own].length)) for k, own in machine.templates_at(state)} if length >= LEAST else {}
        for k, (last, _, before) in list(held.items()):
            if k not in now or last != at - 1 or now[k][2] != before + 1:
                close(k)
        held.update((k, v) for k, v in now.items() if v[2] >= LEAST)
        for size, label in machine.states[state].phrases:
            if length >= size:
                places.append((at - size + 1, label))
    for k in list(held):
        close(k)
    spans, best = [], 1.0 if places else 0.0
    for k, own in pieces.items():
        for a, b, covered in chains(own):
            best = max(best, covered / machine.lengths[k])
            if k >= machine.base_count and covered >= COVERED * machine.lengths[k]:
                spans.append((machine.names[k], a, b, covered / machine.lengths[k]))
    base = {label for _, label in places}
    return {"places": places, "spans": sorted(spans), "base": base, "labels": base | {s[0] for s in spans}, "score": min(1.0, best)}


def scan_documents(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Counts, first and last place, labels, score, and the covered spans of each row of ``docs(doc_id, text)``."""
    machine = Automaton(base, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    r = scan(machine, words)
                    at = [p for p, _ in r["places"]]
                    for k, v in zip(out, (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(r["base"])), ",".join(sorted(r["labels"])), r["score"], [{"label": n, "start": a, "end": b, "covered": c} for n, a, b, c in r["spans"]]), strict=True):
                        out[k].append(v)
                span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,covered:double>>"
    return common.columns_of(docs, "doc_id", "text").transform(common.map_arrow, run, schema)


def brute_force_base(text: str | None, base: dict[str, str] = BASE) -> tuple[int, list[int], str]:
    """Base places by comparing every position, for tests."""
    words = [w.decode() for w in words_of(text)]
    got = [(i, label) for phrase, label in base.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in got), ",".join(sorted({x for _, x in got}))
