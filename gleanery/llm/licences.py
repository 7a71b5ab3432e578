"""Licence scans by a generalised suffix automaton of licence tokens.

1. *Templates.* Notices and key paragraphs of common licences, as lists of words, are put into
   one suffix automaton; each state knows where in which templates its strings end.
2. *Matching statistics.* A text is streamed through the automaton word by word; at each word it
   gives the longest string of any template that ends there. Words that no template holds next to
   each other can't be part of a match of two words, so only stretches of template word pairs
   are streamed.
3. *Base places.* The base phrases are templates too: one ends wherever its state, or a state beneath
   it in the suffix tree, is reached.
4. *Chains.* Matches that can't be made longer are chained, in order of text and template, over gaps
   of up to ``GAP`` words. A chain that covers enough of its template and holds a string
   no other licence has is a span; of spans that overlap the one that covers most words stays.

A row is one text's work; a text is cut into stretches and kept as word numbers of four bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 8
#: Share of a template's words that a span must cover.
COVER = 0.6
SLICE_CHARS = 1 << 18
#: Capitals A-Z to small letters, every other ASCII sign but digits and letters to a blank.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)

# Base phrases, and wording of licences and their notices.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
OPENINGS = (
    "",
    "licensed under the",
    "released under the",
    "distributed under the",
    "this work is licensed under the",
    "available under the terms of the",
)
NAMES = {
    "agpl": ("GNU Affero General Public License version 3",),
    "apache": ("Apache License, Version 2.0", "Apache 2.0 license", "Apache Software License"),
    "artistic": ("Artistic License 2.0",),
    "boost": ("Boost Software License, Version 1.0",),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License"),
    "cc0": ("CC0 1.0 Universal", "Creative Commons Zero"),
    "epl": ("Eclipse Public License 2.0",),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL"),
    "isc": ("ISC License",),
    "lgpl": ("GNU Lesser General Public License version 3", "GNU Library General Public License"),
    "mit": ("MIT License",),
    "mpl": ("Mozilla Public License, version 2.0",),
    "odbl": ("Open Database License",),
    "unlicense": ("Unlicense license",),
    "zlib": ("zlib License",),
}
COMMONS = {
    "cc-by": ("CC BY", "Attribution"),
    "cc-by-nc": ("CC BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-nd": ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "cc-by-nc-sa": ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nd": ("CC BY-ND", "Attribution-NoDerivatives"),
    "cc-by-sa": ("CC BY-SA", "Attribution-ShareAlike"),
}
PARAGRAPHS = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def templates() -> list[tuple[str, list[bytes]]]:
    """(label, words): base phrases, every opening (or none) with every name, licence paragraphs."""
    found = [(label, phrase) for phrase, label in BASE]
    found += [(label, f"{opening} {name}") for label, names in NAMES.items() for name in names for opening in OPENINGS]
    for label, (short, long) in COMMONS.items():
        found += [(label, f"{verb} under {short} 4.0") for verb in ("licensed", "released", "this work is licensed")]
        found += [(label, f"licensed under a Creative Commons {long} 4.0 International License")]
    found += list(PARAGRAPHS)
    return [(label, words_of(text)) for label, text in found]


@dataclass
class Automaton:
    """Suffix automaton of several lists of numbers."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the longest string of p plus the word, cut out of a longer state if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        fresh = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = fresh
            p = self.link[p]
        self.link[fresh] = self._split(p, word) if p >= 0 else 0
        return fresh

    def add(self, words: Sequence[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def read(self, words: Sequence[int]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Per word (state, length) of the longest added string that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


@dataclass
class Span:
    label: str
    first_word: int
    last_word: int
    covered: int
    coverage: float


class Scanner:
    """The templates' automaton and what is read from it."""

    def __init__(self, gap: int = GAP, cover: float = COVER) -> None:
        self.gap, self.cover = gap, cover
        known = templates()
        self.labels = [label for label, _ in known]
        self.sizes = [len(words) for _, words in known]
        self.numbers: dict[bytes, int] = {}
        lists = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] for _, words in known]
        self.automaton = Automaton()
        for words in lists:
            self.automaton.add(words)
        a = self.automaton
        #: Per state: (template, place of the last word) of its strings; per pair of words: is it in a template.
        self.ends: list[set[tuple[int, int]]] = [set() for _ in a.next]
        self.pairs = np.zeros((len(self.numbers) + 1,) * 2, dtype=bool)
        for t, words in enumerate(lists):
            state = 0
            for i, word in enumerate(words):
                state = a.next[state][word]
                self.ends[state].add((t, i))
            self.pairs[words[:-1], words[1:]] = True
        order = sorted(range(1, len(a.next)), key=lambda s: -a.length[s])
        for s in order:
            self.ends[a.link[s]] |= self.ends[s]
        self.specific = [len({self.labels[t] for t, _ in e}) == 1 for e in self.ends]
        #: Per state: (base phrase, its words) of the base phrases that end wherever the state is reached.
        self.base: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for b, (phrase, _) in enumerate(BASE):
            words = [self.numbers[w] for w in words_of(phrase)]
            self.base[a.read(words)].append((b, len(words)))
        for s in reversed(order):
            self.base[s] = self.base[s] + self.base[a.link[s]]

    def word_numbers(self, text: str) -> np.ndarray:
        number = self.numbers.get
        found, at = [], 0
        while at < len(text):
            end = min(at + SLICE_CHARS, len(text))
            while end < len(text) and (text[end].isalnum() or text[end] > "\x7f"):
                end += 1
            found.append(np.array([number(w, 0) for w in words_of(text[at:end])], dtype=np.int32))
            at = end
        return np.concatenate(found) if found else np.empty(0, dtype=np.int32)

    def scan(self, words: np.ndarray) -> tuple[list[tuple[int, int]], list[Span]]:
        """Base places (phrase, first word), and spans in order."""
        good = np.nonzero(self.pairs[words[:-1], words[1:]])[0] if len(words) > 1 else []
        if not len(good):
            return [], []
        breaks = np.nonzero(np.diff(good) != 1)[0]
        places: list[tuple[int, int]] = []
        clusters: list[list[tuple[int, int, int]]] = []  # matches (first word, length, state) near each other
        end = -1
        for i, j in zip(good[np.append(0, breaks + 1)], good[np.append(breaks, len(good) - 1)], strict=True):
            steps = list(self.automaton.statistics(words[i : j + 2].tolist()))
            for k, (state, length) in enumerate(steps):
                places += [(b, int(i) + k - m + 1) for b, m in self.base[state] if length >= m]
                if length > 1 and (k + 1 == len(steps) or steps[k + 1][1] != length + 1):
                    first = int(i) + k - length + 1
                    if not clusters or first - end - 1 > self.gap:
                        clusters.append([])
                    clusters[-1].append((first, length, state))
                    end = int(i) + k
        spans = [s for c in clusters if any(self.specific[m[2]] for m in c) for s in self._chains(c)]
        return places, self._apart(spans)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        by_template: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
        for first, length, state in matches:
            for t, last in self.ends[state]:
                by_template[t].append((first, last - length + 1, length, self.specific[state]))
        spans = []
        for t, anchors in by_template.items():
            if any(a[3] for a in anchors):
                spans += self._chain(t, sorted(anchors))
        return spans

    def _chain(self, t: int, anchors: list[tuple[int, int, int, bool]]) -> list[Span]:
        """Best chains of (word, template word, length, specific), each anchor in one at most."""
        covered = [a[2] for a in anchors]
        before = [-1] * len(anchors)
        low = 0
        widest = max(a[2] for a in anchors)
        for i, (word, place, length, _) in enumerate(anchors):
            while anchors[low][0] + widest + self.gap < word:
                low += 1
            for j in range(low, i):
                w, p, n, _ = anchors[j]
                if w >= word or p >= place or w + n + self.gap < word or p + n >= place + length:
                    continue
                fresh = length - max(0, w + n - word, p + n - place)
                if fresh > 0 and covered[j] + fresh > covered[i]:
                    covered[i], before[i] = covered[j] + fresh, j
        used = [False] * len(anchors)
        spans = []
        for i in sorted(range(len(anchors)), key=lambda i: (-covered[i], i)):
            if covered[i] < self.cover * self.sizes[t]:
                break
            chain, at = [], i
            while at >= 0 and not used[at]:
                chain.append(at)
                at = before[at]
            if at >= 0 or used[i]:
                continue  # part of a better chain
            for c in chain:
                used[c] = True
            if any(anchors[c][3] for c in chain):
                last = max(anchors[c][0] + anchors[c][2] - 1 for c in chain)
                spans.append(Span(self.labels[t], anchors[chain[-1]][0], last, covered[i], covered[i] / self.sizes[t]))
        return spans

    def _apart(self, spans: list[Span]) -> list[Span]:
        """Of spans that overlap, the one that covers most words (then most of its template) stays."""
        kept: list[Span] = []
        free = _Free()
        for s in sorted(spans, key=lambda s: (-s.covered, -s.coverage, s.first_word, s.label)):
            if free.take(s.first_word, s.last_word):
                kept.append(s)
        return sorted(kept, key=lambda s: s.first_word)


class _Free:
    """Word ranges handed out so far, at most one a word."""

    def __init__(self) -> None:
        self.taken: set[int] = set()

    def take(self, first: int, last: int) -> bool:
        if any(w in self.taken for w in range(first, last + 1)):
            return False
        self.taken.update(range(first, last + 1))
        return True


SPANS = "array<struct<label:string,first_word:long,last_word:long,covered:long,coverage:double>>"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    f"score double, spans {SPANS}"
)
SPAN_TYPE = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]
)


def scan(docs: DataFrame, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row.

    ``docs`` is (doc_id, text); other columns are not read. Null texts count as empty; null ids stay
    null; rows that repeat are returned each. ``n_base`` counts all places of the base phrases;
    ``labels`` are theirs and those of the spans, distinct, sorted, comma-joined ('' without any).
    ``score`` is 0 without a place or span, else the best of coverage * covered / (covered + 2)
    over the spans and, as fully covered templates, the base places: it nears 1 for whole texts.
    """
    scanner = Scanner(gap, cover)
    base_words = [len(words_of(p)) for p, _ in BASE]

    def digest(text: str) -> tuple:
        words = scanner.word_numbers(text)
        places, spans = scanner.scan(words)
        labels = {BASE[b][1] for b, _ in places}
        starts = [at for _, at in places]
        best = [base_words[b] / (base_words[b] + 2) for b in {b for b, _ in places}]
        best += [s.coverage * s.covered / (s.covered + 2) for s in spans]
        return (
            len(words),
            len(places),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {s.label for s in spans})),
            max(best, default=0.0),
            [vars(s) for s in spans],
        )

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(SPAN_TYPE)]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            if frame.num_rows:
                rows = [digest(text.as_py()) for text in frame.column("text")]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([frame.column("doc_id"), *columns], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(batches, SCHEMA)
