"""Operator 11: license scans by matching statistics over a generalised suffix automaton.

All license texts, as words, go into one suffix automaton. Streaming a document through it gives at every word the longest stretch ending
there that some license holds. Stretches that can't grow to the right and are long enough are placed in the licenses that hold them and
chained: same license, in order, with few words between. A chain that covers enough of a license is a span of it. Phrases that alone
name a license stand in the automaton too and count at every place.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import arrow_rows

# Phrases that name a license by themselves, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of public licenses, by label.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD License", "Released under the BSD License",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU Lesser General Public License",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}

# Letters A to Z become small, all other ASCII characters but digits and letters part words; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Scan:
    """``least`` words make a match long (a shorter template: all its words), ``gap`` words may lie between chained ones, ``cover`` is the share of a template that makes a span."""

    phrases: dict[str, str] = field(default_factory=lambda: PHRASES)
    templates: dict[str, tuple[str, ...]] = field(default_factory=lambda: TEMPLATES)
    least: int = 4
    gap: int = 12
    cover: float = 0.7


class Automaton:
    """A generalised suffix automaton of word sequences; states know where in the sequences their words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, c in enumerate(sequence):
                last = self._extend(last, c, ends)
                ends[last].add((k, at + 1))
        # An end of a state is one of all its suffixes, too.
        for state in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _extend(self, last: int, c: int, ends: list) -> int:
        nxt, link, size = self.next, self.link, self.len
        known = nxt[last].get(c)
        if known is not None:
            return known if size[known] == size[last] + 1 else self._clone(last, known, c, ends)
        state = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[state] = q if size[q] == size[p] + 1 else self._clone(p, q, c, ends)
        return state

    def _clone(self, p: int, q: int, c: int, ends: list) -> int:
        """A state for the words of ``q`` that ``p`` can be continued to, which are shorter than the others of ``q``."""
        nxt, link, size = self.next, self.link, self.len
        state = len(size)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        ends.append(set())
        link[q] = state
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = state
            p = link[p]
        return state

    def stream(self, words: list[int]):
        """Matching statistics: after every word, the state and the length of the longest stretch ending there."""
        nxt, link, size = self.next, self.link, self.len
        state = length = 0
        for c in words:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = nxt[state].get(c)
            if to is None:
                length = 0
            else:
                state = to
                length += 1
            yield state, length


class Scanner:
    """Licenses read once by a worker."""

    def __init__(self, scan: Scan):
        self.scan = scan
        self.vocabulary: dict[bytes, int] = {}
        texts = [(label, words_of(text)) for label, texts in scan.templates.items() for text in texts]
        self.names = list(scan.phrases.items())
        code = lambda words: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        sequences = [code(words_of(p)) for p, _ in self.names] + [code(w) for _, w in texts]
        self.label = [label for _, label in self.names] + [label for label, _ in texts]
        self.size = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        # Phrases that are a suffix of a state's words: their own states lie on its suffix path.
        own: dict[int, list[int]] = {}
        for k in range(len(self.names)):
            state = 0
            for c in sequences[k]:
                state = self.automaton.next[state][c]
            own.setdefault(state, []).append(k)
        self.phrases: list[list[int]] = [[] for _ in self.automaton.len]
        for state in sorted(range(1, len(self.phrases)), key=lambda v: self.automaton.len[v]):
            self.phrases[state] = own.get(state, []) + self.phrases[self.automaton.link[state]]

    def document(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words, (start, phrase) of every phrase, and (template, first word, last word, share covered) of every span."""
        words = words_of(text)
        n = len(words)
        code = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        near = np.zeros(n + 2, bool)
        near[1:-1] = code >= 0
        both = near[1:] & near[:-1]
        if not both.any():
            return n, [], []
        # Stretches of words known to some license; a single one is no match.
        edge = np.flatnonzero(np.diff(near))
        places, matches, least = [], [], self.scan.least
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if high - low < 2:
                continue
            before = (0, 0)
            for at, now in enumerate(self.automaton.stream(code[low:high].tolist()), low):
                state, length = now
                if self.phrases[state]:
                    places += [(at + 1 - self.size[k], k) for k in self.phrases[state] if self.size[k] <= length]
                if length <= before[1]:
                    self._place(matches, at, *before, least)
                before = now
            self._place(matches, high, *before, least)
        return n, sorted(places), self._chains(matches)

    def _place(self, matches: list, end: int, state: int, length: int, least: int) -> None:
        """Matches (template, document start, document end, template start) of a stretch that can't grow to the right."""
        for k, at in self.automaton.ends[state] if length >= 2 else ():
            # A state's ends hold for as many of its words as were matched.
            if k >= len(self.names) and length >= min(least, self.size[k]) and at >= length:
                matches.append((k, end - length, end, at - length))

    def _chains(self, matches: list) -> list[tuple[int, int, int, float]]:
        """Per template, disjoint chains of matches that cover enough of it, from the best on."""
        out, by = [], {}
        for m in matches:
            by.setdefault(m[0], []).append(m[1:])
        for k, found in by.items():
            found.sort(key=lambda m: (m[1], m[0]))
            best, head = [], []
            for i, (start, end, at) in enumerate(found):
                worth, first = end - start, i
                j = i - 1
                # Matches are in the order of their ends; none that ends too far before can be chained.
                while j >= 0 and found[j][1] >= start - self.scan.gap:
                    s, e, t = found[j]
                    over = max(0, e - start, t + e - s - at)
                    if s < start and t < at and over < end - start and at - (t + e - s) <= self.scan.gap and best[j] + end - start - over > worth:
                        worth, first = best[j] + end - start - over, head[j]
                    j -= 1
                best.append(worth)
                head.append(first)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(found)), key=lambda i: (-best[i], found[i])):
                if best[i] < self.scan.cover * self.size[k]:
                    break
                low, high = found[head[i]][0], found[i][1]
                place = bisect(taken, (low, high))
                if (not place or taken[place - 1][1] <= low) and (place == len(taken) or high <= taken[place][0]):
                    taken.insert(place, (low, high))
                    out.append((k, low, high - 1, min(1.0, best[i] / self.size[k])))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


_SCANNERS: dict[str, Scanner] = {}


def scanner(scan: Scan) -> Scanner:
    key = repr(scan)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(scan)
    return _SCANNERS[key]


def scan_documents(documents: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """``doc_id, n_words, phrases, spans`` of every text.

    ``phrases`` are (label, first_word, last_word) of every place of a phrase, ``spans`` (label, first_word, last_word, coverage) of every chain that covers
    enough of a template, in words from 0. A null or empty text has no words and neither; a null doc_id stays null; repeated rows
    give repeated rows, an empty table none; other columns are not looked at. Nothing is shuffled; work is in proportion
    to the words and, for stretches that licenses hold, to the places that hold them.
    """
    def run(doc_id, text):
        s = scanner(scan)
        out = {"doc_id": doc_id, "n_words": [], "phrases": [], "spans": []}
        for t in text:
            n, places, spans = s.document(t)
            out["n_words"].append(n)
            out["phrases"].append([{"label": s.label[k], "first_word": a, "last_word": a + s.size[k] - 1} for a, k in places])
            out["spans"].append([{"label": s.label[k], "first_word": a, "last_word": b, "coverage": c} for k, a, b, c in spans])
        return out

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, n_words bigint, phrases array<struct<label:string,first_word:bigint,last_word:bigint>>, spans array<struct<label:string,first_word:bigint,last_word:bigint,coverage:double>>", run)


def report(documents: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every text, from ``scan_documents``.

    ``first_word`` and ``last_word`` are the smallest and the largest start of a phrase, null without one. The score is 1 where a phrase stands,
    else the largest share of a template that a span covers, 0 without span.
    """
    found = scan_documents(documents, scan)
    starts = F.transform("phrases", lambda p: p["first_word"])
    base = F.transform("phrases", lambda p: p["label"])
    both = F.concat(base, F.transform("spans", lambda s: s["label"]))
    covered = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(covered, F.lit(0.0))).alias("score"),
    )
