"""Licence scans by a generalised suffix automaton of licence templates.

All templates and phrases together make one automaton over word numbers. A text
is streamed through it: after each word the automaton is in the state of the
longest run of words ending there that some template contains, which gives the
matching statistics. Phrases that end there lie on the state's suffix links.
Runs of at least ``MATCH`` words that the next word doesn't prolong are anchors;
anchors in the same order and close together in text and template are chained,
and a chain that covers at least ``SHARE`` of a template's words is a span.

A match of two words or more consists of adjacent template words only, so words
in between need not be streamed: a table of adjacent words, made from the same
templates, tells where the automaton has to run, and statistics elsewhere are at
most one. Templates are a fixed table, so the automaton, broadcast to a scan that
shuffles nothing, has a fixed size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh, table

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of an anchor, words that a chain may skip in text or template, and part of a template that makes a span.
MATCH, GAP, SHARE = 4, 30, 0.75
#: Score of a text that only names a licence.
NAMED = 0.5

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices as licensors ask to copy them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def words(text: bytes) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return WORDS.findall(text.lower())


class Automaton:
    """The generalised suffix automaton of sequences of word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            state = 0
            for word in sequence:
                state = self._grown(state, word)
        #: (sequence, end) of each place where the runs of a state end.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for k, sequence in enumerate(sequences):
            state = 0
            for end, word in enumerate(sequence, 1):
                state = self.steps[state][word]
                at = state
                while at > 0:
                    self.ends[at].append((k, end))
                    at = self.link[at]

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.steps.append(steps)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the longest run that ends with ``state`` and ``word``, parted from longer runs."""
        target = self.steps[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, dict(self.steps[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = clone
            state = self.link[state]
        return clone

    def _grown(self, last: int, word: int) -> int:
        if word in self.steps[last]:
            return self._split(last, word)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.steps[at]:
            self.steps[at][word] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, word)
        return new

    def statistics(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        steps, link, lengths, state, length = self.steps, self.link, self.length, 0, 0
        for word in numbers:
            while state and word not in steps[state]:
                state = link[state]
                length = lengths[state]
            if word in steps[state]:
                state = steps[state][word]
                length += 1
            yield state, length


class Licences:
    """Templates and phrases, ready to scan texts; both need two words at least."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, match: int = MATCH, gap: int = GAP, share: float = SHARE):
        self.match, self.gap, self.share = match, gap, share
        self.labels, self.phrase_labels = [label for label, _ in templates], [label for _, label in phrases]
        self.numbers: dict[bytes, int] = {}
        number = lambda text: [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text.encode())]
        sequences = [number(text) for _, text in templates] + [number(text) for text, _ in phrases]
        if any(len(s) < 2 for s in sequences):
            raise ValueError("a template or phrase has fewer than two words")
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.adjacent = np.zeros((len(self.numbers) + 1,) * 2, bool)
        for s in sequences:
            self.adjacent[s[:-1], s[1:]] = True
        #: Phrases that end where a state's runs end, as (words, phrase).
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for k, s in enumerate(sequences[len(templates) :]):
            state = 0
            for word in s:
                state = self.automaton.steps[state][word]
            self.phrases[state].append((len(s), k))
        for state in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[state] = self.phrases[state] + self.phrases[self.automaton.link[state]]
        #: Places in templates where a state's runs end.
        self.places = [[(k, end) for k, end in ends if k < len(templates)] for ends in self.automaton.ends]

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (start, phrase) and spans (start, end, template, covered words) of a text's words."""
        numbers = np.fromiter(map(self.numbers.get, found, repeat(0)), np.int32, len(found))
        joined = self.adjacent[numbers[:-1], numbers[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        places, anchors = [], defaultdict(list)
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            last, before = 0, 0
            for i, (state, length) in enumerate(self.automaton.statistics(numbers[a : b + 1].tolist()), a):
                places += [(i + 1 - n, k) for n, k in self.phrases[state] if n <= length]
                if length <= before:
                    self._anchor(anchors, i, before, last)
                last, before = state, length
            self._anchor(anchors, b + 1, before, last)
        spans = [s for k in sorted(anchors) for s in self._chained(anchors[k], k)]
        return sorted(places), sorted(spans)

    def _anchor(self, anchors: dict, end: int, length: int, state: int) -> None:
        if length >= self.match:
            for k, at in self.places[state]:
                anchors[k].append((end, at, length))

    def _chained(self, anchors: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, int]]:
        """Spans of template ``k`` from anchors (end in text, end in template, words) in the order of the text; ties go to the earlier one."""
        best, root, first = [], [], 0
        for j, (end, at, n) in enumerate(anchors):
            while anchors[first][0] < end - n - self.gap:
                first += 1
            value, origin = n, j
            for i in range(first, j):
                end_i, at_i, n_i = anchors[i]
                ahead = end_i < end and at_i < at and end_i - n_i < end - n and at_i - n_i < at - n
                if ahead and at - n - at_i <= self.gap:
                    covered = best[i] + n - max(end_i - (end - n), at_i - (at - n), 0)
                    if covered > value:
                        value, origin = covered, root[i]
            best.append(value)
            root.append(origin)
        ends: dict[int, int] = {}
        for j, value in enumerate(best):  # the best end of each chain
            if value > best[ends.setdefault(root[j], j)]:
                ends[root[j]] = j
        spans, taken = [], []
        for origin, j in sorted(ends.items(), key=lambda x: (-best[x[1]], x[0])):
            start, end = anchors[origin][0] - anchors[origin][2], anchors[j][0]
            if best[j] >= self.share * self.sizes[k]:
                spans.append((start, end, k, best[j]))
        last = -1
        for span in sorted(spans, key=lambda s: (s[0], -s[3])):  # chains that overlap are one passage, told once
            if span[0] >= last:
                taken.append(span)
                last = span[1]
            elif span[3] > taken[-1][3]:
                taken[-1] = span
                last = span[1]
        return taken


FOUND = "n_words long, places array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string,template:int,share:double>>"


def scan(docs: DataFrame, name: str, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``docs`` with a struct ``name``: number of words, places of phrases, and spans (from word ``start`` to before ``end``) that cover a template.

    Null, empty and wordless texts have no places or spans; texts of any length
    are scanned whole, in time that grows with them; repeated rows are each
    scanned; other columns pass through, so ``name`` should be new.
    """
    held = docs.sparkSession.sparkContext.broadcast(Licences(templates, phrases))

    @F.pandas_udf(FOUND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        licences = held.value
        for texts in batches:
            out = []
            for text in texts:
                found = words(text) if text else []
                places, spans = licences.scan(found) if len(found) > 1 else ([], [])
                named = [{"start": start, "label": licences.phrase_labels[k]} for start, k in places]
                covered = [{"start": a, "end": b, "label": licences.labels[k], "template": k, "share": n / licences.sizes[k]} for a, b, k, n in spans]
                out.append((len(found), named, covered))
            yield pd.DataFrame(out, columns=["n_words", "places", "spans"])

    return docs.withColumn(name, scanned(F.col("text").cast("binary")))


def labels_of(*lists: Column) -> Column:
    every = F.concat(*lists)
    return F.array_join(F.array_sort(F.array_distinct(every)), ",")


def remove_labels(docs: DataFrame, labels: list[str], templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """The rows without a place or span of any of ``labels``, columns unchanged; null and wordless texts stay."""
    name = fresh(docs, "found")
    own = F.concat(F.col(f"{name}.places.label"), F.col(f"{name}.spans.label"))
    return scan(docs, name, templates, phrases).where(~F.arrays_overlap(own, F.array(*map(F.lit, labels)))).drop(name)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "_found").select("doc_id", "_found.*")
    named, covered = F.col("places.label"), F.col("spans.label")
    share = F.coalesce(F.array_max("spans.share"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        labels_of(named).alias("base_labels"),
        labels_of(named, covered).alias("labels"),
        F.round(F.greatest(share, F.when(F.size("places") > 0, NAMED).otherwise(0.0)), 6).alias("score"),
    )
