"""License scans with a generalised suffix automaton.

The tokens of all licence templates form one suffix automaton. A text's words run
through it and give matching statistics: at every word, the length of the longest run
ending there that stands in some template. Maximal long matches are chained per
template, in order of their places in both, into covered spans; a template whose words
are covered to a given share lends the text its label. The base phrases are templates
too: a phrase ends wherever the matched run has it as its tail, which the automaton's
suffix links tell.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import ALNUM, byte_texts, text_slices

#: Phrases whose every place counts, and their labels. Fixed values.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Notices of well-known public licences, as their texts have them. Fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                   "Public License as published by the Free Software Foundation, either version 3 of the License, or "
                   "(at your option) any later version"),
    ("gpl-work", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)
LEAST_MATCH = 3
LEAST_COVER = 0.8


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters and digits and of non-ASCII
    characters, A-Z in lower case."""
    return text.translate(ALNUM).split()


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences. State 0 is the root; ``last[s]``
    names (sequence, end) of one occurrence of the state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            state = 0
            for at, token in enumerate(sequence):
                state = self._extend(state, token)
                self.ends[state].add((number, at))
        # a state also ends wherever the states linked to it end
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _clone(self, state: int, token: int, target: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.ends.append(set())
        self.link[target] = clone
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = clone
            state = self.link[state]
        return clone

    def _extend(self, state: int, token: int) -> int:
        target = self.next[state].get(token)
        if target is not None:
            return target if self.length[target] == self.length[state] + 1 else self._clone(state, token, target)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[state] + 1)
        self.ends.append(set())
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._clone(state, token, target)
        return new

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        out, state, matched = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for token in sequence:
            while state and token not in following[state]:
                state = link[state]
                matched = length[state]
            if token in following[state]:
                state = following[state][token]
                matched += 1
            out.append((state, matched))
        return out


@dataclass
class Scan:
    n_words: int
    places: list[tuple[int, int]]            # (first word, phrase number) of each base place
    spans: list[tuple[int, int, int]]        # (template number, first word, end) of covered spans
    cover: dict[int, float]                  # template number to the share of its words covered


class LicenseScanner:
    def __init__(self, phrases=BASE_PHRASES, templates=TEMPLATES, least_match: int = LEAST_MATCH, least_cover: float = LEAST_COVER):
        self.phrases, self.templates = phrases, templates
        self.least_match, self.least_cover = least_match, least_cover
        words = [tokens(p.encode()) for p, _ in phrases] + [tokens(t.encode()) for _, t in templates]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.sequences = [[self.ids[w] for w in ws] for ws in words]
        self.automaton = SuffixAutomaton(self.sequences)
        # phrases that end where a state ends: its own and those up its suffix links
        self.tails = [set() for _ in self.automaton.next]
        for number, sequence in enumerate(self.sequences[:len(phrases)]):
            state = 0
            for token in sequence:
                state = self.automaton.next[state][token]
            self.tails[state].add(number)
        for state in sorted(range(1, len(self.tails)), key=self.automaton.length.__getitem__):
            self.tails[state] |= self.tails[self.automaton.link[state]]

    def _chain(self, matches: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """Longest covered chain of (first word, first template word, length), increasing
        in both without overlap: (words covered, [(first word, length)])."""
        matches = sorted(matches)
        best: list[tuple[int, int]] = []
        for i, (d, t, n) in enumerate(matches):
            before = max(((best[j][0], j) for j in range(i) if matches[j][0] + matches[j][2] <= d and matches[j][1] + matches[j][2] <= t),
                         default=(0, -1))
            best.append((before[0] + n, before[1]))
        at = max(range(len(best)), key=lambda i: best[i][0])
        covered, chain = best[at][0], []
        while at >= 0:
            chain.append((matches[at][0], matches[at][2]))
            at = best[at][1]
        return covered, chain[::-1]

    def scan(self, text: bytes | None) -> Scan:
        words = tokens(text) if text else []
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids)
        out = Scan(len(words), [], [], {})
        if not len(known):
            return out
        runs = np.split(known, np.flatnonzero(np.diff(known) > 1) + 1)    # other words lead back to the root
        matches: dict[int, list] = defaultdict(list)
        first_template = len(self.phrases)
        for run in runs:
            if len(run) < 2 and self.shortest > 1:
                continue
            base = int(run[0])
            stats = self.automaton.statistics(ids[run].tolist())
            for i, (state, matched) in enumerate(stats):
                for phrase in self.tails[state]:
                    if len(self.sequences[phrase]) <= matched:
                        out.places.append((base + i + 1 - len(self.sequences[phrase]), phrase))
                ends_here = i + 1 == len(stats) or stats[i + 1][1] != matched + 1      # a maximal match
                if ends_here and matched >= self.least_match:
                    for number, end in self.automaton.ends[state]:
                        if number >= first_template:
                            matches[number].append((base + i + 1 - matched, end + 1 - matched, matched))
        for number, found in sorted(matches.items()):
            self._cover(number, found, out)
        out.places.sort()
        return out

    @property
    def shortest(self) -> int:
        return min(map(len, self.sequences))

    def _cover(self, number: int, found: list, out: Scan) -> None:
        """Cut the matches into stretches no longer than twice the template and chain each."""
        size = len(self.sequences[number])
        found.sort()
        lo = 0
        while lo < len(found):
            hi = lo
            while hi < len(found) and found[hi][0] + found[hi][2] - found[lo][0] <= 2 * size:
                hi += 1
            hi = max(hi, lo + 1)
            covered, chain = self._chain(found[lo:hi])
            share = covered / size
            out.cover[number - len(self.phrases)] = max(share, out.cover.get(number - len(self.phrases), 0.0))
            if share >= self.least_cover:
                end = chain[-1][0] + chain[-1][1]
                out.spans.append((number - len(self.phrases), chain[0][0], end))
                while lo < len(found) and found[lo][0] < end:
                    lo += 1
            else:
                lo += 1


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, spans array<struct<label:string,first:long,end:long>>")


def scan(docs: DataFrame, phrases=BASE_PHRASES, templates=TEMPLATES, least_match: int = LEAST_MATCH,
         least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_base (places of the base
    phrases), first_word and last_word (their smallest and largest start, null without
    one), base_labels, labels (base and covered templates; sorted, distinct), score (1
    with a base place, else the best cover of a template; 0 without a match), spans of
    covered templates in words, end exclusive. Null and empty texts have no words;
    repeated rows and null ids give rows like others; other columns are ignored."""
    def run(batches):
        scanner = LicenseScanner(phrases, templates, least_match, least_cover)
        for part in text_slices(batches):
            rows = defaultdict(list)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), byte_texts(part.column("text"))):
                found = scanner.scan(text)
                base = sorted({phrases[p][1] for _, p in found.places})
                more = {templates[t][0] for t, _, _ in found.spans}
                starts = [a for a, _ in found.places]
                for name, value in (("doc_id", doc_id), ("n_words", found.n_words), ("n_base", len(starts)),
                                    ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)),
                                    ("base_labels", base), ("labels", sorted({*base, *more})),
                                    ("score", 1.0 if starts else min(1.0, max(found.cover.values(), default=0.0))),
                                    ("spans", [{"label": templates[t][0], "first": a, "end": b} for t, a, b in found.spans])):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(n).type) for n, v in rows.items()], schema=schema)
    labels = pa.list_(pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", labels), ("labels", labels), ("score", pa.float64()),
                        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
