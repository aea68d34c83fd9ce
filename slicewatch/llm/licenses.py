"""Licence scans with a generalised suffix automaton over licence tokens.

All templates go into one automaton over word tokens. A file is streamed through it: the matching
statistics (longest suffix read so far that occurs in some template) give maximal matches, and matches
that keep their order in a template are chained into covered spans of it. Words that occur in no template
reset the automaton, so only runs of template words are walked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.llm import words as W
from slicewatch.llm.common import TextBlock, ship_package, text_blocks

#: Base phrases (fixed values): words that stand consecutively, and the label they give.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices and openings of public licences (fixed values): label and text.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at"),
    ("apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
            "(at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Scan:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    min_match: int = 3         # tokens of a match that counts
    max_gap: int = 12          # tokens between two matches of one chain
    min_cover: float = 0.75    # share of a template that gives its label


def _tokens(text: str) -> list[int]:
    block = next(text_blocks(pa.array([text])), None)
    if block is None:
        return []
    buf, s, e, _ = W.spans(block, W.ALNUM)
    return W.hashes(buf, s, e).tolist()


class SuffixAutomaton:
    """Generalised suffix automaton of several token sequences; each state knows where its longest
    string ends in the sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for position, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((number, position))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:  # what ends a longer string also ends its suffixes
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int) -> int:
        """The state reached from ``state`` by ``token`` whose longest string is one token longer."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier sequence has been here
            return self._split(last, token)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def matches(self, tokens: list[int], least: int):
        """Maximal matches (first token, length, state) of at least ``least`` tokens."""
        state = size = 0
        found = []
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if size >= least:
                    found.append((i - size, size, state))
                while state > 0 and token not in self.next[state]:
                    state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            else:
                state = size = 0
        if size >= least:
            found.append((len(tokens) - size, size, state))
        return found

    def template_matches(self, tokens: list[int], least: int):
        """Matches (first token, length, sequence, place of the last token there) of at least ``least``
        tokens that the sequence itself does not continue at that place, whatever other sequences do."""
        state = size = 0
        before: dict[tuple[int, int], int] = {}
        found = []
        for i, token in enumerate(tokens):
            while state > 0 and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state, size = (self.next[state][token], size + 1) if token in self.next[state] else (0, 0)
            now = self._places(state, size, least)
            found += [(i - n, n, k, e) for (k, e), n in before.items() if (k, e + 1) not in now]
            before = now
        return found + [(len(tokens) - n, n, k, e) for (k, e), n in before.items()]

    def _places(self, state: int, size: int, least: int) -> dict[tuple[int, int], int]:
        """Longest suffix read so far, if of ``least`` tokens or more, that ends at each place."""
        out: dict[tuple[int, int], int] = {}
        while state > 0 and size >= least:
            for place in self.ends[state]:
                out.setdefault(place, size)
            state = self.link[state]
            size = self.length[state]
        return out


class Scanner:
    def __init__(self, p: Scan):
        self.p = p
        self.labels = [label for label, _ in p.templates]
        sequences = [_tokens(text) for _, text in p.templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.known = np.unique(np.array([t for s in sequences for t in s], np.uint64))
        self.phrases = [(label, phrase.encode().split(), np.array([W.of_word(w) for w in phrase.split()], np.uint64))
                        for phrase, label in p.phrases]

    def block(self, block: TextBlock):
        """Per text of a block: word count, base places (label, first word), covered spans."""
        buf, s, e, doc = W.spans(block, W.ALNUM)
        h = W.hashes(buf, s, e)
        n = len(block)
        counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        places: list[list] = [[] for _ in range(n)]
        covers: list[list] = [[] for _ in range(n)]
        for label, words, hashed in self.phrases:
            k = len(hashed)
            if len(h) < k:
                continue
            hit = doc[:len(h) - k + 1] == doc[k - 1:]
            for j in range(k):
                hit &= h[j:len(h) - k + 1 + j] == hashed[j]
            for i in np.flatnonzero(hit):
                if all(buf[s[i + j]:e[i + j]].tobytes() == words[j] for j in range(k)):
                    places[doc[i]].append({"label": label, "word": int(i - first[doc[i]])})
        if len(h) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            inside = np.concatenate([[False], self.known[at] == h, [False]])
            same = np.concatenate([[False], doc[1:] == doc[:-1], [False]])
            opens = np.flatnonzero(inside[1:-1] & (~inside[:-2] | ~same[:-1]))
            closes = np.flatnonzero(inside[1:-1] & (~inside[2:] | ~same[1:])) + 1
            long = closes - opens >= self.p.min_match
            found: dict[int, list] = {}
            for lo, hi in zip(opens[long].tolist(), closes[long].tolist()):
                d = int(doc[lo])
                for begin, size, template, end in self.automaton.template_matches(h[lo:hi].tolist(), self.p.min_match):
                    found.setdefault(d, []).append((lo - int(first[d]) + begin, size, template, end))
            for d, matches in found.items():
                covers[d] = self._chain(matches)
        return counts, places, covers

    def _chain(self, matches):
        """Best chain per template: matches in file order that advance in the template, with short gaps.
        Returns (label, template, first word, end word, share of the template covered)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for begin, size, template, end in matches:
            by_template.setdefault(template, []).append((begin, end - size + 1, size))
        out = []
        for template, parts in sorted(by_template.items()):
            parts.sort()
            best: list[tuple[int, int]] = []  # tokens covered by the chain that ends here; where it began
            for j, (begin, at, size) in enumerate(parts):
                top = (size, begin)
                for i in range(j - 1, -1, -1):
                    b, a, n = parts[i]
                    if begin - (b + n) > self.p.max_gap and begin - b > self.p.max_gap + self.sizes[template]:
                        break
                    if b + n <= begin <= b + n + self.p.max_gap and a + n <= at and best[i][0] + size > top[0]:
                        top = (best[i][0] + size, best[i][1])
                best.append(top)
            j = max(range(len(parts)), key=lambda i: (best[i][0], -i))
            share = best[j][0] / self.sizes[template]
            out.append({"label": self.labels[template], "template": template, "first": best[j][1],
                        "end": parts[j][0] + parts[j][2], "cover": min(1.0, share)})
        return out


SCHEMA = ("doc_id long, n_words long, places array<struct<label:string,word:long>>, "
          "covers array<struct<label:string,template:int,first:long,end:long,cover:double>>")
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_COVERS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()),
                              ("end", pa.int64()), ("cover", pa.float64())]))


def scan(docs: DataFrame, p: Scan = Scan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, places`` (base phrases with their first word) and
    ``covers`` (per template the best chain: file span in words and share of the template).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; whole texts are read.
    Null and empty texts have no words and no places; repeated rows and null ids are scanned like any
    other; an empty table gives an empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        scanner = Scanner(p)
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                counts, places, covers = scanner.block(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(counts.astype(np.int64)),
                     pa.array(places, _PLACES), pa.array(covers, _COVERS)],
                    names=["doc_id", "n_words", "places", "covers"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
