"""Licence scans with a generalised suffix automaton of licence tokens.

All templates and key phrases are inserted, as token strings, into one suffix automaton.  A
file's words are streamed through it; at each word the automaton holds the longest suffix read
so far that occurs in any template (the matching statistics).  A key phrase occurs wherever the
phrase's state lies on the suffix-link path of the current state.  Maximal matches of at least
``MIN_MATCH`` tokens are chained, in template order and with bounded gaps, into covered spans.

Words: ``common.ascii_words``.  Null and empty texts have no words and no labels.  Equal texts get
equal results; a text of any length is streamed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.llm.common import ascii_words, ready, scan_texts

#: Key phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of public licences, by label, as they stand in file headers.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

MIN_MATCH = 5  # tokens of the shortest match that counts towards a template
MAX_GAP = 12  # tokens of text or template that a chain may skip between two matches
MIN_COVER = 0.6  # share of a template's tokens that a chain must cover to add its label


class SuffixAutomaton:
    """Generalised suffix automaton over token ids, with the template positions of each state."""

    def __init__(self, strings: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last: list[int] = []
        ends: list[list[tuple[int, int]]] = [[]]
        for k, s in enumerate(strings):
            v = 0
            for i, c in enumerate(s):
                v = self._extend(v, c)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[v].append((k, i + 1))
            self.last.append(v)
        order = sorted(range(1, len(self.next)), key=lambda v: -self.length[v])
        self.ends = [set(e) for e in ends]
        for v in order:
            self.ends[self.link[v]] |= self.ends[v]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of q no longer than those of p plus c."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        if (q := self.next[p].get(c)) is not None:
            return self._split(p, c, q)
        v = self._new(self.length[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = v
            p = self.link[p]
        if p >= 0:
            self.link[v] = self._split(p, c, self.next[p][c])
        return v


class LicenceScanner:
    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        self.phrase_label = [label for _, label in phrases]
        self.template_label = [label for label, _ in templates]
        texts = [p for p, _ in phrases] + [t for _, t in templates]
        self.vocab: dict[bytes, int] = {}
        strings = [[self.vocab.setdefault(w, len(self.vocab)) for w in ascii_words(t.encode())] for t in texts]
        self.sam = SuffixAutomaton(strings)
        self.size = [len(s) for s in strings]
        n = len(phrases)
        own: dict[int, list[int]] = {}
        for k in range(n):
            own.setdefault(self.sam.last[k], []).append(k)
        self.phrases_at: list[tuple[int, ...]] = []  # phrases that end in a state's longest string
        for v in range(len(self.sam.next)):
            got, u = [], v
            while u > 0:
                got += own.get(u, [])
                u = self.sam.link[u]
            self.phrases_at.append(tuple(sorted(got)))
        # template positions only; phrases are found by their states
        self.ends = [sorted((k - n, e) for k, e in x if k >= n) for x in self.sam.ends]
        self.template_size = self.size[n:]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places (phrase, start) and maximal matches (start, length, state, end)."""
        vocab, nxt, link, length, at = self.vocab.get, self.sam.next, self.sam.link, self.sam.length, self.phrases_at
        places, matches = [], []
        v = run = 0
        for i, w in enumerate(words):
            c = vocab(w)
            if c is None:
                if run >= MIN_MATCH:
                    matches.append((i - run, run, v, i))
                v = run = 0
                continue
            u = nxt[v].get(c)
            if u is None:
                if run >= MIN_MATCH:
                    matches.append((i - run, run, v, i))
                while u is None and v:
                    v = link[v]
                    u = nxt[v].get(c)
                run = length[v]
                if u is None:
                    continue
            v = u
            run += 1
            for k in at[v]:
                if self.size[k] <= run:
                    places.append((k, i + 1 - self.size[k]))
        if run >= MIN_MATCH:
            matches.append((len(words) - run, run, v, len(words)))
        return places, matches

    def chains(self, matches: Sequence[tuple[int, int, int, int]]) -> tuple[float, list[tuple[int, int, int, float]]]:
        """Largest share of a template that a chain covers, and every chain that covers
        ``MIN_COVER`` of one, in text order: first and last text word, template, share."""
        open_: dict[int, list[int]] = {}  # template: covered, text begin, text end, template end
        most, spans = 0.0, []

        def close(k: int) -> None:
            nonlocal most
            cover, first, end, _ = open_[k]
            share = cover / self.template_size[k]
            most = max(most, share)
            if share >= MIN_COVER:
                spans.append((first, end, k, share))

        for start, run, v, end in matches:
            seen = set()
            for k, e in self.ends[v]:
                if k in seen:
                    continue
                cur = open_.get(k)
                begin = e - run
                if cur and 0 <= start - cur[2] + MAX_GAP and start - cur[2] <= MAX_GAP and e > cur[3] and begin - cur[3] <= MAX_GAP:
                    new = [cur[0] + e - max(begin, cur[3]), cur[1], end, e]
                elif cur and e <= cur[3] and any(j == k and f > cur[3] for j, f in self.ends[v]):
                    continue
                else:
                    new = [run, start, end, e]
                    if cur:
                        close(k)
                seen.add(k)
                open_[k] = new
        for k in open_:
            close(k)
        return most, sorted(spans)

    def judge(self, text: bytes | None) -> dict:
        words = ascii_words(text)
        places, matches = self.scan(words)
        base = sorted({self.phrase_label[k] for k, _ in places})
        starts = [s for _, s in places]
        most, covered = self.chains(matches)
        score = max(1.0 if places else 0.0, most)
        added = {self.template_label[k] for _, _, k, _ in covered}
        spans = [{"label": self.template_label[k], "start": first, "end": end, "share": share} for first, end, k, share in covered]
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *added})),
            "score": min(1.0, score), "spans": spans,
        }


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())])
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN))]
)


def licence_scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base (all phrase places), first_word and last_word (their
    smallest and largest start), base_labels, labels (with those of covered templates), score
    (1 with a phrase, else the best share of a template that a chain covers), spans (every covered
    notice, in text order)."""
    ready(docs.sparkSession)
    phrases, templates = tuple(phrases), tuple(templates)

    def make():
        scanner = LicenceScanner(phrases, templates)

        def scan(texts):
            got = [scanner.judge(t) for t in texts]
            return {f.name: [g[f.name] for g in got] for f in RESULT.fields}

        return scan

    got, s = scan_texts(docs.select(id_col, text_col), text_col, make, RESULT, [id_col], "licence_scan")
    return got.select(id_col, *[F.col(f"{s}.{f.name}").alias(f.name) for f in RESULT.fields])
