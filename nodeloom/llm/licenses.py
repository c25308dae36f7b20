"""Licence scans: matching statistics on a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template.  A text is streamed through it
once: each word gets the length of the longest template run that ends there.  Maximal
runs are then chained, template by template, in the order of both text and template;
a chain is a covered span and its share of the template is the coverage.  Only runs
of words that occur in some template enter the automaton, so the work in Python follows
the licence-like words, while words are cut and named by vectorised code.

Base phrases are templates too; a phrase stands wherever the automaton's state has
it as a suffix.

Edge cases: a null or empty text has no words, empty labels and score 0; equal texts give
equal results; rows repeat as in the input; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

#: Base phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and clauses as the licences print them (fixed values).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
#: Shortest run that is chained, longest gap in a chain (in words of text or template), and the coverage that labels.
MIN_RUN, MAX_GAP, MIN_COVERAGE = 3, 12, 0.5


class SuffixAutomaton:
    """Generalised suffix automaton over token ids, with for each state its occurrences (template, end)."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((number, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of p's longest string plus token, split off if it shares one with longer strings."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, q)
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._add(self.length[last] + 1), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, token)
        return new

    def statistics(self, stream: list[int]) -> Iterator[tuple[int, int]]:
        """For each token of the stream: the state and the length of the longest match that ends there."""
        state, length = 0, 0
        for token in stream:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


class Matcher:
    """Templates, vocabulary and automaton; built once per process from the constants."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, text.split()) for label, text in templates]
        self.phrases = [(label, text.split()) for text, label in phrases.items()]
        words = sorted({w for _, ws in self.templates + self.phrases for w in ws})
        hashes = np.array([tk.hash_of(w) for w in words], np.uint64)
        by = np.argsort(hashes)
        self.hashes, ids = hashes[by], {words[i]: n for n, i in enumerate(by)}
        sequences = [[ids[w] for w in ws] for _, ws in self.templates + self.phrases]
        self.automaton = SuffixAutomaton(sequences)
        wanted = [(label, [ids[w] for w in ws]) for label, ws in self.phrases]
        self.stands = []  # by state: the phrases that its strings end with
        for ends in self.automaton.ends:
            number, end = min(ends, default=(0, 0))
            self.stands.append([(label, len(ws)) for label, ws in wanted if ws == sequences[number][max(0, end - len(ws)) : end]])

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[str, int]], dict[int, list[list[int]]]]:
        """Base places (label, first word) and, by template, its chains [first word, end, covered, end in template]."""
        base, chains = [], {}
        for at, ids in runs:
            found = [*self.automaton.statistics(ids), (0, 0)]
            for i, (state, length) in enumerate(found[:-1]):
                base += [(label, at + i + 1 - n) for label, n in self.stands[state] if n <= length]
                if length >= MIN_RUN and found[i + 1][1] <= length:  # maximal
                    end = at + i + 1
                    for template, stop in sorted(self.automaton.ends[state]):
                        if template < len(self.templates):
                            self._chain(chains.setdefault(template, []), end - length, end, stop - length, stop)
        return base, chains

    @staticmethod
    def _chain(chains: list[list[int]], begin: int, end: int, start: int, stop: int) -> None:
        if chains:
            last = chains[-1]
            if 0 <= begin - last[1] <= MAX_GAP and 0 <= start - last[3] <= MAX_GAP:
                last[1], last[2], last[3] = end, last[2] + end - begin, stop
                return
            if end <= last[1]:
                return
        chains.append([begin, end, end - begin, stop])


@lru_cache
def matcher() -> Matcher:
    return Matcher()


SPAN = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_words``, ``base`` (label and first word of each place) and ``spans`` (template label, word range, coverage)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher()
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch):
                t = tk.tokenize(data, offsets, tk.WORDS)
                n = np.bincount(t.doc, minlength=last - first)
                begin = np.cumsum(n) - n
                ids = np.minimum(np.searchsorted(m.hashes, t.hash), len(m.hashes) - 1)
                known = np.concatenate([[False], m.hashes[ids] == t.hash, [False]])
                edge = np.flatnonzero((known[1:] != known[:-1]) | np.isin(np.arange(len(known) - 1), begin))
                by_doc: dict[int, list] = {}
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if b - a > 1 and known[a + 1]:
                        doc = int(t.doc[a])
                        by_doc.setdefault(doc, []).append((a - int(begin[doc]), ids[a:b].tolist()))
                base, spans = [], []
                for doc in range(last - first):
                    places, chains = m.scan(by_doc[doc]) if doc in by_doc else ([], {})
                    base.append([{"label": label, "start_word": at} for label, at in places])
                    spans.append([{"label": m.templates[k][0], "start_word": c[0], "end_word": c[1], "coverage": c[2] / len(m.templates[k][1])} for k, of in sorted(chains.items()) for c in of])
                place = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in keep), pa.array(n, pa.int64()), pa.array(base, place), pa.array(spans, SPAN)], names=[*keep, "n_words", "base", "spans"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "n_words long, base array<struct<label: string, start_word: long>>, spans array<struct<label: string, start_word: long, end_word: long, coverage: double>>"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    covered = F.filter("spans", lambda s: s.coverage >= MIN_COVERAGE)
    best = F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.start_word")).alias("first_word"), F.array_max(F.col("base.start_word")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, covered.label)), ",").alias("labels"),
        F.greatest(F.least(best, F.lit(1.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )
