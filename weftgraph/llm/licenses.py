"""License scans by an exact set-similarity join (operator 6).

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased. The text blocks of a template are all runs of consecutive words of the
whole text, over line ends, that are as long as the template, or 1 / threshold as long
where that is more words (the whole text, if it is shorter). A block matches the
template if the share of the template's distinct tokens that it holds reaches the
threshold. So a notice is found however its lines are broken, and its words scattered
over a longer stretch are not one.

The join: the tokens of all templates are counted over the whole corpus, which
gives one global order, rarest first. For a template of n tokens that needs m
of them, a matching block holds at least one of the n - m + 1 rarest: only
these prefixes are indexed, and only blocks around the places of such a token are
looked at. A text of fewer than m words is passed over (length filter), and so is a
candidate whose rarest token in the text stands so late in the template's order that
too few are left after it (positional filter). What remains is verified on the full
sets, block by block. A template whose tokens are a proper part of another's that the
text holds as well needs a block outside the other's.

Beside it, exact phrases are found as runs of consecutive words.

The templates are a fixed table of this module, so index and broadcast have a
proven bound; texts are read by two map-side passes.

Cases: a null or empty text has no words, no labels and score 0; a null doc_id
keeps its row; repeated rows are scanned one by one; templates with equal
tokens all match; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import column, pieces
from weftgraph.sources.tables import table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
THRESHOLD = 0.95
# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of public licenses, each with its label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("reserved", "All rights reserved"),
)


def words(raw: bytes) -> list[bytes]:
    """Words of UTF-8 bytes that are lower-cased already."""
    return WORD.findall(raw)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _vocabulary() -> dict[bytes, int]:
    seen = dict.fromkeys(w for _, t in TEMPLATES for w in words(lowered(t)))
    seen |= dict.fromkeys(w for p in PHRASES for w in words(lowered(p)))
    return {w: k for k, w in enumerate(seen)}


VOCABULARY = _vocabulary()
PHRASE_CODES = [(np.array([VOCABULARY[w] for w in words(lowered(p))]), label) for p, label in PHRASES.items()]


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Tokens that a block must share with a template of `size` distinct tokens."""
    return max(1, int(np.ceil(threshold * size - 1e-9)))


@dataclass
class Index:
    """Prefix index of the templates under one global token order."""

    rank: list[int]
    ordered: list[list[int]]
    prefix: dict[int, list[tuple[int, int]]]
    threshold: float = THRESHOLD

    @classmethod
    def build(cls, counts: dict[int, int], threshold: float = THRESHOLD) -> Index:
        """`counts`: corpus counts of vocabulary codes."""
        order = sorted(range(len(VOCABULARY)), key=lambda c: (counts.get(c, 0), c))
        rank = [0] * len(order)
        for place, code in enumerate(order):
            rank[code] = place
        ordered = [sorted({VOCABULARY[w] for w in words(lowered(t))}, key=rank.__getitem__) for _, t in TEMPLATES]
        prefix: dict[int, list[tuple[int, int]]] = {}
        for t, tokens in enumerate(ordered):
            for place, code in enumerate(tokens[: len(tokens) - needed(len(tokens), threshold) + 1]):
                prefix.setdefault(code, []).append((t, place))
        return cls(rank, ordered, prefix, threshold)

    def candidates(self, tokens: set[int], n_words: int) -> list[int]:
        """Templates that a text of these vocabulary tokens and so many words may hold."""
        first: dict[int, int] = {}
        for code in sorted(tokens & self.prefix.keys(), key=self.rank.__getitem__):
            for t, place in self.prefix[code]:
                first.setdefault(t, place)
        out = []
        for t, place in first.items():
            size = len(self.ordered[t])
            need = needed(size, self.threshold)
            if n_words >= need and size - place >= need and sum(code in tokens for code in self.ordered[t]) >= need:
                out.append(t)
        return sorted(out)


#: Words of each template.
LENGTHS = [len(words(lowered(t))) for _, t in TEMPLATES]


def runs(codes: np.ndarray, template: int, index: Index) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of the blocks of words that hold a template, the share of its tokens in each, and their length."""
    tokens = index.ordered[template]
    need = needed(len(tokens), index.threshold)
    width = min(len(codes), int(LENGTHS[template] / index.threshold + 1e-9))
    # Only blocks that hold a token of the prefix: they start at most a block's length before one.
    rare = np.cumsum(np.concatenate(([0], np.isin(codes, tokens[: len(tokens) - need + 1]))))
    starts = np.flatnonzero(rare[width:] > rare[:-width])
    near = np.zeros(len(codes) + 1, np.int64)
    np.add.at(near, starts, 1)
    np.add.at(near, starts + width, -1)
    near = np.cumsum(near[:-1]) > 0
    words_near = codes[near]
    at = (np.cumsum(near) - 1)[starts]
    held = np.zeros(len(starts), np.int64)
    for code in tokens:
        before = np.concatenate(([0], np.cumsum(words_near == code)))
        held += before[at + width] > before[at]
    hit = held >= need
    return starts[hit], held[hit] / len(tokens), width


def apart(codes: np.ndarray, template: int, starts: np.ndarray, width: int) -> list[int]:
    """Of the runs that hold a template, some that do not overlap: those in the template's word order first."""
    n = LENGTHS[template]
    in_order = np.array([VOCABULARY[w] for w in words(lowered(TEMPLATES[template][1]))])
    out: list[int] = []
    used = np.zeros(len(codes), bool)
    for start in sorted(starts.tolist(), key=lambda s: (not np.array_equal(codes[s : s + n], in_order), s)):
        if not used[start : start + width].any():
            used[start : start + width] = True
            out.append(start)
    return out


def scan(text: str | None, index: Index) -> dict:
    """Words, phrase places and template matches of one whole text."""
    raw = lowered(text)
    found = words(raw)
    look = VOCABULARY.get
    codes = np.array([look(w, -1) for w in found], np.int64)
    places, base = [], set()
    for phrase, label in PHRASE_CODES:
        n = len(codes) - len(phrase) + 1
        if n <= 0:
            continue
        here = codes[:n] == phrase[0]
        for k in range(1, len(phrase)):
            here &= codes[k : k + n] == phrase[k]
        at = np.flatnonzero(here)
        if len(at):
            places += at.tolist()
            base.add(label)
    hits: dict[int, float] = {}
    present = set(codes.tolist())
    found_runs = {t: got for t in index.candidates(present, len(codes)) if len((got := runs(codes, t, index))[0])}
    for t, (starts, shares, width) in found_runs.items():
        taken = np.zeros(len(codes) + 1, np.int64)  # words of notices that hold all of this one's tokens
        for u in found_runs:
            if set(index.ordered[t]) < set(index.ordered[u]):
                for start in apart(codes, u, found_runs[u][0], found_runs[u][2]):
                    taken[start : start + found_runs[u][2]] = 1
        before = np.concatenate(([0], np.cumsum(taken)))
        own = before[starts + width] == before[starts]
        if own.any():
            hits[t] = float(shares[own].max())
    labels = base | {TEMPLATES[t][0] for t in hits}
    return {
        "n_words": len(found), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 if base else max(hits.values(), default=0.0),
        "templates": sorted(hits),
    }


def _count(batches):
    total: Counter = Counter()
    for batch in pieces(batches):
        look = VOCABULARY.get
        for text in column(batch, "text"):
            total.update(c for w in words(lowered(text)) if (c := look(w, -1)) >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["code", "n"])


def corpus_counts(docs: DataFrame) -> dict[int, int]:
    """How often each vocabulary token stands in the corpus: at most one number per token reaches the driver."""
    rows = docs.select("text").mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r["code"]: r["n"] for r in rows}


def _scanner(index: Index):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32())]

    def run(batches):
        for batch in pieces(batches):
            rows = [scan(t, index) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], ["doc_id", *names])

    return run


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: word and phrase counts, labels, best containment and matched templates."""
    index = Index.build(corpus_counts(docs), threshold)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInArrow(_scanner(index), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, templates array<int>")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of the table against every template and phrase."""
    return scan_licenses(table(spark, sf_dir, "documents"))
