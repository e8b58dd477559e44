"""License scans (operator 6): an exact set-similarity join of text blocks with license templates.

A block is a line of a document, a template the token set of a license notice.  They join
when the block holds at least ``THRESHOLD`` of the template's distinct tokens.  On request
windows of consecutive words over line ends are blocks too, so that wrapped notices are
found; they have the template's number of words and a share more (words / ``THRESHOLD``).  Tokens are
ordered by their frequency in the corpus, counted over all documents, rarest first.  A
block that joins holds one of the first |T| - need + 1 tokens of the template (prefix
filter), has ``need`` distinct tokens itself (length filter), and from its first common
token on enough is left of the template's and the block's template tokens (positional
filter); then the overlap is counted.
The templates are the stated query set, a fixed small list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

THRESHOLD = 0.85

#: The contract's phrases, and notices as licenses publish them.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def tokens(text: str) -> np.ndarray:
    """Word hashes of one short text, in order."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return hashing.words(raw, np.array([0, len(raw)]), hashing.NON_ALNUM)[0]


def _vocabulary(templates: list[tuple[str, str]]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[tokens(text) for _, text in templates]]))


def _member(vocabulary: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The index in the sorted vocabulary of each hash, or -1."""
    if not len(vocabulary):
        return np.full(len(hashed), -1)
    sieve = np.zeros(1 << 16, dtype=bool)
    sieve[vocabulary >> np.uint64(48)] = True
    out = np.full(len(hashed), -1)
    at = np.flatnonzero(sieve[hashed >> np.uint64(48)])
    place = np.minimum(np.searchsorted(vocabulary, hashed[at]), len(vocabulary) - 1)
    hit = vocabulary[place] == hashed[at]
    out[at[hit]] = place[hit]
    return out


def token_frequencies(texts: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """Occurrences of each template token in all texts, by its index in the sorted vocabulary."""
    vocabulary = _vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            raw, offsets = hashing.text_bytes(batch.column("text"))
            for a, b in hashing.slices(offsets):
                part = offsets[a : b + 1]
                found = _member(vocabulary, hashing.words(raw[part[0] : part[-1]], part - part[0], hashing.NON_ALNUM)[0])
                total += np.bincount(found[found >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["token", "n"])

    return {r.token: r.n for r in texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates with their tokens in global order, and an inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[int, int], threshold: float):
        self.vocabulary = _vocabulary(templates)
        rank = np.array([frequency.get(i, 0) for i in range(len(self.vocabulary))])
        self.place = np.empty(len(rank), np.int64)  # in the global order
        self.place[np.lexsort((np.arange(len(rank)), rank))] = np.arange(len(rank))
        self.labels, self.sets, self.need, self.width, self.prefixes = [], [], [], [], {}
        for label, text in templates:
            words = tokens(text)
            own = np.unique(self.place[np.searchsorted(self.vocabulary, words)])
            if len(own):
                need = math.ceil(round(threshold * len(own), 9))
                for at, token in enumerate(own[: len(own) - need + 1].tolist()):
                    self.prefixes.setdefault(token, []).append((len(self.sets), at))
                self.labels.append(label)
                self.sets.append(own)
                self.need.append(need)
                self.width.append(math.floor(round(len(words) / threshold, 9)))
        self.starts = np.zeros(len(self.vocabulary) + 1, dtype=bool)  # the last cell is for tokens of no template
        self.starts[list(self.prefixes)] = True

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Each word's place in the global order, or the vocabulary's size."""
        found = _member(self.vocabulary, hashed)
        return np.where(found >= 0, self.place[found], len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(found), np.int64)

    def spans(self, hashed: np.ndarray, row: np.ndarray, line: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(first word, last word, template, containment) of windows that join and go over a line end.

        A window begins and ends with a token of the template.  Of windows of one template that
        overlap in a chain, the first with most of its tokens is given.
        """
        token = self.places(hashed)
        for number, template, _ in self.blocks(hashed, row):  # a row holds whatever its windows hold
            a, b = np.searchsorted(row, [number, number + 1])
            whole, need, width = self.sets[template], self.need[template], self.width[template]
            hits = a + np.flatnonzero(np.isin(token[a:b], whole))
            count: dict[int, int] = {}
            best, end, low = (0, 0, 0), -1, 0  # tokens, first and last word; last word of the chain
            at, own = hits.tolist(), token[hits].tolist()
            for k, t in enumerate(own):
                count[t] = count.get(t, 0) + 1
                while at[k] - at[low] >= width or count[own[low]] > 1:
                    count[own[low]] -= 1
                    if not count[own[low]]:
                        del count[own[low]]
                    low += 1
                if len(count) < need or line[at[low]] == line[at[k]]:
                    continue
                if best[0] and at[low] > end:
                    yield best[1], best[2], template, best[0] / len(whole)
                    best = (0, 0, 0)
                end = at[k]
                if len(count) > best[0]:
                    best = (len(count), at[low], at[k])
            if best[0]:
                yield best[1], best[2], template, best[0] / len(whole)

    def blocks(self, hashed: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(block, template, containment) of every joining pair; ``block`` ascends by word."""
        token = self.places(hashed)
        for number in np.unique(block[self.starts[token]]).tolist():
            a, b = np.searchsorted(block, [number, number + 1])
            own = np.unique(token[a:b])
            own = own[own < len(self.vocabulary)]
            size = len(np.unique(hashed[a:b]))
            tried = set()
            for position in np.flatnonzero(self.starts[own]).tolist():
                for template, at in self.prefixes[int(own[position])]:
                    if template in tried:
                        continue
                    tried.add(template)
                    need, whole = self.need[template], self.sets[template]
                    if size >= need and min(len(whole) - at, len(own) - position) >= need:
                        shared = len(np.intersect1d(whole, own, assume_unique=True))
                        if shared >= need:
                            yield number, template, shared / len(whole)


def _phrase_starts(hashed: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word positions where the phrase's words stand consecutively in one row."""
    n = len(hashed) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashed[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[hashed[at + k] == phrase[k]]
    return at[row[at] == row[at + len(phrase) - 1]]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row per row of ``docs``: its license phrases, and the labels of all templates its lines join, and if ``wrapped`` its windows.

    Columns: id, n_words, n_base, first_word, last_word (null without a phrase), base_labels and
    labels (sorted, distinct, comma-joined; empty if none), score (the largest containment among
    joining blocks, else 0) and blocks (array of struct(line, last_line, label, containment): every
    joining block, lines from 0).  Null and empty texts have no words, repeated rows are scanned one by one,
    other columns are ignored, and an empty table gives none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    frequency = token_frequencies(texts, templates)
    columns = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    block_type = pa.list_(pa.struct([("line", pa.int64()), ("last_line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequency, threshold)
        wanted = [(label, tokens(phrase)) for phrase, label in phrases]
        for batch in batches:
            raw, offsets = hashing.text_bytes(batch.column("text"))
            for a, b in hashing.slices(offsets):
                part = offsets[a : b + 1] - offsets[a]
                own = raw[offsets[a] : offsets[b]]
                hashed, start, _, by_row = hashing.words(own, part, hashing.NON_ALNUM)
                counts = np.diff(by_row)
                row = np.repeat(np.arange(b - a), counts)
                breaks = np.flatnonzero(own == 10)
                line = np.searchsorted(breaks, start)
                line_of_row = np.searchsorted(breaks, part[:-1])
                n_base, first, last = np.zeros(b - a, np.int64), np.full(b - a, np.iinfo(np.int64).max), np.full(b - a, -1)
                base: list[set[str]] = [set() for _ in range(b - a)]
                for label, phrase in wanted:
                    at = _phrase_starts(hashed, row, phrase)
                    rows, place = row[at], at - by_row[:-1][row[at]]
                    np.add.at(n_base, rows, 1)
                    np.minimum.at(first, rows, place)
                    np.maximum.at(last, rows, place)
                    for r in np.unique(rows).tolist():
                        base[r].add(label)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                block = line + row  # a new row begins a new block too
                for number, template, share in index.blocks(hashed, block):
                    r = int(row[np.searchsorted(block, number)])
                    at = number - r - int(line_of_row[r])
                    found[r].append({"line": at, "last_line": at, "label": index.labels[template], "containment": share})
                for x, y, template, share in index.spans(hashed, row, line) if wrapped else ():
                    r = int(row[x])
                    found[r].append({"line": int(line[x] - line_of_row[r]), "last_line": int(line[y] - line_of_row[r]), "label": index.labels[template], "containment": share})
                none = n_base == 0
                labels = [",".join(sorted(own_ | {f["label"] for f in f_})) for own_, f_ in zip(base, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[a:b], pa.array(counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array([",".join(sorted(x)) for x in base]), pa.array(labels),
                        pa.array([max((f["containment"] for f in f_), default=0.0) for f_ in found], pa.float64()), pa.array(found, block_type),
                    ],
                    columns,
                )

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:long,last_line:long,label:string,containment:double>>"
    return texts.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
