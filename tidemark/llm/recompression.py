"""Recompression of word sequences: rounds that name runs of equal symbols, then pairs of neighbours.

A round (1) replaces each maximal run of two or more equal symbols by one symbol and (2) halves
the alphabet by a hash of the name and replaces each neighbouring pair of a first-half and a
second-half symbol by one.  A name is a 64-bit mix of what it stands for, so every task gives
equal runs and pairs the same name.

A symbol is made by what lies around it, up to one neighbour on either side a round.  That is
its context: wherever the words of the context stand again, so does the symbol.  Where a text's
end takes part, the context reaches over it, and no window inside the text holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .hashing import BASE, M1, mix


@dataclass
class Parse:
    """Symbols of texts laid end to end: name, text, first word, and context (first word, word after the last)."""

    name: np.ndarray
    row: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray


def words_as_symbols(names: np.ndarray, offsets: np.ndarray) -> Parse:
    """``names`` of all words, and n + 1 word offsets by text."""
    at = np.arange(len(names))
    return Parse(names, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), at, at, at + 1)


def _runs(p: Parse, offsets: np.ndarray) -> tuple[Parse, np.ndarray]:
    """Maximal runs as single symbols, and the name each consists of."""
    n = len(p.name)
    head = np.ones(n, dtype=bool)
    head[1:] = (p.name[1:] != p.name[:-1]) | (p.row[1:] != p.row[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], n) - 1
    base, row, length = p.name[first], p.row[first], last - first + 1
    name = np.where(length > 1, mix(base ^ mix(length.astype(np.uint64) * M1)), base)
    # Where a run ends is known from the symbols beside it, or from the text's end.
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    low = np.where((first > 0) & (p.row[before] == row), p.low[before], offsets[row] - 1)
    high = np.where((last + 1 < n) & (p.row[after] == row), p.high[after], offsets[row + 1] + 1)
    return Parse(name, row, p.start[first], low, high), base


def _pairs(p: Parse, base: np.ndarray, turn: int) -> Parse:
    """Neighbours of different halves as single symbols; the half goes by what a run consists of."""
    second_half = mix(base ^ mix(np.array([turn], np.uint64))) >> np.uint64(63) != 0
    joined = np.zeros(len(p.name), dtype=bool)
    joined[:-1] = ~second_half[:-1] & second_half[1:] & (p.row[:-1] == p.row[1:])
    kept = np.ones(len(p.name), dtype=bool)
    kept[1:] = ~joined[:-1]
    at = np.flatnonzero(kept)
    both = joined[at]
    other = np.minimum(at + both, len(p.name) - 1)
    name = np.where(both, mix(mix(p.name[at]) * BASE + p.name[other]), p.name[at])
    return Parse(name, p.row[at], p.start[at], np.minimum(p.low[at], p.low[other]), np.maximum(p.high[at], p.high[other]))


def parse(names: np.ndarray, offsets: np.ndarray, rounds: int) -> Parse:
    """The symbols after ``rounds`` rounds."""
    p = words_as_symbols(names, offsets)
    for turn in range(rounds):
        if not len(p.name):
            break
        p = _pairs(*_runs(p, offsets), turn + 1)
    return p
