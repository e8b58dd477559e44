"""Pattern automata over bytes as dense tables, built level by level with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trie:
    """Nodes by level; node 0 is the root. ``children[i]`` are the nodes of depth i + 1."""

    children: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # nodes, parents, bytes
    pattern: np.ndarray  # the pattern that ends at a node, or -1

    @property
    def size(self) -> int:
        return len(self.pattern)


def build_trie(patterns: list[bytes]) -> Trie:
    """Of equal patterns the first counts; empty ones are ignored."""
    lengths = np.array([len(p) for p in patterns], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(patterns), np.uint8)
    at = np.zeros(len(patterns), np.int64)
    pattern, children, size, depth = [np.array([-1])], [], 1, 0
    alive = np.flatnonzero(lengths > 0)
    while len(alive):
        edge = at[alive] * 256 + data[starts[alive] + depth]
        keys, node = np.unique(edge, return_inverse=True)
        ids = size + np.arange(len(keys))
        children.append((ids, keys // 256, (keys % 256).astype(np.int64)))
        at[alive] = ids[node]
        ends = np.full(len(keys), -1)
        done = lengths[alive] == depth + 1
        ends[node[done][::-1]] = alive[done][::-1]
        pattern.append(ends)
        size, depth = size + len(keys), depth + 1
        alive = alive[~done]
    return Trie(children, np.concatenate(pattern))


class AhoCorasick:
    """Every pattern that ends at a position: ``step``, then ``out`` and on along ``more``."""

    def __init__(self, patterns: list[bytes]):
        trie = build_trie(patterns)
        self.pattern = trie.pattern
        self.step = np.zeros((trie.size, 256), np.int32)
        self.out = np.zeros(trie.size, np.int32)  # itself if a pattern ends here, else the next suffix where one does, else 0
        self.more = np.zeros(trie.size, np.int32)
        fail = np.zeros(trie.size, np.int32)
        for level, (nodes, parents, symbols) in enumerate(trie.children):
            if level:
                fail[nodes] = self.step[fail[parents], symbols]
            self.step[parents, symbols] = nodes
            self.more[nodes] = self.out[fail[nodes]]
            self.out[nodes] = np.where(trie.pattern[nodes] >= 0, nodes, self.more[nodes])
            # A node's row is its failure's, until the next level writes its own children over it.
            self.step[nodes] = self.step[fail[nodes]]


class LongestMatch:
    """Greedy longest match in one pass: ``step`` moves on, ``popped`` counts the pieces that a move closes.

    A byte that no pattern starts with is a piece of its own.
    """

    def __init__(self, patterns: list[bytes]):
        present = {p for p in patterns if len(p) == 1}
        trie = build_trie([*patterns, *(bytes([b]) for b in range(256) if bytes([b]) not in present)])
        self.step = np.zeros((trie.size, 256), np.int32)
        kind = np.uint8 if max(map(len, patterns), default=0) < 256 else np.int32  # a move pops no more pieces than the longest has bytes
        self.popped = np.zeros((trie.size, 256), kind)
        self.close = np.zeros(trie.size, np.int32)  # pieces that the end of a word closes
        fail, count = np.zeros(trie.size, np.int32), np.zeros(trie.size, kind)
        for nodes, parents, symbols in trie.children:
            whole = trie.pattern[nodes] >= 0
            back = fail[parents]
            fail[nodes] = np.where(whole, 0, self.step[back, symbols])
            count[nodes] = np.where(whole, 1, count[parents] + self.popped[back, symbols])
            self.step[parents, symbols] = nodes
            self.popped[parents, symbols] = 0
            self.step[nodes] = self.step[fail[nodes]]
            self.popped[nodes] = self.popped[fail[nodes]] + count[nodes][:, None]
            self.close[nodes] = count[nodes] + self.close[fail[nodes]]
