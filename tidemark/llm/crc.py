"""CRC-32 of many byte spans at once, and of spans joined by one byte, from the parts' own values.

A CRC's state is linear in what came before: past a span it is the old state moved on by as
many zero bytes, xor the span's value from state 0.
"""

from __future__ import annotations

import zlib

import numpy as np

INIT = np.uint32(0xFFFFFFFF)
POLYNOMIAL = np.uint32(0xEDB88320)
#: Spans up to this many bytes go byte by byte, all in step; longer ones by the library, one by one.
IN_STEP = 48


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ POLYNOMIAL, t >> 1)
    return t


TABLE = _byte_table()


def _moved(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


def _zero_tables() -> np.ndarray:
    """For each k, what 2**k zero bytes make of each byte of a state."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [TABLE[state & 255] ^ (state >> 8)]
    for _ in range(31):
        out.append(_moved(out[-1], out[-1]))
    return np.stack(out)


ZEROS = _zero_tables()


def advance(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each state after ``count`` zero bytes."""
    state = state.copy()
    for k in range(int(count.max(initial=0)).bit_length()):
        at = np.flatnonzero(count >> k & 1)
        state[at] = _moved(ZEROS[k], state[at])
    return state


def step(state: np.ndarray, byte: int) -> np.ndarray:
    return TABLE[(state ^ np.uint32(byte)) & 255] ^ (state >> 8)


def from_zero(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state that each ``data[start:end]`` leads to from state 0."""
    state = np.zeros(len(start), np.uint32)
    size = end - start
    alive = np.flatnonzero(size <= IN_STEP)
    for i in range(IN_STEP):
        alive = alive[size[alive] > i]
        if not len(alive):
            break
        now = state[alive]
        state[alive] = TABLE[(now ^ data[start[alive] + i]) & 255] ^ (now >> 8)
    for i in np.flatnonzero(size > IN_STEP):
        state[i] = zlib.crc32(data[start[i] : end[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def joined(states: np.ndarray, own: np.ndarray, size: np.ndarray, byte: int) -> np.ndarray:
    """States of spans of one and more, each followed by ``byte`` and by a span whose state from 0 is ``own``."""
    return advance(step(states, byte), size) ^ own
