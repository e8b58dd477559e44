"""Vectorised word and shingle hashing of whole texts, over one Arrow batch at a time.

Words are maximal runs of bytes that are not separators.  Each word gets a
64-bit hash, a non-linear mix of its lanes of eight bytes; a shingle's hash
mixes the hashes of its words in order.  Equal word sequences always hash
alike; two different ones inside one pair of documents of a thousand words
meet with a probability near 1e-13.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
#: The first n of eight bytes, for n from 0 to 8.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Space and \x09-\x0D part words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is neither a letter nor a digit parts words; bytes over 0x7F belong to words.
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Runs of rows of about ``limit`` bytes each; a longer row stands alone."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(offsets) - 1)
        yield start, end
        start = end


def _lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans in lanes of eight bytes: (span, place within it, first byte, mask of the bytes that belong to it) of each."""
    count = np.maximum(1, (end - start + 7) >> 3)
    span = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
    first = start[span] + 8 * place
    held = np.clip(end[span] - first, 0, 8)
    return span, place, first, MASKS[held]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``: its lanes of eight bytes are mixed one by one, then summed and mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    _, place, first, mask = _lanes(data, start, end)
    lane = mix((_eights(data)[first] & mask) ^ M2 ^ np.uint64(seed))
    lane = mix(lane + (place + 1).astype(np.uint64) * BASE)
    return mix(np.add.reduceat(lane, np.flatnonzero(place == 0)) + (end - start).astype(np.uint64) * M1)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(example, same): an example of each distinct ``data[start:end]``, and which example each span equals, byte by byte."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, example, same = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    of = example[same]
    odd = end - start != end[of] - start[of]
    span, _, first, mask = _lanes(data, start, end)
    alike = ~odd[span]  # only then does the example have a lane for each
    span, first, mask = span[alike], first[alike], mask[alike]
    eights = _eights(data)
    odd[span[((eights[first] ^ eights[first - start[span] + start[of][span]]) & mask) != 0]] = True
    own = np.flatnonzero(odd)  # spans that only share a hash with their example stand for themselves
    same[own] = len(example) + np.arange(len(own))
    return np.concatenate([example, own]), same


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n + 1 word offsets by row.

    A row's end also ends a word, so no word spans two rows.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[raw], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    borders = offsets[(offsets > 0) & (offsets < n)]
    starts[borders] = inside[1:-1][borders]
    ends[borders - 1] = inside[1:-1][borders - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word (A-Z lower-cased), and n + 1 word offsets by row."""
    low = LOWER[raw]
    start, end, by_row = word_spans(low, offsets, separators)
    return span_hashes(low, start, end), start, end, by_row


def shingles(hashed: np.ndarray, word_offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words and n + 1 offsets by row, repeats kept.

    A row with fewer words gives its whole sequence as one shingle; a row without words gives none.
    """
    counts = np.diff(word_offsets)
    rows = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(offsets[-1], np.uint64)
    if not len(out):
        return out, offsets
    row = np.repeat(np.arange(len(rows)), rows)
    first = word_offsets[:-1][row] + np.arange(len(out)) - offsets[:-1][row]
    length = np.minimum(counts[row], size)
    for k in range(size):
        held = length > k
        at = first if held.all() else np.where(held, first + k, 0)
        word = hashed[at + k] if at is first else hashed[at]
        out = np.where(held, mix(out * BASE + word), out)
    return out, offsets


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and their offsets."""
    parts = []
    sizes = np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        part = np.sort(values[offsets[i] : offsets[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
        sizes[i + 1] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def shingle_sets(column: pa.Array, size: int = 5, separators: np.ndarray = SPACE):
    """Distinct shingle hashes by row of a string column: (values, offsets), in slices of bounded memory."""
    raw, offsets = text_bytes(column)
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        hashed, _, _, by_row = words(raw[part[0] : part[-1]], part - part[0], separators)
        got, ends = distinct_by_row(*shingles(hashed, by_row, size))
        values.append(got)
        sizes.append(np.diff(ends))
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))
