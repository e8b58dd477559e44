"""Substring dedup (operator 13) by recompression: words of repeated windows are removed.

1. Each of ``ROUNDS`` is a Spark round: texts are recompressed (see ``recompression``), and of the
   symbols that stand for several words each name's places are counted over all texts.  A name
   that stands at one place only settles that no window holding its context is repeated.  Later
   rounds look at the stretches that are still open, with symbols of another height.
2. What is left are stretches whose symbols are all shared.  Their windows are verified exactly:
   each gets a 128-bit name of its words, and a name at one place only is struck.

So a window of words that nobody shares never leaves its task, and every repeated one is found:
recompression makes the same symbols wherever a window stands.  Copies of a text are one text in
all this: places carry the text's hash, and equal places are merged map-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .recompression import parse
from .shared import cut

WINDOW = 35
#: (rounds of recompression, fewest words of a symbol that is counted) of each Spark round.
ROUNDS = ((4, 4), (3, 1))
#: A place is 24 bits of its text's crc32, 34 bits of the first word and 6 bits of a length.
LENGTH, FIRST = 6, 34
KEY = ["t", "c"]


def _words(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, byte offsets, words' first and last byte, word offsets) of texts, about a megabyte at a time; ``once`` skips texts that the task has met."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        if once:
            new = []
            for i, key in enumerate(zip(batch.column("t").to_pylist(), batch.column("c").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
        raw, offsets = hashing.text_bytes(batch.column("text"))
        for a, b in hashing.slices(offsets):
            part = offsets[a : b + 1] - offsets[a]
            own = raw[offsets[a] : offsets[b]]
            yield batch.slice(a, b - a), own, part, *hashing.word_spans(own, part)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each; a null is an empty list."""
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def _marks(batch: pa.RecordBatch, offsets: np.ndarray, first: str, end: str) -> np.ndarray:
    """Which words the rows' ranges [first, end) cover; ranges of a row don't overlap."""
    low, row = _lists(batch.column(first))
    high, _ = _lists(batch.column(end))
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, offsets[row] + low, 1)
    np.add.at(change, offsets[row] + high, -1)
    return np.cumsum(change[:-1]) > 0


def _ranges(marked: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The runs of marked words by row, as lists of first words and ends."""
    edge = np.zeros(len(marked) + 1, np.int8)
    edge[:-1] = marked
    starts = (edge[:-1] == 1) & (np.concatenate([[0], edge[:-2]]) == 0) if len(marked) else np.zeros(0, bool)
    ends = (edge[:-1] == 1) & (edge[1:] == 0)
    inner = offsets[(offsets > 0) & (offsets < len(marked))]
    starts[inner] |= marked[inner]
    ends[inner - 1] |= marked[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    by_row = np.searchsorted(first, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(by_row))
    lists = [pa.ListArray.from_arrays(pa.array(by_row.astype(np.int32)), pa.array(x - offsets[row])) for x in (first, last)]
    return lists[0], lists[1]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _, _, _, by_row in _words(batches, False):
        yield pa.RecordBatch.from_arrays([rows.column("t"), rows.column("c"), pa.array(np.diff(by_row))], ["t", "c", "n_words"])


def _places(rows: pa.RecordBatch, row: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(t, place) of each."""
    c = rows.column("c").to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.column("t").take(pa.array(row)), pa.array(c[row] << FIRST + LENGTH | first << LENGTH | length)


def _symbols(rounds: int, least: int, narrowed: bool):
    """(name, t, place): contexts, no longer than a window, of the symbols of ``least`` words or more in open stretches."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, _, start, end, by_row in _words(batches, True):
            p = parse(hashing.span_hashes(raw, start, end), by_row, rounds)
            after = np.append(p.start[1:], len(start))
            held = (after - p.start >= least) & (p.high - p.low <= WINDOW) & (p.low >= by_row[p.row]) & (p.high <= by_row[p.row + 1])
            if narrowed:  # windows that hold the context start from high - WINDOW to low
                open_ = np.concatenate([[0], np.cumsum(_marks(rows, by_row, "first", "end"))])
                held[held] &= open_[p.low[held] + 1] > open_[np.maximum(p.high[held] - WINDOW, by_row[p.row[held]])]
            t, place = _places(rows, p.row[held], p.low[held] - by_row[p.row[held]], p.high[held] - p.low[held])
            yield pa.RecordBatch.from_arrays([pa.array(p.name[held].view(np.int64)), t, place], ["name", "t", "place"])

    return named


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, other, t, place) of each open window: two 64-bit names from independent hashes of its words."""
    for rows, raw, _, start, end, by_row in _words(batches, True):
        at = np.flatnonzero(_marks(rows, by_row, "first", "end"))
        names = []
        for seed in (0, 13):
            word = hashing.span_hashes(raw, start, end, seed)
            name = np.zeros(len(at), np.uint64)
            for k in range(WINDOW):
                name = hashing.mix(name * hashing.BASE + word[at + k])
            names.append(pa.array(name.view(np.int64)))
        row = np.searchsorted(by_row, at, "right") - 1
        yield pa.RecordBatch.from_arrays([*names, *_places(rows, row, at - by_row[row], np.full(len(at), WINDOW))], ["name", "other", "t", "place"])


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open ranges less the windows that hold a struck context."""
    for batch in batches:
        sizes = batch.column("n_words").to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place, row = _lists(batch.column("struck"))
        low = place >> LENGTH & (1 << FIRST) - 1
        high = low + (place & (1 << LENGTH) - 1)
        change = np.zeros(offsets[-1] + 1, np.int64)
        np.add.at(change, offsets[row] + np.maximum(high - WINDOW, 0), 1)
        np.add.at(change, offsets[row] + low + 1, -1)
        open_ = _marks(batch, offsets, "first", "end") & (np.cumsum(change[:-1]) == 0)
        first, end = _ranges(open_, offsets)
        held = np.flatnonzero(np.diff(first.offsets.to_numpy()))
        columns = [batch.column("t"), batch.column("c"), batch.column("n_words"), first, end]
        yield pa.RecordBatch.from_arrays([x.take(pa.array(held)) for x in columns], ["t", "c", "n_words", "first", "end"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept_sha256) of each row, without the words of its windows from ``first`` to ``end``."""
    for rows, raw, offsets, start, end, by_row in _words(batches, False):
        low, row = _lists(rows.column("first"))
        high, _ = _lists(rows.column("end"))
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, by_row[row] + low, 1)
        np.add.at(change, by_row[row] + high + WINDOW - 1, -1)
        kept = np.cumsum(change[:-1]) == 0
        count = np.concatenate([[0], np.cumsum(kept)])
        # Each kept word's bytes, and one of the bytes between it and the next word as a space if another is kept in its row.
        more = kept & (count[1:] < count[by_row[np.searchsorted(by_row, np.arange(len(start)), "right")]])
        out = np.append(raw, np.uint8(0))
        out[end[more]] = 0x20
        change = np.zeros(len(raw) + 2, np.int64)
        change[start[kept]] += 1
        np.add.at(change, (end + more)[kept], -1)
        mask = np.cumsum(change[:-2]) > 0
        text, ends = out[:-1][mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[offsets].tolist()
        digests = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        sizes = np.diff(by_row)
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes), pa.array(sizes - np.diff(count[by_row])), pa.array(digests, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _once(named: DataFrame, *names: str) -> DataFrame:
    """(t, c, struck): by text, the places of the names that stand at one place only."""
    ends = named.groupBy(*names).agg(F.min("t").alias("t"), F.max("t").alias("t2"), F.min("place").alias("place"), F.max("place").alias("place2"))
    single = ends.where("t = t2 and place = place2").withColumn("c", F.shiftrightunsigned("place", FIRST + LENGTH).cast("int"))
    return single.groupBy(*KEY).agg(F.collect_list("place").alias("struck"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row of ``docs``, without the words of repeated windows.

    A window is ``WINDOW`` consecutive words (parted by space and \\x09-\\x0D, unchanged) of one
    row; it is repeated if its words also start at any other place of any row.  Each word in one
    is removed; windows are those of the input.  ``kept_sha256`` is of the kept words joined by
    one space.  Null and empty texts have no words; rows repeated, or equal in text, repeat each
    other, so nothing of ``WINDOW`` words or more is kept of them; ids may be null or repeat,
    other columns are ignored, and an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), (F.crc32(F.encode(text, "UTF-8")) % (1 << 24)).cast("int").alias("c"), text.alias("text"))
    texts = rows.select("t", "c", "text")
    ranges = "t long, c int, n_words long, first array<long>, end array<long>"
    sizes = texts.mapInArrow(_sizes, "t long, c int, n_words long").groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    sizes = cut(sizes.where(F.col("n_words") >= WINDOW))
    all_windows = sizes.select(*KEY, "n_words", F.array(F.lit(0).cast("long")).alias("first"), F.array(F.col("n_words") - WINDOW + 1).alias("end"))
    open_ = all_windows
    for i, (rounds, least) in enumerate(ROUNDS):
        within = texts.join(open_, KEY) if i else texts
        named = within.mapInArrow(_symbols(rounds, least, i > 0), "name long, t long, place long")
        open_ = cut(open_.join(_once(named, "name"), KEY, "left").mapInArrow(_narrow, ranges))
    named = texts.join(open_, KEY).mapInArrow(_windows, "name long, other long, t long, place long")
    alone = open_.join(sizes.where("copies = 1").select(*KEY), KEY, "left_semi")
    repeated = alone.join(_once(named, "name", "other"), KEY, "left").mapInArrow(_narrow, ranges)
    copied = all_windows.join(sizes.where("copies > 1").select(*KEY), KEY, "left_semi")
    removed = cut(repeated.union(copied).select(*KEY, "first", "end"))
    return rows.join(removed, KEY, "left").select("id", "text", "first", "end").mapInArrow(_kept, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
