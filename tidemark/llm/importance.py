"""Importance resampling toward a target distribution (operator 11).

1. Features (runs of 1 to ``LONGEST`` words) are hashed into buckets, counted in each task's own
   array and summed; both distributions are ``BUCKETS`` counts, whatever the corpus.
2. Texts are scored by looking their features' buckets up in an array of gains; a seeded Gumbel
   term makes the highest scores a weighted draw without replacement.
3. The cut-off key is found by weighted median of medians: each block of remaining keys gives its
   median and its size, and the median of those, weighted by the sizes, is the next pivot.  At
   least a quarter of the keys lies on either side of it, so a known share is discarded each
   round, until the pivot is the cut-off itself.  Only the winners are then sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crc, hashing
from .shared import cut, each_copy, numbered

BUCKETS = 10_000
LONGEST = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Keys of which one median is taken; a task's memory holds one block.
BLOCK = 1 << 20


def _buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, row after the last, word offsets, buckets of the runs of 1, 2, ... words from each word on, -1 where a text ends before) of about a megabyte of texts at a time."""
    raw, offsets = hashing.text_bytes(batch.column("text"))
    for a, b in hashing.slices(offsets):
        low = hashing.LOWER[raw[offsets[a] : offsets[b]]]
        start, end, by_row = hashing.word_spans(low, offsets[a : b + 1] - offsets[a], hashing.NON_ALNUM)
        size, own = end - start, crc.from_zero(low, start, end)
        row = np.repeat(np.arange(b - a), np.diff(by_row))
        state = crc.advance(np.full(len(start), crc.INIT), size) ^ own
        runs = []
        for n in range(LONGEST):
            if n:
                state = crc.joined(state[: len(state) - 1], own[n:], size[n:], 0x20)
            bucket = np.full(len(start), -1, np.int64)
            whole = row[n:] == row[: len(row) - n] if n else slice(None)
            bucket[: len(state)][whole] = ((state ^ crc.INIT) % BUCKETS)[whole]
            runs.append(bucket)
        yield a, b, by_row, runs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for *_, runs in _buckets(batch):
            for bucket in runs:
                counts += np.bincount(bucket + 1, minlength=BUCKETS + 1)[1:]
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = np.zeros(BUCKETS, np.int64)
    for row in texts.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target by its share in the corpus."""
    all_s, all_t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    """(id, n_words, n_features, weight) of each row."""
    padded = np.append(gain, 0)  # -1 looks up nothing

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, by_row, runs in _buckets(batch):
                sums = np.concatenate([[0], np.cumsum(sum(padded[x] for x in runs))])
                held = np.concatenate([[0], np.cumsum(sum((x >= 0).astype(np.int64) for x in runs))])
                columns = [np.diff(by_row), held[by_row[1:]] - held[by_row[:-1]], sums[by_row[1:]] - sums[by_row[:-1]]]
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], *map(pa.array, columns)], ["id", "n_words", "n_features", "weight"])

    return weigh


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256('seed:id'); a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


class Key(NamedTuple):
    """The order of the draw: highest score first, then smallest id (nulls last), then fewest features."""

    minus_score: int
    no_id: int
    id: int
    n_features: int


ORDER = list(Key._fields)


def _before(keys: np.ndarray, pivot: Key) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``keys`` (a column each) come before the pivot, and which equal it."""
    earlier, equal = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
    for i, value in enumerate(pivot):
        earlier |= equal & (keys[:, i] < value)
        equal &= keys[:, i] == value
    return earlier, equal


def _weighted_median(keys: np.ndarray, weights: np.ndarray) -> tuple[Key, int]:
    """The first key, in order, with half of all weights up to it; and the sum of the weights."""
    order = np.lexsort(keys.T[::-1])
    sums = np.cumsum(weights[order])
    at = int(np.searchsorted(2 * sums, sums[-1]))
    return Key(*keys[order[at]].tolist()), int(sums[-1])


def _reports(low: Key | None, high: Key | None, pivot: Key | None):
    """By block, the median and size of the keys between ``low`` and ``high`` before (-1), at (0) and after (1) the pivot."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(block)
            keys, copies = rows[:, :-1], rows[:, -1]
            earlier, equal = _before(keys, pivot) if pivot else (np.ones(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool))
            for side, held in ((-1, earlier), (0, equal), (1, ~earlier & ~equal)):
                if held.any():
                    median, size = _weighted_median(keys[held], copies[held])
                    yield pa.RecordBatch.from_pylist([dict(zip(ORDER, median, strict=True)) | {"side": side, "size": size, "keys": int(held.sum())}], REPORT_ARROW)

        block, held = [], 0
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*ORDER, "copies"]], axis=1)
            if low is not None:
                earlier, equal = _before(rows, low)
                rows = rows[~earlier & ~equal]
            if high is not None:
                rows = rows[_before(rows, high)[0]]
            for at in range(0, len(rows), BLOCK):
                block.append(rows[at : at + BLOCK])
                held += len(block[-1])
                if held >= BLOCK:
                    yield from told(block)
                    block, held = [], 0
        if held:
            yield from told(block)

    return report


REPORT = ", ".join(f"{c} long" for c in [*ORDER, "side", "size", "keys"])
REPORT_ARROW = pa.schema([(c, pa.int64()) for c in [*ORDER, "side", "size", "keys"]])


def _between(low: Key | None, high: Key | None) -> Column:
    key, held = F.struct(*ORDER), F.lit(True)
    as_struct = lambda k: F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, k, strict=True)))
    if low is not None:
        held = held & (key > as_struct(low))
    return held if high is None else held & (key < as_struct(high))


def select_key(keys: DataFrame, wanted: int) -> Key:
    """The key at place ``wanted`` (from 1) of all copies of ``keys`` in order.

    ``keys`` has the columns of ``Key`` and ``copies``, at least ``wanted`` in all.  Each round reads
    what is stored, which is written anew when less than a quarter of it remains.
    """
    low = high = pivot = None
    stored, rows_stored = keys, None
    while True:
        found = [(r.side, Key(*r[: len(ORDER)]), r.size, r["keys"]) for r in stored.mapInArrow(_reports(low, high, pivot), REPORT).collect()]  # three rows a block of keys
        size = {side: sum(f[2] for f in found if f[0] == side) for side in (-1, 0, 1)}
        if wanted <= size[-1]:
            side, high = -1, pivot
        elif wanted <= size[-1] + size[0]:
            return pivot
        else:
            side, low, wanted = 1, pivot, wanted - size[-1] - size[0]
        left = [f for f in found if f[0] == side]
        pivot, _ = _weighted_median(np.array([f[1] for f in left], np.int64), np.array([f[2] for f in left], np.int64))
        rows = sum(f[3] for f in left)
        if rows_stored is None:
            rows_stored = rows
        elif 4 * rows < rows_stored:
            stored, rows_stored = cut(stored.where(_between(low, high)).coalesce(rows // BLOCK + 1)), rows


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` of those drawn toward ``target``, else null.

    A-Z is lower-cased; words are runs of ASCII letters, digits and non-ASCII bytes.  Of the rows with
    ``LEAST_WORDS`` words or more, floor(percent / 100) are drawn, by score, then smaller id.  Null and
    empty texts have no features and weight 0; a null id draws as an empty one and comes after all ids
    of its score.  Rows repeated, or with one id, are drawn one by one; of rows with equal id and score
    those with fewer features come first.  Empty ``docs`` give none, an empty target has no features,
    and other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    weighed = texts.mapInArrow(_weighed(gain), "id long, n_words long, n_features long, weight long")
    rows = weighed.groupBy("id", "n_words", "n_features", "weight").agg(F.count("*").alias("copies")).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    rows = cut(rows)
    eligible = F.col("n_words") >= LEAST_WORDS
    drawn = (rows.where(eligible).agg(F.sum("copies")).first()[0] or 0) * percent // 100
    order = rows.withColumns({"minus_score": -F.col("score"), "no_id": F.col("id").isNull().cast("long"), "key_id": F.coalesce("id", F.lit(0).cast("long"))})
    fields = ["id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return each_copy(rows, "copies", "copy").select(*fields, unranked).withColumnRenamed("id", id_col)
    keys = order.where(eligible).select("minus_score", "no_id", F.col("key_id").alias("id"), "n_features", "copies")
    last = select_key(keys, drawn)
    key = F.struct("minus_score", "no_id", F.col("key_id").alias("id"), "n_features")
    wins = eligible & (key <= F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, last, strict=True))))
    sorting = ["minus_score", "no_id", "key_id", "n_features"]
    winners = numbered(order.where(wins).repartitionByRange(*sorting).sortWithinPartitions(*sorting), "above", "copies")
    place = F.col("above") + F.col("copy") + 1
    ranked = each_copy(winners, "copies", "copy").select(*fields, F.when(place <= drawn, place).alias("rank"))
    rest = each_copy(order.where(~wins), "copies", "copy").select(*fields, unranked)
    return ranked.union(rest).withColumnRenamed("id", id_col)
