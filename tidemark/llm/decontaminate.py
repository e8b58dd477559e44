"""Benchmark decontamination (operator 8): size-partitioned MinHash containment search.

An item of q distinct word shingles is found in a document that holds at least three
quarters of them, so it may miss q div 4.  Its MinHash sketch is its q div 4 + 1 smallest
shingle hashes: a document that holds the item holds one of these, however long it is.
Items are partitioned by size (powers of two), each partition with sketches of its own
length, and a document is held only against partitions it is large enough for.  Sketch
hits are then verified by exact shingle containment.

The items are the stated query set: they are shipped to the tasks in blocks of bounded
size, one pass over the documents a block.  That suits benchmarks, some ten thousand items a
block; an item table as large as the documents is a join of two corpora, which this is not.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .shared import cut

WORDS = 5
BLOCK_SHINGLES = 1 << 19
#: Hashes of a sketch are looked up by their first bits before they are searched.
SIEVE_BITS = 18


class Partition:
    """The items of one shingle length and size class, as arrays."""

    def __init__(self, words: int, items: list[tuple[int, np.ndarray]]):
        self.words, self.ids, self.sets = words, [i for i, _ in items], [s for _, s in items]
        self.need = [len(s) - len(s) // 4 for s in self.sets]
        sketches = [s[: len(s) // 4 + 1] for s in self.sets]
        keys = np.concatenate(sketches)
        owner = np.repeat(np.arange(len(items)), [len(s) for s in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[self.keys >> np.uint64(64 - SIEVE_BITS)] = True

    def hits(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles shared) of every row that holds enough of an item."""
        large = np.diff(offsets) >= min(self.need)
        at = np.flatnonzero(self.sieve[values >> np.uint64(64 - SIEVE_BITS)])
        first, last = np.searchsorted(self.keys, values[at], "left"), np.searchsorted(self.keys, values[at], "right")
        at, first, last = (x[last > first] for x in (at, first, last))
        rows = np.searchsorted(offsets, at, "right") - 1
        pairs = {(int(r), int(i)) for r, a, b in zip(rows, first, last, strict=True) if large[r] for i in self.owner[a:b]}
        for row, item in sorted(pairs):
            own = values[offsets[row] : offsets[row + 1]]
            place = np.minimum(np.searchsorted(own, self.sets[item]), len(own) - 1)
            shared = int((own[place] == self.sets[item]).sum())
            if shared >= self.need[item]:
                yield row, item, shared


def _partitions(items: list[tuple[int, int, bytes]]) -> list[Partition]:
    by = defaultdict(list)
    for item, words, packed in items:
        values = np.frombuffer(packed, np.uint64)
        by[words, len(values).bit_length()].append((item, values))
    return [Partition(words, rows) for (words, _), rows in sorted(by.items())]


def _found(partitions: list[Partition], texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item id, shingles of the item, shared) for one column of whole texts."""
    raw, offsets = hashing.text_bytes(texts)
    for a, b in hashing.slices(offsets):
        part = offsets[a : b + 1]
        hashed, _, _, by_row = hashing.words(raw[part[0] : part[-1]], part - part[0], hashing.NON_ALNUM)
        for words in sorted({p.words for p in partitions}):
            values, ends = hashing.distinct_by_row(*hashing.shingles(hashed, by_row, words))
            if not len(values):
                continue
            for p in partitions:
                if p.words == words:
                    for row, item, shared in p.hits(values, ends):
                        yield a + row, p.ids[item], len(p.sets[item]), shared


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words, hashes): an item of fewer than five words is one shingle of its own length."""
    for batch in batches:
        raw, offsets = hashing.text_bytes(batch.column("text"))
        hashed, _, _, by_row = hashing.words(raw, offsets, hashing.NON_ALNUM)
        values, ends = hashing.distinct_by_row(*hashing.shingles(hashed, by_row, WORDS))
        words = np.minimum(np.diff(by_row), WORDS)
        packed = [values[ends[i] : ends[i + 1]].tobytes() for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words.astype(np.int32)), pa.array(packed, pa.binary())], ["item", "words", "hashes"])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, int, bytes]]]:
    """The items in blocks of about ``BLOCK_SHINGLES`` shingles, which alone reach the driver."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    items = cut(items.mapInArrow(_item_sets, "item long, words int, hashes binary").where("words > 0").distinct())
    total = items.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    count = -(-total // (8 * BLOCK_SHINGLES))
    for block in range(count):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(count)) == block).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, item_shingles, shared, containment) of every document that holds an item.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, so case, punctuation
    and line breaks don't hide a passage.  An item with fewer than five words must stand in the
    document word for word.  Null, empty or blank texts hold nothing and are found nowhere; items
    without an id are left out; repeated documents or items each count (equal items once per id).
    Other columns are ignored; an empty table on either side gives an empty result.
    """
    spark, schema = docs.sparkSession, "id long, item_id long, item_shingles int, shared int"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col):
        shipped = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            partitions = _partitions(shipped.value)
            for batch in batches:
                found = list(_found(partitions, batch.column("text")))
                rows, ids, sizes, shared = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(shared, pa.int32())],
                    ["id", "item_id", "item_shingles", "shared"],
                )

        out = out.union(texts.mapInArrow(search, schema))
    return out.select(F.col("id").alias(id_col), "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (see ``contaminated``), without a shuffle."""
    spark, schema = docs.sparkSession, docs.schema
    index = docs.columns.index(text_col)
    if not isinstance(schema[index].dataType, T.StringType):
        raise TypeError(f"{text_col} must be a string column")
    for items in _blocks(benchmark, item_col, item_text_col):
        shipped = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            partitions = _partitions(shipped.value)
            for batch in batches:
                clean = np.ones(len(batch), dtype=bool)
                clean[[row for row, *_ in _found(partitions, batch.column(index))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs
