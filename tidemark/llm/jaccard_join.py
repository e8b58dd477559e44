"""N-gram Jaccard join with vertical partitioning (operator 1).

The global order of the n-grams is that of their 64-bit hashes.  It is cut into
``FRAGMENTS`` equal ranges; a document's set falls into one segment per fragment,
overlaps are counted in each fragment separately and summed per pair.

1. Fragments prune documents.  Of n n-grams a document may miss at most n / 4 in
   any partner, so one with more than n / 4 n-grams that no other text has is
   linked with nothing.  The first ``PROBED`` fragments settle that for most.
2. Among the rest, rarest n-grams first, the prefix filter applies: two linked
   documents share one of the first n / 4 + 1.  Families of near copies are merged
   in rounds that are linear in these prefixes: each n-gram whose documents lie in
   several components holds them against one of its documents (the hub, another
   one each round), until no more links than prefix rows are to be expected.
3. Only pairs from components that still are different then remain, and are all
   tried.  Length, position and bitmap (parity of hashed n-grams) bounds, each
   lossless, leave few of them; of two documents one has its first common n-gram
   among its first n / 7 + 1, which are the one side of that join.

Nothing is capped or sampled: every pair that links lies in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .components import connected_components
from .shared import cut, unused

FRAGMENTS = 8
PROBED = 3
WORDS = 5
SIGNATURE_LONGS = 16


#: Rows of an Arrow batch that are hashed together; a task's memory is a few copies of their texts.
ROWS = 1000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _unseen(nodes: pa.Array, seen: set[bytes]) -> pa.Array:
    """Places of nodes that this task meets for the first time."""
    new = []
    for i, node in enumerate(nodes.to_pylist()):
        if node not in seen:
            seen.add(node)
            new.append(i)
    return pa.array(new, pa.int64())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, t, n) of the n-grams in the probed fragments; a text repeated in this task is skipped."""
    limit = np.uint64((PROBED << 64) // FRAGMENTS)
    seen: set[bytes] = set()
    for batch in _parts(batches):
        new = _unseen(batch.column("node"), seen)
        texts = batch.column("text").take(new)
        marks = batch.column("t").take(new).to_numpy(zero_copy_only=False)
        raw, offsets = hashing.text_bytes(texts)
        for a, b in hashing.slices(offsets):
            part = offsets[a : b + 1]
            hashed, _, _, by_row = hashing.words(raw[part[0] : part[-1]], part - part[0])
            values, ends = hashing.distinct_by_row(*hashing.shingles(hashed, by_row, WORDS))
            sizes = np.diff(ends)
            held = values < limit
            row = np.repeat(np.arange(b - a), sizes)[held]
            yield pa.RecordBatch.from_arrays([pa.array(values[held].view(np.int64)), pa.array(marks[a:b][row]), pa.array(sizes[row].astype(np.int32))], ["hash", "t", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's n-grams by fragment, its set size and its parity bitmap."""
    bits = 64 * SIGNATURE_LONGS
    seen: set[bytes] = set()
    for batch in _parts(batches):
        batch = batch.take(_unseen(batch.column("node"), seen))
        raw, offsets = hashing.text_bytes(batch.column("text"))
        for a, b in hashing.slices(offsets):
            part = offsets[a : b + 1]
            hashed, _, _, by_row = hashing.words(raw[part[0] : part[-1]], part - part[0])
            values, ends = hashing.distinct_by_row(*hashing.shingles(hashed, by_row, WORDS))
            sizes = np.diff(ends)
            row = np.repeat(np.arange(b - a), sizes)
            cell = row * bits + (values >> np.uint64(20)).astype(np.int64) % bits
            parity = (np.bincount(cell, minlength=(b - a) * bits) & 1).astype(np.uint8)
            signature = np.packbits(parity).view(np.int64)
            segment = row * FRAGMENTS + (values >> np.uint64(64 - (FRAGMENTS - 1).bit_length())).astype(np.int64)
            borders = np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=(b - a) * FRAGMENTS))]).astype(np.int32)
            segments = pa.ListArray.from_arrays(pa.array(borders), pa.array(values.view(np.int64)))
            fragments = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * FRAGMENTS), segments)
            signatures = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * SIGNATURE_LONGS), pa.array(signature))
            yield pa.RecordBatch.from_arrays([batch.column("node")[a:b], pa.array(sizes), signatures, fragments], ["node", "n", "signature", "fragments"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link: overlaps counted by fragment, summed per pair."""
    left = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.posexplode("fragments").alias("f", "left")).where(F.size("left") > 0)
    right = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.posexplode("fragments").alias("f", "right")).where(F.size("right") > 0)
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).cast("long").alias("shared"))
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where("100 * shared >= 75 * (na + nb - shared)").select("a", "b")


def _fits(x: str, y: str) -> Column:
    """Length and position bounds: before their first common n-gram both documents only miss."""
    na, nb = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = F.ceil((na + nb) * 3 / 7)
    return (100 * F.least(na, nb) >= 75 * F.greatest(na, nb)) & (F.col(f"{x}.at") + F.col(f"{y}.at") <= na + nb - 2 * least)


def _close(x: str, y: str) -> Column:
    """The bitmap bound: documents differ in at least as many n-grams as their parity bitmaps in bits."""
    differing = sum((F.bit_count(F.col(f"{x}.signature")[i].bitwiseXOR(F.col(f"{y}.signature")[i])) for i in range(SIGNATURE_LONGS)), F.lit(0))
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return both - differing >= 2 * F.ceil(both * 3 / 7)


def _placed(prefix: DataFrame, parts: DataFrame) -> DataFrame:
    """The prefix rows with their documents' components c."""
    return prefix.join(parts.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")


def _open(placed: DataFrame) -> DataFrame:
    """The rows of n-grams whose documents lie in several components."""
    mixed = placed.groupBy("hash").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("hash")
    return placed.join(mixed, "hash")


def _across(placed: DataFrame) -> tuple[float, float]:
    """How many pairs of rows of one n-gram lie in different components, and how many rows there are."""
    by_part = placed.groupBy("hash", "c").agg(F.count("*").cast("double").alias("n"))
    by_hash = by_part.groupBy("hash").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    pairs, rows = by_hash.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.sum("n")).first()
    return pairs or 0.0, rows or 0.0


def _merge(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``parts`` once those that ``links`` join are merged."""
    ends = links.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    roots = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = parts.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return cut(moved.union(roots))


def _families(prefix: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of all links: rounds of hubs, then the pairs of components that are still apart."""
    marks = sets.select("k", "signature")
    parts = sets.sparkSession.createDataFrame([], "node long, component long")
    turn, more = 0, True
    while more:
        rows = _open(_placed(prefix, parts))
        # First the document with the fewest n-grams of its own, the same for all of a family's n-grams; then any.
        order = F.struct(F.col("only") / F.col("n"), "k") if turn == 0 else F.struct(F.xxhash64("k", "hash", F.lit(turn)), "k")
        hubs = rows.groupBy("hash").agg(F.min_by(F.struct("k", "n", "at", "c"), order).alias("h")).select("hash", "h.*")
        x, y = rows.alias("x"), hubs.alias("y")
        star = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.c") != F.col("y.c")) & _fits("x", "y"))
        pairs = star.select(F.col("y.k").alias("a"), F.col("x.k").alias("b"), F.col("y.n").alias("na"), F.col("x.n").alias("nb")).distinct()
        x, y = marks.alias("p"), marks.alias("q")
        near = pairs.join(x, F.col("a") == F.col("p.k")).join(y, F.col("b") == F.col("q.k")).select(F.struct("a", F.col("na").alias("n"), "p.signature").alias("x"), F.struct("b", F.col("nb").alias("n"), "q.signature").alias("y"))
        links = cut(_overlaps(near.where(_close("x", "y")).select("x.a", "y.b"), sets))
        added, turn = links.count(), turn + 1
        if added:
            parts = _merge(parts, links)
            # A round tries a pair a row; if ``added`` of them link, so does the same share of all pairs at most.
            pairs_left, size = _across(_placed(prefix, parts))
        more = added > 0 and added * pairs_left > size * size

    rows = _open(_placed(prefix, parts)).join(marks, "k").withColumn("excess", 7 * F.col("at") - F.col("n"))
    x, y = rows.where("excess <= 0").alias("x"), rows.alias("y")
    later = (F.col("y.excess") > F.col("x.excess")) | ((F.col("y.excess") == F.col("x.excess")) & (F.col("y.k") > F.col("x.k")))
    apart = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.c") != F.col("y.c")) & later & _fits("x", "y") & _close("x", "y"))
    return _merge(parts, cut(_overlaps(apart.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct(), sets)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("node"), F.xxhash64(text).alias("t"), text.alias("text"))


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct text: (node, rep, n, smallest, part).

    ``rep`` is its smallest id, ``n`` its set size, ``smallest`` its component's smallest id and
    ``part`` a name of the component.
    """
    lone = (
        rows.select("node", "t", "text")
        .mapInArrow(_probe, "hash long, t long, n int")
        .groupBy("hash")
        .agg(F.min("t").alias("t"), F.max("t").alias("other"), F.max("n").alias("n"))
        .where("t = other")
        .groupBy("t")
        .agg(F.count("*").alias("lone"), F.max("n").alias("n"))
        .where("4 * lone > n")
        .select("t", F.col("n").cast("long").alias("lone_n"))
    )
    classes = rows.groupBy("node").agg(F.min("id").alias("rep"), F.first("t").alias("t")).withColumn("alone", F.count("*").over(Window.partitionBy("t")) == 1)
    # Of texts that differ but share t none counts as settled: their n-grams were taken for those of one.
    classes = cut(classes.join(lone, "t", "left").select("node", "rep", F.when(F.col("alone"), F.col("lone_n")).alias("lone_n")))

    # One row of each class goes on: the explicit repartition keeps equal rows in one task, for _sets to skip repeats.
    no_id = F.lit(-(1 << 63)).cast("long")
    kept = classes.where("lone_n is null").select("node", F.coalesce("rep", no_id).alias("one"))
    texts = rows.select("node", F.coalesce("id", no_id).alias("one"), "text").repartition("node", "one").join(kept, ["node", "one"])
    sets = cut(texts.select("node", "text").mapInArrow(_sets, "node binary, n long, signature array<long>, fragments array<array<long>>"))
    sets = sets.withColumn("k", F.monotonically_increasing_id())

    grams = sets.where("n > 0").select("k", F.explode(F.flatten("fragments")).alias("hash"))
    spread = grams.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(spread, "hash").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("grams"))
    shared = shared.join(sets.select("k", "n"), "k").where("4 * size(grams) >= 3 * n")
    prefix = cut(
        shared.select("k", "n", (F.col("n") - F.size("grams")).alias("only"), "grams")
        .select("k", "n", "only", F.posexplode(F.expr("slice(grams, 1, int(n div 4 + 1 - only))")).alias("i", "g"))
        .select(F.col("g.hash").alias("hash"), "k", "n", "only", (F.col("only") + F.col("i")).alias("at"))
    )
    parts = _families(prefix, sets)

    placed = sets.select("node", "k", "n").join(parts.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k"))
    placed = placed.select("node", "n", "c").join(classes.select("node", "rep"), "node")
    smallest = cut(placed.groupBy("c").agg(F.min("rep").alias("smallest"), F.min("node").alias("part")))  # so that Spark can split the join of a large component
    placed = placed.join(smallest, "c").select("node", "n", "smallest", "part")
    return classes.join(placed, "node", "left").select("node", "rep", F.coalesce("n", "lone_n").alias("n"), F.coalesce("smallest", "rep").alias("smallest"), F.coalesce("part", "node").alias("part"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of ``docs``: (id, n_shingles, component_id), one row per row of ``docs``.

    Two rows link when 100 * intersection >= 75 * union of their distinct 5-word shingles (A-Z
    lower-cased; words part at space and \\x09-\\x0D; a shorter text is one shingle).  A null,
    empty or blank text has n_shingles 0 and its own id as component.  Rows repeated, or equal in
    text, share a component.  component_id is the smallest id reachable; a null id counts as
    absent, so it stays null only where no linked row has one.  Other columns are ignored, and an
    empty table gives an empty one.
    """
    rows = _texts(docs, id_col, text_col)
    classes = cut(_classes(rows))  # so that Spark can split the join of a text with very many copies
    return rows.select("id", "node").join(classes, "node").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate component: the one with its smallest id.

    A component without any id keeps one row too.  Texts without words link with nothing and all stay.
    """
    rows = _texts(docs, id_col, text_col)
    classes = _classes(rows)
    chosen = classes.where("n > 0").groupBy("part").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("m"))
    kept = cut(chosen.select("m.node", "m.rep", F.lit(True).alias("one")).union(classes.where("n = 0").select("node", F.lit(None).cast("long"), F.lit(False))))
    own = unused(docs, "node", "key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumns({own[0]: F.unhex(F.md5(text)), own[1]: F.col(id_col).cast("long")})
    blank = marked.join(kept.where("not one").select(F.col("node").alias(own[0])), own[0], "left_semi").select(*docs.columns)
    wanted = kept.where("one").select(F.col("node").alias("n"), F.col("rep").alias("r"))
    one = marked.alias("m").join(wanted.alias("w"), (F.col(f"m.{own[0]}") == F.col("w.n")) & F.col(f"m.{own[1]}").eqNullSafe(F.col("w.r")), "left_semi").select(*docs.columns)
    again = rows.groupBy("id", "node").count().where("count > 1").join(wanted, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("r")), "left_semi")
    if not again.isEmpty():
        one = one.dropDuplicates([id_col, text_col])
    return one.union(blank)
