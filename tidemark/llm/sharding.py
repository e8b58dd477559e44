"""Proportional stratified interleaving into shards (operator 10).

Rows of each source are shuffled by a seeded hash and ranked; ordered by fractional rank
(2 * rank - 1) / (2 * rows of the source), every stretch of the order holds the sources in
the mixture's proportions, so cutting it evenly gives each shard that mixture.

Ranks come from counts: hash ranges are counted and their offsets summed, and only rows
inside one range are sorted together.  So a source with a third of all rows is ranked by
as many tasks as it has ranges, and no task ever orders the whole table.  Rows that are
equal in all that matters here are counted first and dealt as one until their places are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, each_copy

SEED = 20_240_607
ROWS_PER_RANGE = 10_000
#: Stretches whose offsets one task sums.
BLOCK = 4096


def stratified_shards(docs: DataFrame, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    The law is ``rows``: shards differ by one row at most, each with the sources' proportions;
    ``slot`` counts from 0 in every shard and ``grown_shard`` is null.  A null text has size 8
    and the crc32 of nothing, a null source is a stratum of its own, null and repeated ids and
    equal rows are kept one by one, other columns are ignored, and an empty table gives none.
    The layout depends on the rows and the seed alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
    )
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), "stratum", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("crc").cast("string")))
    rows = rows.withColumn("h", F.substring(shuffled, 1, 16))
    rows = cut(rows.groupBy("h", "stratum", "id", "crc", "size").agg(F.count("*").alias("copies")))
    total = rows.agg(F.sum("copies")).first()[0] or 0
    digits = 0
    while total > ROWS_PER_RANGE << 4 * digits:
        digits += 1
    ranges = 1 << 4 * digits
    rows = rows.withColumn("range", F.substring("h", 1, digits) if digits else F.lit(""))  # hexadecimal digits ascend as the hash does

    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("stratum", "range").agg(F.sum("copies").alias("n")).select(
        "stratum", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy("stratum")).alias("of"),
    )
    inside = F.sum("copies").over(Window.partitionBy("stratum", "range").orderBy("h", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.join(offsets, ["stratum", "range"]).withColumn("last", F.col("below") + inside)
    ranked = each_copy(ranked, "copies", "copy").withColumn("rank", F.col("last") - F.col("copy"))
    ranked = ranked.select("id", "size", "crc", "stratum", "h", "of", (2 * F.col("rank") - 1).alias("odd"))
    ranked = cut(ranked.withColumn("stretch", F.expr(f"odd * {ranges}L div (2 * of)")))

    # The stretches' offsets in two levels: a stretch within its block, a block among all.
    counts = ranked.groupBy("stretch").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"stretch div {BLOCK}L"))
    up = Window.unboundedPreceding
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(up, -1)), F.lit(0)).alias("base"))
    offsets = counts.join(blocks, "block").select("stretch", (F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("stretch").rowsBetween(up, -1)), F.lit(0))).alias("below"))
    inside = F.row_number().over(Window.partitionBy("stretch").orderBy(F.col("odd") / F.col("of"), "h", "stratum", "id", "crc", "size"))
    placed = ranked.join(offsets, "stretch").withColumn("place", F.col("below") + inside - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards}L div {max(1, total)}L as int)"))
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("place") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
