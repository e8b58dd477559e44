"""Helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folders

#: Settings while a step runs: Spark drops its shuffle files at its end, and Python gets texts in batches of bounded
#: bytes, so that a task holds a few megabytes of them at a time.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside go by ``STEP``; the session's own settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in STEP}
    for k, v in STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the cluster's shared folder (see ``folders``).

    The shuffle files that led to it are dropped then: nothing reads them any more.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folders.shared(spark))
    with step(spark):
        return df.select("*").checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into no fold (null)."""
    return F.crc32(F.encode((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), "UTF-8")) % folds


#: Entries of an array that deals out a row's copies.
STEP_COPIES = 1 << 16


def each_copy(df: DataFrame, count: str, number: str) -> DataFrame:
    """Each row of ``df`` ``count`` times, with ``number`` from 0; dealt in two steps, so that no array is as long as a large count."""
    (step_,) = unused(df, "step")
    many = df.withColumn(step_, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {STEP_COPIES}L"))))
    first = F.col(step_) * STEP_COPIES
    return many.withColumn(number, F.explode(F.sequence(first, F.least(F.col(count), first + STEP_COPIES) - 1))).drop(step_)


def numbered(df: DataFrame, number: str, weight: str | None = None) -> DataFrame:
    """``df`` computed once, its rows numbered without gaps from 0, partition after partition and in each one's order.

    With ``weight`` a row's number is the sum of the weights before it.  Only the partitions' totals are ordered in one task.
    """
    at, part, base = unused(df, "at", "part", "base")
    held = cut(df.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    totals = held.groupBy(part).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select(F.col(part), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias(base)))
    inside = F.sum(weight).over(Window.partitionBy(part).orderBy(at)) - F.col(weight) if weight else F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(offsets, part).withColumn(number, F.col(base) + inside).drop(at, part, base)
