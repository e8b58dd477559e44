"""Structured Streaming forms of the intraday operators over (ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources import sinks


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events under ``path`` as a stream, ``ts`` as a UTC instant; each trigger is bounded by a number of files."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tick_mean(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(start, mean_value, n): mean over 15-minute windows that slide by one minute."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "15 minutes", "1 minute").alias("w")).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean_value", "n")


def session_vwap(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, vwap): value weighted by user volume per day; state is one row a day and type."""
    volume = F.col("user_id") % 100 + 1
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg((F.sum(F.col("value") * volume) / F.sum(volume)).alias("vwap")).select(F.to_date("w.start").alias("day"), "event_type", "vwap")


def once_a_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type): the first alert of a type on a day; later ones within the watermark are dropped.

    As a stream it loses events that come more than ``late`` after newer ones; see ``alert_days`` for a backlog.
    """
    days = events.withColumn("day", F.to_date("ts"))
    if not events.isStreaming:
        return days.select("day", "event_type").distinct()
    return days.withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "event_type"]).select("day", "event_type")


def alert_days(events: DataFrame) -> DataFrame:
    """(day, event_type) of all events, whatever their order; for complete mode, state is one row a day and type."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).select("day", "event_type")


def drain(df: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream over what is there, its batches written under ``folder``; of rows of equal ``keys`` the last batch's counts.

    Update mode: a batch writes only the keys that it changed, so state stays behind the watermark
    and no result passes through the driver.  A batch that is repeated replaces its own files.
    """

    written = []

    def write(rows: DataFrame, batch: int) -> None:
        written.append(batch)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = df.sparkSession
    if not written:
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*df.columns)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a query whose batches go through an idempotent writer such as ``finalise``: what is there, or a scan ``every`` so often."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finalise(path: str, schema: str, keys: list[str], partition: str = "d") -> Callable[[DataFrame, int], None]:
    """A batch writer in which stored final rows stay as they are and all others are replaced by key."""

    def write(rows: DataFrame, batch: int) -> None:
        old = sinks.stored(rows.sparkSession, path, schema)
        sinks.upsert(sinks.protect_final(rows, old, keys), old, keys, path, partition)

    return write
