"""Idempotent writers over Parquet partitioned by date; each replaces whole partitions at once."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import MISSING, keep_last
from . import folders

log = logging.getLogger(__name__)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Rows of a file.
ROWS_PER_FILE = 1 << 20


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Write the dates that ``df`` holds, leaving others alone.

    Rows are rebalanced by date: Spark puts small dates together and splits a large one over
    several tasks; files have a bounded number of rows.
    """
    df.hint("rebalance", partition).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(new: DataFrame, old: DataFrame, keys: list[str], path: str, partition: str, order: list[str] | None = None) -> None:
    """New rows replace stored ones of their key; among new rows of a key the last in ``order`` (by default of all columns).

    Only the touched dates are read back and written.  What will stand there is written to a
    folder of its own first, since the old rows' partitions are overwritten.
    """
    spark = new.sparkSession
    dates = new.select(partition).distinct()
    kept = old.join(F.broadcast(dates), partition, "left_semi").join(new.select(*keys).distinct(), keys, "left_anti")
    latest = keep_last(new, keys, order or [c for c in new.columns if c not in keys])
    merged, staged = latest.unionByName(kept, allowMissingColumns=True), folders.fresh(spark, "upsert")
    merged.write.parquet(staged)
    replace_partitions(spark.read.schema(merged.schema).parquet(staged), path, partition)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Rows added to a log; none is looked at again."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


LEDGER = "job string, report_date date, rows long, missing map<string,long>, status string, recorded_at timestamp"


def recorded(df: DataFrame, write: Callable[[DataFrame], None], ledger: str, job: str, day: str, fields: list[str], most: float = 0.0) -> str:
    """Writes ``df`` and adds a row to the ledger: rows, and how many lack each field, counted by the very write.

    ``write`` must read its rows once.  The status is ``empty`` without rows, ``failed`` if the
    write raised (which it does again after the entry), ``degraded`` if a field is missing in more
    than the share ``most`` of the rows, else ``ok``.
    """
    spark, seen = df.sparkSession, Observation()
    lacks = [F.count_if(F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin(MISSING)).alias(f"m{i}") for i, c in enumerate(fields)]
    rows, missing, status = None, {}, "failed"
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *lacks))
        found = seen.get
        rows, missing = found["rows"], {c: found[f"m{i}"] for i, c in enumerate(fields)}
        status = "empty" if not rows else "degraded" if any(n > most * rows for n in missing.values()) else "ok"
    finally:
        entry = spark.createDataFrame([(job, day, rows, missing, status)], "job string, day string, rows long, missing map<string,long>, status string")
        append(entry.select("job", F.col("day").cast("date").alias("report_date"), "rows", "missing", "status", F.current_timestamp().alias("recorded_at")), ledger)
    return status


def retried(write: Callable[[], None], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> bool:
    """Runs an idempotent write until it succeeds, after 1, 2, 4 ... seconds again; whether it did."""
    for attempt in range(tries):
        try:
            write()
            return True
        except Exception as e:
            log.warning("write failed (try %d of %d): %s", attempt + 1, tries, e)
            if attempt < tries - 1:
                wait(2**attempt)
    return False


def replace_dates(new: DataFrame, old: DataFrame, date: str = "d") -> DataFrame:
    """``old`` without the dates that ``new`` has, and ``new``: a delimited history in which a date is written again."""
    return old.join(F.broadcast(new.select(date).distinct()), date, "left_anti").unionByName(new)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def sync_day(active: DataFrame, path: str, partition: str = "report_date") -> None:
    """The day's rows become exactly ``active``: stale keys go with the partition they were in."""
    replace_partitions(active, path, partition)


def protect_final(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't stored as final."""
    return new.join(old.where("is_final").select(*keys).distinct(), keys, "left_anti")


def rolling_cache(old: DataFrame, new: DataFrame, date: str = "d", keep: int = 500) -> DataFrame:
    """The last ``keep`` dates of both, new rows first."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_last(both, [date], ["_new"]).drop("_new").orderBy(F.col(date).desc()).limit(keep)


#: Declared schemas of the stored tables.
SCHEMAS = {
    "metric_daily": "report_date date, metric string, scope string, session string, value double, chg_1d double, chg_5d double, chg_21d double, chg_63d double, zscore double, percentile double, severity int, dist_to_thr double, days_in_risk int, sample_len int, effective_obs_count int, source_date date, source_name string, is_filled boolean, is_final boolean, lag_days int, calc_version string, created_at timestamp",
    "anomaly_events": "report_date date, metric string, scope string, window_scope string, layer string, resonance_key string, value double, change double, zscore double, percentile double, direction string, severity int, confidence double, source_date date, lag_days int, explanation string, created_at timestamp",
    "environment_daily": "report_date date, scores map<string,double>, coverage map<string,double>, composite double, state string",
    "liquidity_daily": "report_date date, composite double, coverage double, state string, pillars map<string,struct<score:double,coverage:double>>, details string",
    "sentinel_runs": "report_date date, fingerprint string, created_at timestamp",
    "market_history": "report_date date, macro_score int, micro_score int, regime string, skeleton string, full_metrics map<string,double>, source_date date, as_of_time timestamp, ingested_at timestamp",
    "spot_daily": "report_date date, ticker string, session string, price double, price_source string, previous_close double, poc double, ivr_pct double, oi_pcr double, gamma_flip double, call_wall double, put_wall double, is_final boolean, ingested_at timestamp",
    "option_gamma_buckets": "report_date date, ticker string, bucket string, spot_reference double, net_gamma_m double, primary_flip double, zero_points array<double>, expirations array<string>, contract_count int, expiration_count int, sign_model string, source_date date, as_of_time timestamp, ingested_at timestamp",
    "intraday_log": "report_date date, ts timestamp, price double, vwap double, trin double, ratio double, ctick double, alert string",
    "data_quality": "report_date date, job string, status string, missing array<string>, note string, created_at timestamp",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The stored tables, partitioned by date where they have one; existing ones stay as they are."""
    for name, schema in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet PARTITIONED BY (report_date)")


def add_columns(spark: SparkSession, table: str, schema: str) -> None:
    """Additive evolution: columns that the table lacks are added, others are left alone."""
    held = set(spark.table(table).columns)
    missing = [c.strip() for c in schema.split(",") if c.split()[0] not in held]
    if missing:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(missing)})")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for a sound table."""
    return df.groupBy(*keys).count().where("count > 1")
