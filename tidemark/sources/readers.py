"""Readers of the engine's inputs: delimited text and JSON documents, with declared schemas."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import keep_last, number


def history(df: DataFrame, first: str, last: str, date: str = "d", ticker: str | None = None) -> DataFrame:
    """Bounded scan; both predicates reach the files."""
    rows = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.where(F.col("ticker") == ticker) if ticker else rows


def latest(df: DataFrame, keys: list[str], date: str = "d") -> DataFrame:
    """The newest row of each key, by a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), date).alias("r")).select(*keys, "r.*")


def with_fallback(primary: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``primary``, and of ``legacy`` where a key isn't in it."""
    return primary.unionByName(legacy.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def dix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(d, dix_pct, gex_billions) of a file with date, price, dix and gex."""
    rows = spark.read.csv(path, header=True, schema="date string, price string, dix string, gex string")
    return rows.select(F.expr("try_to_date(date)").alias("d"), (number(F.col("dix")) * 100).alias("dix_pct"), (number(F.col("gex")) / 1e9).alias("gex_billions")).where("d is not null")


SHORT_VOLUME = "Date string, Symbol string, ShortVolume string, ShortExemptVolume string, TotalVolume string, Market string"


def short_volume(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, d, dpsv_pct) of pipe-delimited daily files; the trailing count line drops out."""
    return _short_shares(spark.read.csv(path, header=True, sep="|", schema=SHORT_VOLUME), symbols)


def newest_short_volume(spark: SparkSession, folder: str, today: str, symbols: list[str] | None = None, back: int = 5, prefix: str = "CNMSshvol") -> DataFrame:
    """``short_volume`` of the newest daily file among today's and those of the days before; empty if none is there."""
    names = [f"{prefix}{date.fromisoformat(today) - timedelta(days=i):%Y%m%d}.txt" for i in range(back)]
    rows = spark.read.csv(folder, header=True, sep="|", schema=SHORT_VOLUME, pathGlobFilter=f"{prefix}*.txt", recursiveFileLookup=True)
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    held = rows.withColumn("file", file).where(F.col("file").isin(names))
    newest = held.agg(F.max("file").alias("file"))
    return _short_shares(held.join(F.broadcast(newest), "file"), symbols)


def _short_shares(rows: DataFrame, symbols: list[str] | None) -> DataFrame:
    rows = rows.where(F.col("Symbol").isNotNull())
    if symbols:
        rows = rows.where(F.col("Symbol").isin(symbols))
    share = F.try_divide(number(F.col("ShortVolume")), number(F.col("TotalVolume"))) * 100
    return rows.select(F.col("Symbol").alias("symbol"), F.expr("try_to_date(Date, 'yyyyMMdd')").alias("d"), share.alias("dpsv_pct")).where("d is not null")


def day_rows(stored: DataFrame, day: str, session: str | None = None, without_scope: str | None = None) -> DataFrame:
    """A day's rows of a table partitioned by report_date, of one session, without a scope; only the day's partition is read."""
    rows = stored.where(F.col("report_date") == F.lit(day).cast("date"))
    rows = rows.where(F.col("session") == session) if session else rows
    return rows.where(F.col("scope") != without_scope) if without_scope else rows


def observations_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    """(column, d, value, source_date) of documents {offset, observations: [{date, value}]}; a dot is missing.

    The last of a date wins: that of the page with the largest offset, then of the last file by
    name, then the last within its document.
    """
    docs = spark.read.schema("offset long, observations array<struct<date:string,value:string>>").json(path, multiLine=True)
    paged = docs.select(F.coalesce("offset", F.lit(0)).alias("page"), F.col("_metadata.file_path").alias("file"), F.posexplode("observations").alias("at", "o"))
    rows = paged.select("page", "file", "at", F.expr("try_to_date(o.date)").alias("d"), number(F.col("o.value")).alias("value")).where("d is not null")
    kept = keep_last(rows, ["d"], ["page", "file", "at"]).where("value is not null")
    return kept.select(F.lit(series).alias("column"), "d", "value", F.col("d").alias("source_date"))


def treasury_json(spark: SparkSession, path: str) -> DataFrame:
    """(d, tga_b) of paged cash balances: the close, else the open, in millions to billions."""
    docs = spark.read.schema("data array<struct<record_date:string,close_today_bal:string,open_today_bal:string>>").json(path, multiLine=True)
    rows = docs.select(F.explode("data").alias("o"))
    value = F.coalesce(number(F.col("o.close_today_bal")), number(F.col("o.open_today_bal"))) / 1000
    return rows.select(F.expr("try_to_date(o.record_date)").alias("d"), value.alias("tga_b")).where("d is not null and tga_b is not null")


def rates_json(spark: SparkSession, path: str) -> DataFrame:
    """(d, rate, p75, p99, volume_b) of documents {refRates: [...]}."""
    fields = "effectiveDate:string,percentRate:double,percentPercentile75:double,percentPercentile99:double,volumeInBillions:double"
    docs = spark.read.schema(f"refRates array<struct<{fields}>>").json(path, multiLine=True)
    return docs.select(F.explode("refRates").alias("r")).select(F.expr("try_to_date(r.effectiveDate)").alias("d"), F.col("r.percentRate").alias("rate"), F.col("r.percentPercentile75").alias("p75"), F.col("r.percentPercentile99").alias("p99"), F.col("r.volumeInBillions").alias("volume_b"))


def wide_to_long(df: DataFrame, keys: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def net_positions(df: DataFrame, groups: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(group, net) of the latest report: long less short contracts of a group's markets.

    A group (name, words, excluded) has the markets that hold all its words and none of the
    excluded, in any case; the first such group in the list takes a market.
    """
    name = F.upper("market")

    def fits(words: list[str], excluded: list[str]) -> Column:
        held = F.lit(True)
        for word in words:
            held = held & name.contains(word.upper())
        for word in excluded:
            held = held & ~name.contains(word.upper())
        return held

    label = F.coalesce(*(F.when(fits(words, excluded), F.lit(group)) for group, words, excluded in groups))
    newest = df.agg(F.max("d").alias("d"))
    return df.join(F.broadcast(newest), "d").withColumn("group", label).where("group is not null").groupBy("group").agg(F.sum(F.col("long") - F.col("short")).alias("net"))
