"""The intraday scan as one stream: price, VWAP of the day, mean tick and volume ratio of every step, and what they set off.

Quotes are (ts, market, name, value, volume): trades of a market under the name ``price``, and the
latest readings of its indices under ``tick``, ``trin``, ``up`` and ``down``.  A value that is null,
NaN or zero is no reading.  The same plan runs over a table, without a watermark then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import probes

QUOTES = "ts timestamp, market string, name string, value double, volume long"
#: How far back a reading still counts, and how often a market is scanned.
REACH, STEP = "15 minutes", "15 minutes"
#: Width of the bars whose closes VWAP weights.
BAR = "5 minutes"


def _last(value: Column, at: Column, keep: Column) -> Column:
    """The kept value with the latest ``at``, of equal ones the largest."""
    return F.max_by(value, F.when(keep, F.struct(at, value)))


def session_prices(quotes: DataFrame, step: str = STEP, reach: str = REACH) -> DataFrame:
    """(at, market, price, vwap): at the last instant of each step the last close within ``reach`` and the day's VWAP so far.

    Trades are summed to bars of five minutes first, so only those are dealt to the later steps of
    their day (96 quarters of an hour at most), however many trades there are; VWAP weights their
    closes.  Days are those of the session's time zone.  ``step`` is a whole number of bars; of steps
    much shorter than the default there are too many copies of a row for Spark's generated code.
    """
    c = F.col
    usable = (c("value") != 0) & ~F.isnan("value")
    trades = quotes.where(c("name") == "price")
    bars = trades.groupBy(F.window("ts", BAR).alias("w"), "market").agg(_last(c("value"), c("ts"), usable).alias("close"), F.sum(F.when(usable, c("volume"))).alias("v"))
    dealt = bars.withColumn("at", F.window("w", "1 day", step)).where(F.to_date("w.start") == F.to_date(c("at.end") - F.expr("interval 1 microsecond")))
    recent = c("close").isNotNull() & (c("w.start") >= c("at.end") - F.expr(f"interval {reach}"))
    price = _last(c("close"), c("w.start"), recent)
    vwap = F.try_divide(F.sum(c("close") * c("v")), F.sum("v"))
    return dealt.groupBy("at", "market").agg(price.alias("price"), vwap.alias("vwap")).select(F.window_time("at").alias("at"), "market", "price", "vwap")


def index_readings(quotes: DataFrame, step: str = STEP, reach: str = REACH) -> DataFrame:
    """(at, market, ctick, trin, up, down), by step: the mean of the minutes' last ticks within ``reach``, and the last of the others."""
    c = F.col
    names = ["tick", "trin", "up", "down"]
    usable = (c("value") != 0) & ~F.isnan("value")
    minutes = quotes.where(c("name").isin(names)).groupBy(F.window("ts", "1 minute").alias("w"), "market").agg(*(_last(c("value"), c("ts"), usable & (c("name") == n)).alias(n) for n in names))
    latest = [_last(c(n), c("w.start"), c(n).isNotNull()).alias(n) for n in names[1:]]
    return minutes.withColumn("at", F.window("w", reach, step)).groupBy("at", "market").agg(F.avg("tick").alias("ctick"), *latest).select(F.window_time("at").alias("at"), "market", "ctick", *names[1:])


def scan(quotes: DataFrame, context: DataFrame, late: str = "1 hour", step: str = STEP, reach: str = REACH, flip_alerts: bool = True) -> DataFrame:
    """(market, ts, price, prev_close, expected_move, trin, ratio, ctick, flip, vwap, alert): a row a market and step that has a price.

    ``context`` (market, d, prev_close, expected_move, flip) is a table: a day's option view, with a
    row a market and day.  Without one, or without readings, the values that set nothing off count.

    As a stream in append mode: two aggregates one upon the other on either side, joined by market and
    step.  A step comes out once, when the watermark has passed it on both sides; quotes that come
    more than ``late`` after newer ones are dropped.  State is the open steps of each market.  Only
    quotes move the watermark, trades and readings each their own: a quiet side sends rows with a
    null value.
    """
    c = F.col
    quotes = quotes.withWatermark("ts", late) if quotes.isStreaming else quotes
    prices, readings = session_prices(quotes, step, reach).alias("p"), index_readings(quotes, step, reach).alias("r")
    both = prices.join(readings, [c("p.market") == c("r.market"), c("p.at") == c("r.at")], "left").where("price is not null")
    up, down = F.coalesce("up", F.lit(0.0)), F.coalesce("down", F.lit(0.0))
    rows = both.select(
        c("p.market").alias("market"), (c("p.at") + F.expr("interval 1 microsecond")).alias("ts"), "price", F.coalesce("vwap", "price").alias("vwap"), F.coalesce("ctick", F.lit(0.0)).alias("ctick"), F.coalesce("trin", F.lit(0.0)).alias("trin"),
        probes.volume_ratio(up, down).alias("ratio"),
    )
    rows = rows.withColumn("d", F.to_date(c("ts") - F.expr("interval 1 microsecond"))).join(context.select("market", "d", "prev_close", "expected_move", "flip"), ["market", "d"], "left")
    view = {"prev_close": 0.0, "expected_move": 0.01, "flip": 0.0}
    rows = rows.select("market", "ts", "price", *(F.coalesce(c(n), F.lit(v)).alias(n) for n, v in view.items()), "trin", "ratio", "ctick", "vwap")
    return probes.intraday_alert(rows, flip_alerts)


def emitted(df: DataFrame, folder: str) -> DataFrame:
    """What a stream in append mode gives for the data that is there, written under ``folder``; run again, it goes on where it was."""
    spark: SparkSession = df.sparkSession
    df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
