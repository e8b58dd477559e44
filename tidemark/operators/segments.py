"""Running values of series too long for one task.

A window over a whole series holds it in one task.  Here a series is cut by time into segments of a
bounded number of rows; each is scanned alone, led by one row that carries what the segments before
it add up to.  Those rows are made from one total a segment, so only they are ever ordered by series.
All functions give what the plain window does, and keep ``_segment`` so that they can follow each
other over one cut; ``joined`` ends it.

``order`` names columns that order a series totally; rows equal in all of them may come in any order.
A missing time comes first.  Null keys are a series of their own, empty tables give empty tables.
Each scan reads its rows twice, for totals and for results, and in the first pass only the columns
that the totals need; what is costly to compute should be written first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a segment, as long as no single unit of time has more.
ROWS = 1 << 20


def cut(rows: DataFrame, keys: list[str], order: list[str], most: int = ROWS, unit: str = "hour") -> DataFrame:
    """``rows`` with ``_segment``, rising with the first of ``order``, a date or timestamp.

    Units of time are counted and put together: a segment has fewer than ``most`` rows and one
    unit more.  The table of units is a row a series and unit; Spark broadcasts it while it is small.
    """
    at = F.coalesce(F.date_trunc(unit, F.col(order[0]).cast("timestamp")), F.lit("0001-01-01").cast("timestamp"))
    rows = rows.withColumn("_unit", at)
    counts = rows.groupBy(*keys, "_unit").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = counts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_unit").alias("_of_unit"), F.floor(before / most).alias("_segment"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(units, [F.col("_unit") == F.col("_of_unit"), *same]).drop("_unit", "_of_unit", *(f"_of_{k}" for k in keys))


def joined(rows: DataFrame) -> DataFrame:
    return rows.drop("_segment")


def _led(rows: DataFrame, keys: list[str], totals: list[Column], carried: Callable[[WindowSpec], Column]) -> DataFrame:
    """``rows`` (with ``_v``) and before each segment a row, ``_row`` 0, whose ``_v`` is carried from the totals before it."""
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*keys, "_segment").agg(*totals).select(*keys, "_segment", carried(before).alias("_v"), F.lit(0).alias("_row"))
    return rows.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)


def _segment(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_segment").orderBy("_row", *order)


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to each row, null before the first value; exact for whole numbers and decimals."""
    led = _led(rows.withColumn("_v", value), keys, [F.sum("_v").alias("_t")], lambda before: F.sum("_t").over(before))
    return led.withColumn(name, F.sum("_v").over(_upto(_segment(keys, order)))).where("_row = 1").drop("_row", "_v")


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last ``value`` that isn't null at or before each row."""
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    led = _led(rows.withColumn("_v", value), keys, [last.alias("_t")], lambda before: F.last("_t", ignorenulls=True).over(before))
    return led.withColumn(name, F.last("_v", ignorenulls=True).over(_upto(_segment(keys, order)))).where("_row = 1").drop("_row", "_v")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The ``value`` of the row before, null or not; null for the first."""
    last = F.max_by(F.struct("_v"), F.struct(*order)).alias("_t")
    led = _led(rows.withColumn("_v", value), keys, [last], lambda before: F.last("_t").over(before)["_v"])
    return led.withColumn(name, F.lag("_v").over(_segment(keys, order))).where("_row = 1").drop("_row", "_v")


def run_length(rows: DataFrame, keys: list[str], order: list[str], hit: Column, name: str) -> DataFrame:
    """Rows up to the current one that hit without a break; a null doesn't hit."""
    rows = rows.withColumns({"_v": F.coalesce(hit, F.lit(False)).cast("long"), "_row": F.lit(1)})
    hits = rows.withColumn("_h", F.sum("_v").over(_upto(_segment(keys, order))))
    # Hits in a row are all hits less those at the last miss; hits never fall, so the most at any miss are those at the last.
    totals = [F.sum("_v").alias("_t"), F.max(F.when(F.col("_v") == 0, F.col("_h"))).alias("_m")]
    ends = hits.groupBy(*keys, "_segment").agg(*totals)
    series = Window.partitionBy(*keys).orderBy("_segment")
    so_far = F.coalesce(F.sum("_t").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumns({"_s": so_far, "_at": so_far + F.col("_m")})
    heads = ends.select(*keys, "_segment", (F.col("_s") - F.coalesce(F.max("_at").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_v"), F.lit(0).alias("_row"))
    both, w = rows.unionByName(heads, allowMissingColumns=True), _upto(_segment(keys, order))
    both = both.withColumn("_h", F.sum("_v").over(w))
    missed = F.max(F.when((F.col("_row") == 1) & (F.col("_v") == 0), F.col("_h"))).over(w)
    return both.withColumn(name, F.col("_h") - F.coalesce(missed, F.lit(0))).where("_row = 1").drop("_row", "_v", "_h")


def asof(spine: DataFrame, observations: DataFrame, keys: list[str], at: str = "ts", value: str = "value", most: int = ROWS, unit: str = "hour") -> DataFrame:
    """Each row of ``spine`` with value and source_date, those of the last observation with a value at or before it.

    Both are one series by key; of observations at one instant the largest value counts.
    """
    seen = observations.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias(value))
    seen = seen.select(*keys, at, F.struct(F.col(value).alias("value"), F.col(at).alias("source_date")).alias("_o"), F.lit(0).alias("_side"))
    both = spine.drop("value", "source_date").withColumn("_side", F.lit(1)).unionByName(seen, allowMissingColumns=True)
    found = fill_forward(cut(both, keys, [at], most, unit), keys, [at, "_side"], F.col("_o"), "_found")
    return joined(found.where("_side = 1")).select(*(F.col(c) for c in spine.columns if c not in ("value", "source_date")), "_found.value", "_found.source_date")


def obv(bars: DataFrame, keys: list[str], order: list[str], most: int = ROWS, unit: str = "hour") -> DataFrame:
    """``bars`` with obv: volume so far, added when the close rose on the row before and taken off when it fell.

    One scan: a segment's flow within is a total, the step over its edge comes from the closes on
    either side, and the row that leads it carries both the flow so far and the last close.
    """
    c = F.col

    def step(before: Column, close: Column, volume: Column) -> Column:
        return F.coalesce(F.signum(close - before).cast("long") * volume, F.lit(0))

    rows = cut(bars, keys, order, most, unit).withColumn("_row", F.lit(1))
    w = _segment(keys, order)
    inner = rows.withColumn("_step", step(F.lag("close").over(w), c("close"), c("volume")))
    edge, at = F.struct("close", "volume"), F.struct(*order)
    totals = inner.groupBy(*keys, "_segment").agg(F.sum("_step").alias("_t"), F.min_by(edge, at).alias("_first"), F.max_by(edge, at).alias("_last"))
    series = Window.partitionBy(*keys).orderBy("_segment")
    before = F.lag("_last").over(series)["close"]
    totals = totals.withColumns({"_before": before, "_flow": c("_t") + step(before, c("_first.close"), c("_first.volume"))})
    so_far = F.coalesce(F.sum("_flow").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = totals.select(*keys, "_segment", c("_before").alias("close"), so_far.alias("_flow"), F.lit(0).alias("_row"))
    led = rows.unionByName(heads, allowMissingColumns=True)
    led = led.withColumn("_flow", F.coalesce("_flow", step(F.lag("close").over(w), c("close"), c("volume"))))
    return joined(led.withColumn("obv", F.sum("_flow").over(_upto(w))).where("_row = 1").drop("_row", "_flow"))
