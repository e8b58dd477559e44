"""Operators over daily bars (symbol, d, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BINS = 50


def _days() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("d")


def point_of_control(bars: DataFrame) -> DataFrame:
    """(symbol, poc, bin_volume): midpoint of the close-price bin with most volume.

    50 equal bins between lowest and highest close; a close belongs to the last bin whose lower
    edge, lo + i * step, it reaches.  Of equal volumes the bin that was met first wins.
    """
    span = bars.groupBy("symbol").agg(F.min("close").cast("double").alias("lo"), F.max("close").cast("double").alias("hi"))
    rows = bars.join(span, "symbol").withColumn("step", (F.col("hi") - F.col("lo")) / BINS)
    near = F.floor((F.col("close") - F.col("lo")) / F.col("step"))
    # The quotient may be one off the edges as they are computed.
    near = F.when(F.col("lo") + (near + 1) * F.col("step") <= F.col("close"), near + 1).when(F.col("lo") + near * F.col("step") > F.col("close"), near - 1).otherwise(near)
    placed = rows.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), near)).otherwise(0).cast("int"))
    bins = placed.groupBy("symbol", "bin", "lo", "step").agg(F.sum("volume").alias("bin_volume"), F.min("d").alias("met"))
    best = bins.groupBy("symbol", "lo", "step").agg(F.max_by(F.struct("bin", "bin_volume"), F.struct("bin_volume", -F.datediff("met", F.lit("1970-01-01")), -F.col("bin"))).alias("b"))
    return best.select("symbol", (F.col("lo") + (F.col("b.bin") + 0.5) * F.col("step")).alias("poc"), "b.bin_volume")


def obv(bars: DataFrame, span: int = 5) -> DataFrame:
    """(symbol, d, obv, status): on-balance volume, and its agreement with price over the last bars."""
    w, last = _days(), _days().rowsBetween(1 - span, 0)
    step = F.signum(F.col("close") - F.lag("close").over(w)).cast("long") * F.col("volume")
    rows = bars.withColumn("obv", F.sum(F.coalesce(step, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    price, flow = F.col("close") - F.first("close").over(last), F.col("obv") - F.first("obv").over(last)
    status = F.when(F.row_number().over(w) < 2, "insufficient").when((price > 0) & (flow < 0), "bearish divergence").when((price < 0) & (flow > 0), "bullish divergence").when(flow > 0, "up together").otherwise("down together")
    return rows.select("symbol", "d", "obv", status.alias("status"))


def vwap(bars: DataFrame, keys: list[str], tail: int = 6, order: str = "d") -> DataFrame:
    """Per key the volume-weighted close, over all bars and without the last ``tail``."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    old = F.col("_back") > tail
    value = F.col("close") * F.col("volume")
    return bars.withColumn("_back", back).groupBy(*keys).agg(
        F.try_divide(F.sum(value), F.sum("volume")).alias("vwap"), F.try_divide(F.sum(F.when(old, value)), F.sum(F.when(old, F.col("volume")))).alias("vwap_before"),
    )


def money_flow(bars: DataFrame, rows: int = 21) -> DataFrame:
    """(symbol, d, cmf): Chaikin money flow over the trailing rows; a bar without range uses 0.01."""
    last = _days().rowsBetween(1 - rows, 0)
    span = F.when(F.col("high") == F.col("low"), 0.01).otherwise(F.col("high") - F.col("low"))
    flow = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span * F.col("volume")
    return bars.withColumn("flow", flow).select("symbol", "d", F.try_divide(F.sum("flow").over(last), F.sum("volume").over(last)).alias("cmf"))


def realised_volatility(bars: DataFrame, rows: int = 20) -> DataFrame:
    """(symbol, d, hv): annualised deviation of the last log returns in percent; null before ``rows`` of them."""
    w = _days()
    returns = bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(w)))
    last = w.rowsBetween(1 - rows, 0)
    return returns.select("symbol", "d", F.when(F.count("r").over(last) >= rows, F.stddev_samp("r").over(last) * F.sqrt(F.lit(252.0)) * 100).alias("hv"))


def value_rank(df: DataFrame, key: str, value: str, order: str = "d") -> DataFrame:
    """(key, rank): the latest value's place between lowest and highest, in percent; 0 without range."""
    span = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max_by(value, order).alias("now"))
    return span.select(key, F.when(F.col("hi") > F.col("lo"), (F.col("now") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100).otherwise(0.0).alias("rank"))


def leverage_drag(base: DataFrame, geared: DataFrame, factor: float = 3.0) -> DataFrame:
    """(window, base_return, geared_return, theory_return, drag): compounded over the last 21, 63 and all rows, in percent.

    ``theory_return`` compounds ``factor`` times each day's base return, drag is what the geared
    return lacks of it; by common dates.  A window with fewer rows is left out.
    """
    return _drag(base.select("d", F.col("close").alias("b")).join(geared.select("d", F.col("close").alias("g")), "d"), [], factor)


def leverage_drags(bars: DataFrame, pairs: DataFrame, factor: float = 3.0) -> DataFrame:
    """(base, geared, window, ...): ``leverage_drag`` of each pair (base, geared) of symbols."""
    base = bars.select(F.col("symbol").alias("base"), "d", F.col("close").alias("b")).join(F.broadcast(pairs), "base")
    geared = bars.select(F.col("symbol").alias("geared"), "d", F.col("close").alias("g"))
    return _drag(base.join(geared, ["geared", "d"]), ["base", "geared"], factor)


def _drag(both: DataFrame, keys: list[str], factor: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("d")  # one pair of series
    returns = both.select(*keys, "d", (F.col("b") / F.lag("b").over(w) - 1).alias("rb"), (F.col("g") / F.lag("g").over(w) - 1).alias("rg")).where("rb is not null")
    ranked = returns.withColumns({"back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("d").desc())), "rows": F.count("*").over(Window.partitionBy(*keys))})
    windows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), F.lit(least).alias("least")) for n, k, least in (("21", 21, 21), ("63", 63, 63), ("all", 1 << 30, 1)))))
    inside = ranked.withColumn("w", windows).where((F.col("back") <= F.col("w.k")) & (F.col("rows") >= F.col("w.least")))
    parts = {"base_return": F.col("rb"), "geared_return": F.col("rg"), "theory_return": F.col("rb") * factor}
    grown = inside.groupBy(*keys, F.col("w.name").alias("window")).agg(*(((F.product(1 + r) - 1) * 100).alias(name) for name, r in parts.items()))
    return grown.withColumn("drag", F.col("geared_return") - F.col("theory_return"))


def returns(bars: DataFrame, steps: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    """(symbol, d, r_1, r_5, ...): percent change of close over so many rows."""
    w = _days()
    return bars.select("symbol", "d", *(((F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1) * 100).alias(f"r_{k}") for k in steps))


def relative_strength(bars: DataFrame, benchmark: str, steps: tuple[int, ...] = (5, 21, 63)) -> DataFrame:
    """(symbol, d, rs_5, ...): returns less the benchmark's on the same day."""
    all_ = returns(bars, steps)
    base = all_.where(F.col("symbol") == benchmark).select("d", *(F.col(f"r_{k}").alias(f"b_{k}") for k in steps))
    return all_.where(F.col("symbol") != benchmark).join(base, "d").select("symbol", "d", *((F.col(f"r_{k}") - F.col(f"b_{k}")).alias(f"rs_{k}") for k in steps))


def breadth(bars: DataFrame) -> DataFrame:
    """(d, advances, declines, up_volume, down_volume, above_20, trin) over all symbols of a day."""
    w = _days()
    rows = bars.select("d", "volume", (F.col("close") - F.lag("close").over(w)).alias("move"), (F.col("close") > F.avg("close").over(w.rowsBetween(-19, 0))).alias("above"))
    days = rows.groupBy("d").agg(
        F.count_if(F.col("move") > 0).alias("advances"), F.count_if(F.col("move") < 0).alias("declines"), F.coalesce(F.sum(F.when(F.col("move") > 0, F.col("volume"))), F.lit(0)).alias("up_volume"),
        F.coalesce(F.sum(F.when(F.col("move") < 0, F.col("volume"))), F.lit(0)).alias("down_volume"), F.round(F.count_if("above") / F.count("*") * 100, 4).alias("above_20"),
    )
    ratio = F.try_divide(F.col("advances") / F.nullif("declines", F.lit(0)), F.col("up_volume") / F.nullif("down_volume", F.lit(0)))
    return days.withColumn("trin", F.coalesce(ratio, F.lit(0.0)))


def breadth_thrust(days: DataFrame, share: str = "above_20") -> DataFrame:
    """(d, signal): 'thrust' from 10 or less within three days to 90 or more, 'washout' at 10 or less, else 'none'."""
    w = Window.orderBy("d")  # one row a day over all symbols
    recent = F.min(share).over(w.rowsBetween(-3, -1))
    return days.select("d", F.when((F.col(share) >= 90) & (recent <= 10), "thrust").when(F.col(share) <= 10, "washout").otherwise("none").alias("signal"))


def prior_low(bars: DataFrame, rows: int = 20) -> DataFrame:
    """(symbol, d, prior_low, broken): the lowest close of the rows before this one, and whether it gave way."""
    low = F.min("close").over(_days().rowsBetween(-rows, -1))
    return bars.select("symbol", "d", low.alias("prior_low"), (F.col("close") < low).alias("broken"))


def momentum(bars: DataFrame) -> DataFrame:
    """(symbol, d, close_to_close, open_to_close, gap) in percent."""
    before = F.lag("close").over(_days())
    full, inside = (F.try_divide(F.col("close"), before) - 1) * 100, (F.try_divide(F.col("close"), F.col("open")) - 1) * 100
    return bars.select("symbol", "d", full.alias("close_to_close"), inside.alias("open_to_close"), (full - inside).alias("gap"))


def group_spread(returns_: DataFrame, group: list[str], benchmark: str, value: str = "r_1") -> DataFrame:
    """(d, spread): mean return of a named group less the benchmark's; a missing return, the benchmark's too, counts as 0."""
    total = F.sum(F.when(F.col("symbol").isin(group), F.col(value)))
    other: Column = F.max(F.when(F.col("symbol") == benchmark, F.col(value)))
    return returns_.groupBy("d").agg((F.coalesce(total, F.lit(0.0)) / len(group) - F.coalesce(other, F.lit(0.0))).alias("spread"))


def weighted_flow(holdings: DataFrame) -> DataFrame:
    """(d, flow): summed change of shares times price in millions, from (symbol, d, shares, price)."""
    change = F.col("shares") - F.lag("shares").over(_days())
    return holdings.withColumn("f", change * F.col("price") / 1e6).groupBy("d").agg(F.sum("f").alias("flow"))


def market_snapshot(bars: DataFrame) -> DataFrame:
    """(symbol, d, change, close, sma_20, sma_50, sma_200, high_252, low_252, volume): what breadth counts of a day."""
    w = _days()
    means = {f"sma_{n}": F.when(F.row_number().over(w) >= n, F.avg("close").over(w.rowsBetween(1 - n, 0))) for n in (20, 50, 200)}
    year = w.rowsBetween(-251, 0)
    rows = bars.withColumns(means | {"change": F.col("close") - F.lag("close").over(w), "high_252": F.max("high").over(year), "low_252": F.min("low").over(year)})
    return rows.select("symbol", "d", "change", "close", *means, "high_252", "low_252", "volume")


def breadth_counts(snapshot: DataFrame) -> DataFrame:
    """(d, total, advances, declines, trin, pct_20ma, pct_50ma, pct_200ma, nh, nl, net_nh_nl) of each day.

    A rise or fall counts with its volume; a close within one percent of the year's extreme is a
    new high or low; a symbol without an average is above none, but counts in the total.
    """
    c = F.col
    moved = c("volume") > 0
    up, down = moved & (c("change") > 0), moved & (c("change") < 0)
    days = snapshot.groupBy("d").agg(
        F.count("*").alias("total"), F.count_if(up).alias("advances"), F.count_if(down).alias("declines"),
        F.coalesce(F.sum(F.when(up, c("volume"))), F.lit(0)).alias("up"), F.coalesce(F.sum(F.when(down, c("volume"))), F.lit(0)).alias("down"),
        *(F.count_if(c("close") > c(f"sma_{n}")).alias(f"above_{n}") for n in (20, 50, 200)),
        F.count_if(c("close") >= c("high_252") * 0.99).alias("nh"), F.count_if(c("close") <= c("low_252") * 1.01).alias("nl"),
    )
    trin = F.when((c("declines") > 0) & (c("down") > 0) & (c("up") > 0), (c("advances") / c("declines")) / (c("up") / c("down"))).otherwise(0.0)
    shares = [F.round(c(f"above_{n}") / c("total") * 100, 1).alias(f"pct_{n}ma") for n in (20, 50, 200)]
    return days.select("d", "total", "advances", "declines", F.round(trin, 2).alias("trin"), *shares, "nh", "nl", (c("nh") - c("nl")).alias("net_nh_nl"))


def heatmap(bars: DataFrame, steps: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    """(symbol, d, r_1, r_5, ...): the latest row's returns of each symbol with more than the longest step plus one rows."""
    w = _days()
    rows = returns(bars, steps).withColumns({"n": F.row_number().over(w), "back": F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("d").desc()))})
    return rows.where((F.col("back") == 1) & (F.col("n") > max(steps) + 1)).drop("n", "back")


def trailing_mean(ticks: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", minutes: int = 15) -> DataFrame:
    """``ticks`` with trailing_mean: over the rows of the key up to ``minutes`` before each, itself included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return ticks.withColumn("trailing_mean", F.avg(value).over(w))
