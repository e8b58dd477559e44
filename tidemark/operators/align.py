"""As-of alignment with provenance, calendars, and priority merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observed_weekdays(observations: DataFrame, date: str = "d") -> DataFrame:
    """(d, seq): weekdays from the first to the last observation, numbered from 1; none without observations."""
    span = observations.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("d")).where(F.weekday("d") < 5)
    return days.select("d", F.row_number().over(Window.orderBy("d")).alias("seq"))  # a calendar: some hundred rows a year


def weekday_lag(source: Column, reference: Column) -> Column:
    """Weekdays in [source, reference), 0 if reversed, null if either is null; closed form, no calendar."""

    def ordinal(day: Column) -> Column:
        """Weekdays since a Monday, counted before ``day``."""
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.when(source.isNotNull() & reference.isNotNull(), F.greatest(F.lit(0), ordinal(reference) - ordinal(source))).cast("int")


def asof(spine: DataFrame, observations: DataFrame, keys: list[str], date: str = "d", value: str = "value") -> DataFrame:
    """(keys, d, value, source_date): on each spine day the last observation at or before it, with its own date.

    One shuffle by key: spine days and observations are ordered together and the last seen
    observation is carried forward as a struct, so value and date never part.
    """
    days = spine.select(date).distinct()
    names = observations.select(*keys).distinct()
    rows = names.join(F.broadcast(days)).select(*keys, date, F.lit(None).cast("struct<value:double,source_date:date>").alias("o"), F.lit(1).alias("side"))
    seen = observations.where(F.col(value).isNotNull()).select(*keys, date, F.struct(F.col(value).cast("double").alias("value"), F.col(date).alias("source_date")).alias("o"), F.lit(0).alias("side"))
    w = Window.partitionBy(*keys).orderBy(date, "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.unionByName(seen).withColumn("o", F.last("o", ignorenulls=True).over(w))
    return carried.where("side = 1").select(*keys, date, "o.value", "o.source_date")


def effective_observations(aligned: DataFrame, keys: list[str], date: str = "d") -> DataFrame:
    """``aligned`` with the number of distinct native dates seen so far."""
    w = Window.partitionBy(*keys).orderBy(date)
    fresh = F.when(F.col("source_date").isNotNull() & ~F.col("source_date").eqNullSafe(F.lag("source_date").over(w)), 1).otherwise(0)
    return aligned.withColumn("fresh", fresh).withColumn("effective_obs", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def priority_merge(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join in which a value of ``first`` wins over ``second``; each value tells its table.

    Where both tables have ``<value>_source_date``, the winner's comes with its value.
    """
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    picked = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    for v in values:
        picked += [F.coalesce(F.col(f"a.{v}"), F.col(f"b.{v}")).alias(v), F.when(F.col(f"a.{v}").isNotNull(), "first").when(F.col(f"b.{v}").isNotNull(), "second").alias(f"{v}_from")]
        dated = f"{v}_source_date"
        if dated in first.columns and dated in second.columns:
            picked.append(F.when(F.col(f"a.{v}").isNotNull(), F.col(f"a.{dated}")).when(F.col(f"b.{v}").isNotNull(), F.col(f"b.{dated}")).alias(dated))
    return both.select(*picked)


def unified(pre: DataFrame, post: DataFrame, keys: list[str], suffix: str = "_post") -> DataFrame:
    """Full outer join on coalesced keys; columns of ``post`` that clash get the suffix."""
    renamed = post.select(*keys, *(F.col(c).alias(c + suffix if c in pre.columns else c) for c in post.columns if c not in keys))
    return pre.join(renamed, keys, "full")


def unless_final(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored as final."""
    return new.join(stored.where("is_final").select(*keys).distinct(), keys, "left_anti")


def already_sent(alerts: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    return alerts.join(sent.select(*keys).distinct(), keys, "left_semi")


def offset_value(series: DataFrame, calendar: DataFrame, keys: list[str], sessions: int) -> DataFrame:
    """For each row the last value at or before the day ``sessions`` before it on the calendar."""
    back = F.broadcast(calendar.select(F.col("seq").alias("_at"), F.col("d").alias("_before")))
    days = series.select(*keys, "d", "value").join(F.broadcast(calendar), "d").withColumn("_at", F.col("seq") - sessions).join(back, "_at", "left")
    marks = days.select(*keys, F.col("_before").alias("t"), F.lit(1).alias("side"), "d", "value", F.lit(None).cast("double").alias("seen"))
    seen = series.select(*keys, F.col("d").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("double").alias("value"), F.col("value").cast("double").alias("seen"))
    w = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    joined = marks.unionByName(seen).withColumn("base", F.last("seen", ignorenulls=True).over(w)).where("side = 1")
    return joined.select(*keys, "d", "value", F.when(F.col("t").isNotNull(), F.col("base")).alias("base"))


def at_or_before(observations: DataFrame, keys: list[str], day: str, business_days: int = 0, date: str = "d", value: str = "value") -> DataFrame:
    """(keys, value, source_date): each key's last non-null value at or before the day, or so many weekdays before it."""
    last = F.lit(day).cast("date")
    if business_days:
        # From a weekend the count starts on Monday; whole weeks, then single days over at most one weekend.
        weeks, rest = divmod(business_days, 5)
        last = F.date_sub(F.when(F.weekday(last) > 4, F.date_add(last, 7 - F.weekday(last))).otherwise(last), 7 * weeks)
        last = F.date_sub(last, rest + F.when(F.weekday(last) < rest, 2).otherwise(0))
    seen = observations.where((F.col(date) <= last) & F.col(value).isNotNull())
    return seen.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(date).alias("source_date")), date).alias("r")).select(*keys, "r.*")


def official_frame(aligned: DataFrame, columns: list[str], key: str = "column", date: str = "d") -> DataFrame:
    """One row a day from aligned (key, d, value, source_date): a column and its source date for each name.

    Differences of columns that are there follow: net liquidity and spreads to the administered
    rate, each with the oldest of its sources' dates that are known.
    """
    wide = aligned.groupBy(date).pivot(key, columns).agg(F.first("value").alias("value"), F.first("source_date").alias("source_date"))
    wide = wide.select(date, *(F.col(f"{c}_value").alias(c) for c in columns), *(F.col(f"{c}_source_date") for c in columns))

    def derived(name: str, value: Column, *of: str) -> dict[str, Column]:
        oldest = F.least(*(F.col(f"{c}_source_date") for c in of)) if len(of) > 1 else F.col(f"{of[0]}_source_date")
        return {name: value, f"{name}_source_date": oldest} if set(of) <= set(columns) else {}

    c, spreads = F.col, {}
    for rate in ("sofr", "tgcr", "effr"):
        spreads |= derived(f"{rate}_iorb_bps", (c(f"{rate}_rate") - c("iorb")) * 100, f"{rate}_rate", "iorb")
    spreads |= derived("sofr_75_iorb_bps", (c("sofr_p75") - c("iorb")) * 100, "sofr_p75", "iorb")
    spreads |= derived("sofr_dispersion_bps", (c("sofr_p99") - c("sofr_rate")) * 100, "sofr_p99", "sofr_rate")
    return wide.withColumns(derived("net_liq_b", c("fed_assets_b") - c("tga_b") - c("rrp_b"), "fed_assets_b", "tga_b", "rrp_b") | spreads)


def resampled(observations: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d, value): series of any frequency carried forward to the spine's days, the latest of them alone."""
    return asof(spine, observations, keys).groupBy(*keys).agg(F.max("d").alias("d"), F.max_by("value", "d").alias("value"))


def merged_prices(pre: DataFrame, post: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """``unified`` in which the later price wins: one ``price`` column, the one after the close if there is one."""
    both = unified(pre, post, keys)
    return both.withColumn(price, F.coalesce(F.col(f"{price}_post"), F.col(price))).drop(f"{price}_post")
