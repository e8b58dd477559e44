"""Liquidity waterline: components, pillars, composite, state, supports and drags.

All report days are scored in one pass: each component's series is a window partition, and
every value on a day uses rows up to that day alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..plans import specs
from .align import weekday_lag


def reserve_score(v: Column) -> Column:
    """Piecewise linear in trillions."""
    return (
        F.when(v >= 3.0, F.least(F.lit(100.0), 80 + (v - 3.0) * 40))
        .when(v >= 2.85, 55 + (v - 2.85) / 0.15 * 25)
        .when(v >= 2.65, 25 + (v - 2.65) / 0.20 * 30)
        .otherwise(F.greatest(F.lit(0.0), 25 - (2.65 - v) * 50))
    )


def _whole(value: Column, places: int) -> Column:
    """A value of so many decimals as a whole number, so that sums don't depend on their order."""
    return F.round(value * 10**places).cast("long")


def _ratio(over: str, under: str, places: int) -> Column:
    """A ratio of whole numbers rounded half up by whole division, so that ties don't depend on binary fractions."""
    scale = 10**places
    return F.expr(f"(2 * {scale} * ({over}) + ({under})) div (2 * ({under}))") / scale


def component_scores(facts: DataFrame, components: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, d, component, pillar, weight, score, quality, raw, observations, lag_days).

    ``facts`` has (keys, column, d, value, source_date), aligned to the report days.  Below the
    least number of distinct native dates a component has no score and quality 0.
    """
    spec = F.broadcast(components if components is not None else specs.components(facts.sparkSession))
    rows = facts.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double")).join(spec, "column")
    w = Window.partitionBy(*keys, "component").orderBy("d")
    v = F.col("value")
    steps = F.array(*(F.lag(v, k).over(w) for k in (5, 20, 21)))
    back = F.when(F.col("step") == 5, steps[0]).when(F.col("step") == 20, steps[1]).when(F.col("step") == 21, steps[2])
    moved = F.when(F.col("mode") == "change", v - back).when(F.col("mode") == "pct_change", F.try_divide(v, back) * 100 - 100).otherwise(v)
    rows = rows.withColumn("signal", moved)
    fresh = F.when(F.col("signal").isNotNull() & F.col("source_date").isNotNull() & ~F.col("source_date").eqNullSafe(F.lag(F.when(F.col("signal").isNotNull(), F.col("source_date"))).over(w)), 1).otherwise(0)
    rows = rows.withColumn("fresh", fresh)
    rows = rows.withColumns({
        "observations": F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)), "lag_days": weekday_lag(F.col("source_date"), F.col("d")), "n": series.count_so_far(w),
    })
    rows = series.rolling_stats(rows, [*keys, "component"], least=0, value="signal", inclusive=True).withColumnRenamed("pct", "rank")
    freshness = F.when(F.col("lag_days").isNull(), 0.75).otherwise(F.pow(F.lit(0.85), F.greatest(F.lit(0), F.col("lag_days") - F.col("tolerance"))))
    quality = F.least(F.lit(1.0), F.col("observations") / F.greatest(F.lit(1), F.col("baseline"))) * freshness
    score = F.when(F.col("mode") == "reserves_buffer", reserve_score(v)).when(F.col("direction") > 0, F.col("rank")).otherwise(100 - F.col("rank"))
    enough = (F.col("observations") >= F.col("min_obs")) & F.col("signal").isNotNull()
    return rows.select(
        *keys, "d", "component", "pillar", "weight", F.when(enough, F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1)).alias("score"),
        F.when(enough, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality)), 3)).otherwise(0.0).alias("quality"), v.alias("raw"), "observations", "lag_days",
    )


def pillar_scores(scored: DataFrame, components: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, d, pillar, score, coverage); a pillar below 0.35 coverage has no score."""
    components = components if components is not None else specs.components(scored.sparkSession)
    total = F.broadcast(components.groupBy("pillar").agg(F.sum(_whole(F.col("weight"), 2)).alias("total")))
    held = F.when(F.col("score").isNotNull() & (F.col("quality") > 0), _whole(F.col("weight"), 2) * _whole(F.col("quality"), 3))
    sums = scored.withColumn("w", held).groupBy(*keys, "d", "pillar").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.sum(_whole(F.col("score"), 1) * F.col("w")).alias("sum"))
    coverage = F.col("w") / (F.col("total") * 1000)
    score = F.when((F.col("w") > 0) & (coverage >= specs.MIN_PILLAR_COVERAGE), _ratio("sum", "w * 10", 1))
    return sums.join(total, "pillar").select(*keys, "d", "pillar", score.alias("score"), _ratio("w", "total * 1000", 3).alias("coverage"))


def waterline(pillars: DataFrame, latest: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, d, composite, coverage, state): the composite and its classification.

    ``latest`` has (keys, d, column, value) of the guards' columns as known on each day.
    """
    weights = specs.pillars(pillars.sparkSession)
    held = F.when(F.col("score").isNotNull(), _whole(F.col("pillar_weight"), 2) * _whole(F.col("coverage"), 3))
    named = {p: F.max(F.when(F.col("pillar") == p, F.col("score"))).alias(p) for p, _ in specs.PILLARS}
    sums = pillars.join(F.broadcast(weights), "pillar").withColumn("w", held).groupBy(*keys, "d").agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.sum(_whole(F.col("score"), 1) * F.col("w")).alias("sum"), *named.values()
    )
    coverage = F.col("w") / (round(100 * sum(weight for _, weight in specs.PILLARS)) * 1000)

    def guarded(bounds: list[tuple[str, float]]) -> Column:
        hit = F.lit(False)
        for column, bound in bounds:
            hit = hit | ((F.col("column") == column) & (F.col("value") >= bound))
        return F.coalesce(F.bool_or(hit), F.lit(False))

    guards = latest.groupBy(*keys, "d").agg(guarded(specs.FUNDING_GUARDS).alias("funding_guard"), guarded(specs.CREDIT_GUARDS).alias("credit_guard"))
    rows = sums.join(guards, [*keys, "d"], "left").withColumn("coverage", coverage)
    level = F.when(F.col("water_stock") >= 60, "high").when(F.col("water_stock") < 40, "low").otherwise("mid")
    flow = F.when(F.col("flow_pulse") >= 60, "positive").when(F.col("flow_pulse") < 40, "negative").otherwise("flat")
    # The grid of level and flow.
    grid = {
        "high positive": "easing expansion", "high flat": "high level, flat", "high negative": "high level, draining",
        "mid positive": "marginal refill", "mid flat": "balanced", "mid negative": "mild tightening",
        "low positive": "low-level repair", "low flat": "low-level watch", "low negative": "systemic tightening",
    }
    cell = F.create_map(*(F.lit(x) for pair in grid.items() for x in pair))[F.concat_ws(" ", level, flow)]
    crowded = F.when(F.col("market_distribution") < 45, F.concat(cell, F.lit(", concentrated"))).otherwise(cell)
    state = (
        F.when((F.col("coverage") < specs.MIN_COMPOSITE_COVERAGE) | F.col("water_stock").isNull() | F.col("flow_pulse").isNull(), "insufficient data")
        .when((F.col("funding_health") < 30) & F.col("funding_guard"), "funding stress")
        .when((F.col("credit_transmission") < 25) & F.col("credit_guard"), "credit contraction")
        .otherwise(crowded)
    )
    composite = F.when((F.col("coverage") >= specs.MIN_COMPOSITE_COVERAGE) & (F.col("w") > 0), _ratio("sum", "w * 10", 1))
    return rows.select(*keys, "d", composite.alias("composite"), _ratio("w", str(round(100 * sum(weight for _, weight in specs.PILLARS)) * 1000), 3).alias("coverage"), state.alias("state"))


def supports_and_drags(scored: DataFrame, keys: tuple[str, ...] = (), k: int = 3) -> DataFrame:
    """(keys, d, side, place, component, score): the k best that reach 60 and the k worst within 40, quality 0.35 or more."""
    eligible = scored.where((F.col("quality") >= 0.35) & F.col("score").isNotNull())
    day = Window.partitionBy(*keys, "d")
    sides = [("support", F.col("score").desc(), F.col("score") >= 60), ("drag", F.col("score").asc(), F.col("score") <= 40)]
    parts = [eligible.withColumn("place", F.row_number().over(day.orderBy(order, "component"))).where((F.col("place") <= k) & bound).select(*keys, "d", F.lit(side).alias("side"), "place", "component", "score") for side, order, bound in sides]
    return parts[0].unionByName(parts[1])


#: Columns shown beside the score, which don't count in it.
CONTEXT = ["rrp_b", "reserves_t", "tga_b", "dix_pct", "gex_billions"]


def context(latest: DataFrame, keys: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """(keys, d, one column for each name): values as known on each day, from (keys, d, column, value)."""
    names = columns or CONTEXT + [c for c, _ in specs.FUNDING_GUARDS + specs.CREDIT_GUARDS]
    return latest.groupBy(*keys, "d").agg(*(F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in names))


def warnings(pillars: DataFrame, context_: DataFrame, tga_change: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, d, warnings): structural notes of a day in a fixed order, from pillars, context and (keys, d, tga_5d)."""
    wide = pillars.groupBy(*keys, "d").agg(
        *(F.max(F.when(F.col("pillar") == p, F.col("score"))).alias(p) for p in ("market_distribution", "funding_health", "credit_transmission")), F.max(F.when(F.col("pillar") == "funding_health", F.col("coverage"))).alias("funding_coverage"),
    )
    rows = wide.join(context_, [*keys, "d"], "left").join(tga_change, [*keys, "d"], "left")

    def hit(bounds: list[tuple[str, float]]) -> Column:
        found = F.lit(False)
        for name, bound in bounds:
            found = found | F.coalesce(F.col(name) >= bound, F.lit(False))
        return found

    c = F.col
    # The bounds of the notes.
    notes = [
        (c("rrp_b") < 50, "reverse repo buffer nearly used up"), (c("reserves_t") < 2.85, "reserves in the sensitive range"), (c("tga_5d") >= 100, "treasury account up by 100 billion in five days"),
        (c("market_distribution") < 45, "concentrated distribution"), (c("funding_coverage") < 0.60, "funding coverage thin"),
        ((c("funding_health") < 30) & ~hit(specs.FUNDING_GUARDS), "funding weak but within absolute bounds"), ((c("credit_transmission") < 25) & ~hit(specs.CREDIT_GUARDS), "credit weak but within absolute bounds"),
    ]
    return rows.select(*keys, "d", F.array_join(F.array_compact(F.array(*(F.when(when, F.lit(text)) for when, text in notes))), "; ").alias("warnings"))


def summary_rows(waterline_: DataFrame, pillars: DataFrame, sides: DataFrame, warnings_: DataFrame) -> DataFrame:
    """(d, place, line): a day's report, line by line: state, composite, coverage, pillars, supports, drags, warnings."""
    number = lambda c: F.coalesce(F.format_number(c, 1), F.lit("insufficient data"))
    head = waterline_.select("d", F.posexplode(F.array(F.concat(F.lit("state: "), "state"), F.concat(F.lit("composite: "), number("composite")), F.concat(F.lit("coverage: "), F.format_number(F.col("coverage") * 100, 0), F.lit("%")))).alias("place", "line"))
    order = F.lit(None).cast("int")
    for i, (name, _) in enumerate(specs.PILLARS):
        order = F.when(F.col("pillar") == name, 3 + i).otherwise(order)
    body = pillars.select("d", order.alias("place"), F.concat("pillar", F.lit(": "), number("score")).alias("line"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "component", "score"))), lambda x: F.concat(x["component"], F.lit(" "), F.format_number(x["score"], 0))), "; ")
    tail = sides.groupBy("d", "side").agg(names.alias("names")).select("d", F.when(F.col("side") == "support", 9).otherwise(10).alias("place"), F.concat("side", F.lit("s: "), "names").alias("line"))
    notes = warnings_.where("warnings <> ''").select("d", F.lit(11).alias("place"), F.concat(F.lit("notes: "), "warnings").alias("line"))
    return head.unionByName(body).unionByName(tail).unionByName(notes)
