"""The data behind the reports: one text or row set a day, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anomaly import fixed


def environment_lines(scores: DataFrame) -> DataFrame:
    """(d, summary): each index with its score and coverage, in the order of their names."""
    line = F.concat(F.col("index"), F.lit(" "), F.coalesce(F.format_number("score", 1), F.lit("n/a")), F.lit(" ("), F.format_number(F.col("coverage") * 100, 0), F.lit("%)"))
    return scores.groupBy("d").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("summary"))


def alert_bodies(alerts: DataFrame) -> DataFrame:
    """(d, subject, body) of a day's alerts, most severe first."""
    line = F.concat(F.lit("["), F.col("severity").cast("string"), F.lit("] "), F.concat_ws(" ", "metric", "scope", "window_scope"))
    key = F.struct((-F.col("severity")).alias("s"), line.alias("line"))
    days = alerts.groupBy("d").agg(F.count("*").alias("n"), F.max("severity").alias("worst"), F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]).alias("lines"))
    return days.select("d", F.format_string("%d alerts, severity %d", "n", "worst").alias("subject"), F.array_join("lines", "\n").alias("body"))


def event_matrix(events: DataFrame, days: DataFrame) -> DataFrame:
    """(d, events, text) of each of ``days``: its events, a line each, by severity and then confidence, both falling.

    A line tells the severity by a mark, layer, window, scope (none for MACRO), explanation,
    confidence in whole percent and the lag if there is one; a day without events says so.
    """
    mark = F.when(F.col("severity") >= 3, "🔴").when(F.col("severity") == 2, "🟠").otherwise("🟡")
    scope = F.when(F.col("scope").isNull() | (F.col("scope") == "MACRO"), "").otherwise(F.concat(F.lit("["), "scope", F.lit("] ")))
    percent = F.floor(F.col("confidence") * 100).cast("string")
    late = F.when(F.col("lag_days") > 0, F.concat(F.lit(", "), F.col("lag_days").cast("string"), F.lit(" sessions late"))).otherwise("")
    line = F.concat(mark, F.lit(" ["), "layer", F.lit("|"), "window_scope", F.lit("] "), scope, "explanation", F.lit(" (severity "), F.col("severity").cast("string"), F.lit("/3, confidence "), percent, F.lit("%"), late, F.lit(")"))
    place = F.struct(-F.col("severity"), -F.col("confidence"), "layer", "scope", "metric", "window_scope", "resonance_key", line.alias("line"))
    lines = events.groupBy("d").agg(F.count("*").alias("events"), F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["line"]), "\n").alias("text"))
    return days.select("d").distinct().join(lines, "d", "left").select("d", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("text", F.lit("no notable anomaly")).alias("text"))


def environment_panels(scores: DataFrame, composite: DataFrame, indices: list[str]) -> DataFrame:
    """One row a day: each index's score and the composite, null where there is none."""
    wide = scores.groupBy("d").pivot("index", indices).agg(F.first("score"))
    return wide.join(composite.select("d", "composite"), "d", "left").select("d", *indices, "composite")


def score_matrix(snapshots: DataFrame) -> DataFrame:
    """(d, metric, scopes, worst, mean_pct): per metric and day how many series, the worst severity, the mean percentile."""
    return snapshots.groupBy("d", "metric").agg(F.count("*").alias("scopes"), F.max("severity").alias("worst"), F.round(F.avg("pct"), 4).alias("mean_pct"))


def trend(waterline: DataFrame, last: int = 126) -> DataFrame:
    """The last days of the composite, oldest first, with the change over 5 rows."""
    w = Window.orderBy("d")  # one row a day
    rows = waterline.select("d", "composite", "state", (F.col("composite") - F.lag("composite", 5).over(w)).alias("change_5"))
    return rows.withColumn("_back", F.row_number().over(Window.orderBy(F.col("d").desc()))).where(F.col("_back") <= last).drop("_back")


def appendix_rows(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """(d, section, name, text): the raw values and events behind a day's report."""
    values = snapshots.select("d", F.lit("metrics").alias("section"), F.concat_ws("/", "scope", "metric").alias("name"), F.format_number("value", 4).alias("text"))
    found = events.select("d", F.lit("events").alias("section"), F.concat_ws("/", "scope", "metric", "window_scope", "resonance_key").alias("name"), F.concat_ws(" ", "layer", F.col("severity").cast("string")).alias("text"))
    return values.unionByName(found)


def ticker_details(rows: DataFrame) -> DataFrame:
    """(ticker, d, text) of (ticker, d, reference, source, price, prev_close, poc, dpsv, ivr, flip, charm): what is known of a ticker, in one line.

    Null and 0 count as unknown.  The reference price before the open falls back on the price, and
    its source on a name of its own.
    """
    known = lambda x: x.isNotNull() & (x != 0)
    money = lambda x: F.concat(F.lit("$"), fixed(x, 2))
    c = F.col
    reference = F.coalesce("reference", "price")
    parts = [
        F.when(known(reference), F.concat(F.lit("reference "), money(reference), F.lit(" ("), F.coalesce("source", F.lit("price")), F.lit(")"))),
        F.when(known(c("prev_close")), F.concat(F.lit("previous close "), money(c("prev_close")))), F.when(known(c("poc")), F.concat(F.lit("cost core "), money(c("poc")))),
        F.when(known(c("dpsv")), F.concat(F.lit("short volume "), c("dpsv").cast("string"), F.lit("%"))), F.when(known(c("ivr")), F.concat(F.lit("volatility rank "), c("ivr").cast("string"), F.lit("%"))),
        F.when(known(c("flip")), F.concat(F.lit("gamma flip "), money(c("flip")))), F.when(known(c("charm")), F.concat(F.lit("charm "), c("charm").cast("string"), F.lit("M"))),
    ]
    return rows.select("ticker", "d", F.concat(F.lit("["), "ticker", F.lit("]: "), F.array_join(F.array_compact(F.array(*parts)), " | ")).alias("text"))


def overview_rows(macro: DataFrame, micro: DataFrame, regimes: DataFrame, environment: DataFrame, liquidity: DataFrame) -> DataFrame:
    """One row a day of everything that the overview shows; absent parts are null."""
    out = macro
    for part in (micro, regimes, environment.select("d", "composite"), liquidity.select("d", F.col("composite").alias("waterline"), F.col("state").alias("liquidity_state"))):
        out = out.join(part, "d", "full")
    return out


def quadrant(pillars: DataFrame) -> DataFrame:
    """(d, water_stock, flow_pulse, cell): a day's point of the level and flow chart; null where a score is missing."""
    named = [F.max(F.when(F.col("pillar") == p, F.col("score"))).alias(p) for p in ("water_stock", "flow_pulse")]
    level, flow = (F.when(F.col(c) >= 50, high).when(F.col(c) < 50, low) for c, high, low in (("water_stock", "high", "low"), ("flow_pulse", "inflow", "outflow")))
    return pillars.groupBy("d").agg(*named).select("d", "water_stock", "flow_pulse", F.when(level.isNotNull() & flow.isNotNull(), F.concat_ws(" ", level, flow)).alias("cell"))


def degraded_days(days: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(d, notice): the days of ``days`` for which no metric has a value, so that silence isn't taken for calm."""
    seen = snapshots.where("value is not null").select("d").distinct()
    return days.select("d").distinct().join(seen, "d", "left_anti").select("d", F.lit("no usable metric: upstream data missing").alias("notice"))
