"""Metric snapshots, the three anomaly layers, and the alert gate.

Statistics of all series come from one window pass partitioned by series; rules are joined
as a broadcast table of fixed size, with each metric's rules nested in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..plans import specs


def _entry(rules: Column) -> Column:
    """The mildest rule, the first listed among equals."""
    least = F.array_min(F.transform(rules, lambda r: r["sev"]))
    return F.get(F.filter(rules, lambda r: r["sev"] == least), F.lit(0))


def snapshot(facts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row per series and day with its derived vector; metrics outside the registry are left out.

    ``facts`` has (scope, metric, d, value) and may have lag_days; null, NaN and infinite values
    count as absent.
    """
    registry = registry if registry is not None else specs.registry(facts.sparkSession)
    rows = facts if "lag_days" in facts.columns else facts.withColumn("lag_days", F.lit(0))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    w = Window.partitionBy("scope", "metric").orderBy("d")
    v = F.col("value")
    known = rows.join(F.broadcast(registry.select("metric")), "metric", "left_semi")
    moved = known.select("scope", "metric", "d", v.cast("double").alias("value"), "lag_days", series.count_so_far(w).alias("n"), *(series.change(v, w, k).alias(f"chg_{k}d") for k in (1, 5, 21, 63)))
    stats = series.rolling_stats(moved, ["scope", "metric"]).join(F.broadcast(registry), "metric")
    hits = F.filter("rules", lambda r: series.compare(r["op"], v, r["bound"]))
    danger = F.col("z") * F.col("bad_dir")
    z_sev = F.when((F.col("bad_dir") != 0) & (danger >= F.col("z3")), 3).when((F.col("bad_dir") != 0) & (danger >= F.col("z2")), 2).otherwise(0)
    stats = stats.withColumns({
        "abs_sev": F.coalesce(F.array_max(F.transform(hits, lambda r: r["sev"])), F.lit(0)), "z_sev": z_sev, "entry": _entry(F.col("rules")),
    })
    inside = series.compare(F.col("entry.op"), v, F.col("entry.bound"))
    gap = F.when(F.col("entry.op").startswith(">"), F.col("entry.bound") - v).otherwise(v - F.col("entry.bound"))
    return stats.withColumns({
        "severity": F.greatest("abs_sev", "z_sev"), "dist_to_thr": gap, "days_in_risk": F.when(F.col("entry").isNotNull(), series.run_length(inside, w)),
    }).drop("rules", "entry", "z2", "z3", "kind")


def fixed(value: Column, places: int) -> Column:
    """So many decimals of a number, the exact value rounded half to even, without separators."""
    return F.translate(F.format_number(value, places), ",", "")


def signed(value: Column, places: int) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), fixed(value, places))


def single_and_multiwindow(snapshots: DataFrame) -> DataFrame:
    """Events of layers 1 and 2: absolute bound, z-score, and confirmed worsening over windows."""
    lag, n, name = F.col("lag_days"), F.col("n"), F.col("metric")
    baseline = F.round(series.quality(n, lag), 3)
    absolute = F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), n / 252.0)) * F.pow(F.lit(0.85), F.greatest(F.lit(0), lag)), 3)
    bad = F.col("bad_dir")

    def event(when: Column, window: str, layer: str, severity: Column, confidence: Column, direction: Column, *explanation: Column | str) -> Column:
        text = F.concat(name, *(F.lit(x) if isinstance(x, str) else x for x in explanation))
        return F.when(when, F.struct(F.lit(window).alias("window_scope"), F.lit(layer).alias("layer"), severity.cast("int").alias("severity"), confidence.alias("confidence"), direction.alias("direction"), text.alias("explanation")))

    extreme = F.when(bad > 0, F.col("pct") >= 90).otherwise(F.col("pct") <= 10)
    worse = (bad != 0) & (F.col("chg_1d") * bad > 0) & (F.col("chg_5d") * bad > 0) & extreme
    found = F.array_compact(F.array(
        event(F.col("abs_sev") > 0, "1D", "single", F.col("abs_sev"), absolute, F.when(bad >= 0, "up").otherwise("down"), " beyond its bound: ", fixed(F.col("value"), 2)),
        event(F.col("z_sev") > 0, "252D", "single", F.col("z_sev"), baseline, F.when(F.col("z") > 0, "up").otherwise("down"), " off its 252-day baseline by ", signed(F.col("z"), 2), " deviations (percentile ", fixed(F.col("pct"), 0), ")"),
        event(worse, "1D+5D+21D", "multiwindow", F.lit(3), baseline, F.when(bad > 0, "up").otherwise("down"), " confirmed over windows: ", signed(F.col("chg_1d"), 2), " in a day, ", signed(F.col("chg_5d"), 2), " in five, percentile ", fixed(F.col("pct"), 0)),
    ))
    return snapshots.select("d", "scope", "metric", "value", "lag_days", F.explode(found).alias("e")).select("d", "scope", "metric", "value", "e.*", F.lit("").alias("resonance_key"), "lag_days")


def resonance(inputs: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """Layer 3 over long inputs (d, input, value): themes of which enough conditions hold on a day."""
    themes = themes if themes is not None else specs.themes(inputs.sparkSession)
    met = inputs.join(F.broadcast(themes), "input").where(series.compare(F.col("op"), F.col("value"), F.col("bound")))
    counted = met.groupBy("d", "theme").agg(F.count("*").cast("int").alias("hits"), F.first("min_hits").alias("need"), F.first("base_sev").alias("base"), F.array_join(F.array_sort(F.collect_set("input")), ", ").alias("reasons"))
    counted = counted.join(F.broadcast(themes.groupBy("theme").agg(F.count("*").alias("of"))), "theme")  # a handful of themes
    return counted.where("hits >= need").select(
        "d", F.lit("MACRO").alias("scope"), F.lit("RESONANCE").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("multi").alias("window_scope"), F.lit("resonance").alias("layer"),
        F.least(F.lit(3), F.col("base") + F.col("hits") - F.col("need")).alias("severity"),
        F.round(F.least(F.lit(1.0), 0.5 + 0.12 * F.col("hits")), 3).alias("confidence"), F.lit(None).cast("string").alias("direction"),
        F.concat("theme", F.lit(": "), F.col("hits").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit(" conditions ["), "reasons", F.lit("]")).alias("explanation"), F.col("theme").alias("resonance_key"), F.lit(0).alias("lag_days"),
    )


def gate(events: DataFrame, keyed: bool = False) -> DataFrame:
    """Events that raise an alert, one per (d, metric, scope, window, layer); ``keyed`` keeps themes apart.

    Of events with one key the severest counts, then the most confident, then the first by theme.

    Resonance and multi-window events always pass the confidence floor's gate, single ones
    when extreme, or when enough moderate ones meet on a day.
    """
    rule, confidence, severity = specs.GATE, F.col("confidence"), F.col("severity")
    single = F.col("layer") == "single"
    moderate = single & (severity >= rule["cluster_severity"]) & (confidence >= rule["cluster_confidence"])
    day = Window.partitionBy("d")  # one shuffle; a join with daily counts would compute the events twice
    eligible = events.where(confidence >= rule["floor"]).withColumn("moderate", moderate).withColumn("crowd", F.count_if(moderate).over(day))
    passed = eligible.where(
        F.col("layer").isin("resonance", "multiwindow")
        | (single & (severity >= rule["solo_severity"]) & (confidence >= rule["solo_confidence"]))
        | (F.col("moderate") & (F.col("crowd") >= rule["cluster_count"]))
    )
    keys = ["d", "metric", "scope", "window_scope", "layer", *(["resonance_key"] if keyed else [])]
    return passed.groupBy(*keys).agg(F.min_by(F.struct("severity", "confidence", *([] if keyed else ["resonance_key"])), F.struct(-severity, -confidence, "resonance_key")).alias("e")).select(*keys, "e.*")


def fingerprints(alerts: DataFrame) -> DataFrame:
    """(d, alerts, fingerprint): 16 hex digits that name a day's set of alerts."""
    name = F.concat_ws(":", "metric", "scope", F.col("severity").cast("string"))
    days = alerts.groupBy("d").agg(F.count("*").alias("alerts"), F.array_sort(F.collect_list(name)).alias("names"))
    return days.select("d", "alerts", F.substring(F.md5(F.concat(F.col("d").cast("string"), F.lit("|"), F.array_join("names", "|"))), 1, 16).alias("fingerprint"))


def cluster_names(events: DataFrame) -> DataFrame:
    """(d, metrics): the distinct metrics of a day's moderate single events, where they are enough for a cluster."""
    rule = specs.GATE
    moderate = events.where((F.col("layer") == "single") & (F.col("severity") >= rule["cluster_severity"]) & (F.col("confidence") >= rule["cluster_confidence"]))
    days = moderate.groupBy("d").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"))
    return days.where(F.col("n") >= rule["cluster_count"])


def ordered(events: DataFrame) -> DataFrame:
    """``events`` with place: a day's order by severity, then confidence, both descending; the rest of the key settles ties."""
    day = Window.partitionBy("d").orderBy(F.col("severity").desc(), F.col("confidence").desc(), "layer", "scope", "metric", "window_scope", "resonance_key")
    return events.withColumn("place", F.row_number().over(day))
