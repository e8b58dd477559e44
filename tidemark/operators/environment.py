"""Environment indices: quality-weighted danger percentiles, their composite, and the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..plans import specs


def index_scores(days: DataFrame, registry: DataFrame | None = None, indices: DataFrame | None = None) -> DataFrame:
    """(d, index, score, coverage) from metric-day rows.

    ``days`` has (d, metric, scope, percentile, effective_obs, sample_len, lag_days).  Each
    observation counts by its quality; a component has their weighted danger and mean quality;
    STOCK_ANY means every scope but MACRO and COMPOSITE.  A day's observations are added in order
    of scope and its components in order of metric: scores that lie on the edge of two roundings
    otherwise change with the partitioning.
    """
    spark = days.sparkSession
    registry = (registry if registry is not None else specs.registry(spark)).where("bad_dir <> 0").select("metric", "bad_dir")
    indices = indices if indices is not None else specs.environment(spark)
    spec = F.broadcast(indices.join(registry, "metric"))
    n = F.coalesce("effective_obs", "sample_len")
    quality = F.when(n >= specs.MIN_OBSERVATIONS, series.quality(n, F.greatest(F.lit(0), F.coalesce("lag_days", F.lit(0)))))
    in_scope = F.when(F.col("spec_scope") == "STOCK_ANY", ~F.col("scope").isin("MACRO", "COMPOSITE")).otherwise(F.col("scope") == F.col("spec_scope"))
    seen = days.join(spec, "metric").where(in_scope & F.col("percentile").isNotNull()).select(
        "d", "index", "metric", "weight", "scope", quality.alias("q"), F.when(F.col("bad_dir") > 0, F.col("percentile")).otherwise(100.0 - F.col("percentile")).alias("danger"),
    ).where("q > 0")
    q = series.ordered_sum(F.col("seen"), lambda x: x["q"])
    danger = series.ordered_sum(F.col("seen"), lambda x: x["danger"] * x["q"]) / q
    parts = seen.groupBy("d", "index", "metric", "weight").agg(F.array_sort(F.collect_list(F.struct("scope", "danger", "q"))).alias("seen"))
    parts = parts.select("d", "index", F.struct("metric", "weight", danger.alias("danger"), (q / F.size("seen")).alias("q")).alias("part"))
    total = indices.groupBy("index").agg(F.sum(F.col("weight").cast("decimal(18,9)")).cast("double").alias("total"))
    own = parts.groupBy("d", "index").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    w = series.ordered_sum(F.col("parts"), lambda x: x["weight"] * x["q"])
    score = series.ordered_sum(F.col("parts"), lambda x: x["danger"] * x["weight"] * x["q"]) / w
    return own.join(F.broadcast(total), "index").select("d", "index", series.rounded(score, 1).alias("score"), series.rounded(w / F.col("total"), 3).alias("coverage"))


def composite(scores: DataFrame) -> DataFrame:
    """(d, composite, core_coverage, overall_coverage): coverage-weighted mean over indices covered by half or more."""
    enough = (F.col("coverage") >= specs.MIN_INDEX_COVERAGE) & F.col("score").isNotNull()
    core = F.col("index").isin("idx_risk_pressure", "idx_liquidity_stress", "idx_breadth_decay")
    days = scores.groupBy("d").agg(
        F.array_sort(F.collect_list(F.when(enough, F.struct("index", "score", "coverage")))).alias("covered"),
        F.round(F.sum(F.when(core, F.col("coverage")).otherwise(0.0)) / 3, 4).alias("core_coverage"),
        F.round(F.sum("coverage") / 5, 4).alias("overall_coverage"),
    )
    mean = F.try_divide(series.ordered_sum(F.col("covered"), lambda x: x["score"] * x["coverage"]), series.ordered_sum(F.col("covered"), lambda x: x["coverage"]))
    return days.select("d", series.rounded(mean, 1).alias("composite"), "core_coverage", "overall_coverage")


def state(scores: DataFrame, resonance: DataFrame) -> DataFrame:
    """(d, state): the first rule that holds, insufficient coverage first.

    ``resonance`` has (d, resonance_key) of the themes that fired.
    """
    names = {"rp": "idx_risk_pressure", "ls": "idx_liquidity_stress", "bd": "idx_breadth_decay", "of": "idx_options_fragility"}
    wide = scores.groupBy("d").agg(
        *(F.max(F.when(F.col("index") == v, F.col("score"))).alias(k) for k, v in names.items()),
        *(F.coalesce(F.max(F.when(F.col("index") == v, F.col("coverage"))), F.lit(0.0)).alias(f"{k}_cov") for k, v in names.items()),
    )
    fired = resonance.groupBy("d").agg(F.count_distinct("resonance_key").alias("themes"), F.bool_or(F.col("resonance_key") == "fake_selloff_reversal").alias("fake"))
    rows = wide.join(fired, "d", "left")
    core = [F.col("rp_cov"), F.col("ls_cov"), F.col("bd_cov")]
    thin = (sum(core, F.lit(0.0)) / 3 < specs.MIN_STATE_COVERAGE) | (F.least(*core) < specs.MIN_INDEX_COVERAGE)
    label = (
        F.when(thin, "insufficient data")
        .when(F.col("fake") & (F.col("rp") >= 85), "reversal watch")
        .when((F.col("rp") >= 90) & (F.col("bd") >= 80), "panic watch")
        .when((F.col("rp") >= 75) | (F.col("ls") >= 75), "fragile watch")
        .when(F.col("themes") >= 2, "resonance watch")
        .when((F.col("rp") <= 25) & (F.col("of_cov") >= specs.MIN_INDEX_COVERAGE) & (F.col("of") >= 80), "low-vol crowding watch")
        .otherwise("normal watch")
    )
    return rows.select("d", label.alias("state"))
