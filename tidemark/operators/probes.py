"""Score ladders and rule-based probes, as ordered conditions over one row a day or ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(value: Column, *steps: tuple[str, float, int]) -> Column:
    """Points of the first step that the value passes; 0 for none or null."""
    points = F.lit(None).cast("int")
    for op, bound, score in reversed(steps):
        points = F.when(value > bound if op == ">" else value < bound, score).otherwise(points)
    return F.coalesce(points, F.lit(0))


def macro_score(rows: DataFrame) -> DataFrame:
    """(d, macro_score) from (d, y10_z, oil_roc, curve, curve_chg, netliq_roc, m2_yoy, nfci, credit_z, cg_z); at most 100."""
    c = F.col
    # Bounds and points of the eight engines.
    parts = [
        ladder(c("y10_z"), (">", 2.0, 15), (">", 1.0, 5)), ladder(c("oil_roc"), (">", 15.0, 15), (">", 10.0, 10)),
        F.when(c("curve") < 0, ladder(c("curve_chg"), (">", 0.2, 15), (">", 0.0, 5))).otherwise(0), ladder(c("netliq_roc"), ("<", -5.0, 15), ("<", -2.0, 8)),
        ladder(c("m2_yoy"), ("<", 0.0, 10), ("<", 2.0, 5)), ladder(c("nfci"), (">", 1.0, 10), (">", 0.5, 5)),
        ladder(c("credit_z"), (">", 2.0, 10), (">", 1.0, 5)), ladder(c("cg_z"), ("<", -2.0, 10), ("<", -1.0, 5)),
    ]
    return rows.select("d", F.least(F.lit(100), sum(parts, F.lit(0))).alias("macro_score"))


def micro_score(rows: DataFrame) -> DataFrame:
    """(d, micro_score) from (d, vix, move, credit, trin, spy_ret, pcr, cmf); absent inputs take neutral defaults."""
    c = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in {"vix": 14.0, "move": 0.0, "credit": 0.0, "trin": 1.0, "pcr": 0.8, "cmf": 0.0}.items()}
    vix, falling = c["vix"], F.coalesce(F.col("spy_ret") < 0, F.lit(False))
    base = F.when(vix >= 35, 60.0).when(vix >= 25, 40 + (vix - 25) / 10 * 20).when(vix >= 18, 20 + (vix - 18) / 7 * 20).when(vix >= 12, (vix - 12) / 6 * 20).otherwise(0.0)
    total = (
        base + F.when(c["move"] >= 120, 15).when(c["move"] >= 100, 10).otherwise(0) + F.when(c["credit"] > 5, 15).otherwise(0)
        + F.when((c["trin"] > 1.5) & falling, 15).when(c["trin"] > 1.2, 10).when((c["trin"] < 0.7) & falling, -10).otherwise(0)
        + F.when(c["pcr"] > 1, 10).otherwise(0) + F.when(c["cmf"] < -0.05, 10).otherwise(0)
    )
    return rows.select("d", F.greatest(F.lit(0), F.least(F.lit(100), total.cast("int"))).alias("micro_score"))


def regime(rows: DataFrame) -> DataFrame:
    """(d, regime, skeleton) from (d, y10, oil, cg, hyg, breadth); the first quadrant that fits."""
    y, o, g, h, b = (F.col(k) for k in ("y10", "oil", "cg", "hyg", "breadth"))
    label = (
        F.when((y > 4.3) & (o > 80) & (g > 20), "reflation").when((y < 3.8) & (h < 75) & (o < 70), "hard landing")
        .when((y < 4.2) & (h > 77) & (o < 75), "goldilocks").when((y > 4.5) & (g < 18) & (o > 85), "stagflation").otherwise("transition")
    )
    return rows.select("d", label.alias("regime"), F.when(b > 60, "bull").when(b < 40, "bear").otherwise("range").alias("skeleton"))


def vol_probe(rows: DataFrame) -> DataFrame:
    """(d, level, findings) from (d, contango, breadth_gap, drag): inverted or flat curve, narrow breadth, drag (text alone)."""
    found = [
        (F.col("contango") < 0, "curve inverted", 2), ((F.col("contango") >= 0) & (F.col("contango") < 3), "curve flat", 1),
        (F.col("breadth_gap") > 1.5, "narrow breadth", 1), (F.col("drag") < -2, "leverage drag", 0),
    ]
    level = sum((F.when(hit, points).otherwise(0) for hit, _, points in found), F.lit(0))
    return rows.select("d", level.alias("level"), F.array_join(F.array_compact(F.array(*(F.when(hit, F.lit(text)) for hit, text, _ in found))), "; ").alias("findings"))


def micro_probe(rows: DataFrame) -> DataFrame:
    """(ticker, d, findings) from (ticker, d, price, poc, dpsv, flip, pin_strike, pin_state, charm, ivr, obv_status); the level is never raised.

    The flip level is compared with that of the sixth last row, the charm with that of the row
    before.  Rows without a date are left out, and a ticker's first row finds nothing.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    c = F.col
    rows = rows.where("d is not null").withColumns({"_week": F.lag("flip", 5).over(w), "_n": F.row_number().over(w)})
    pinned = c("pin_strike").isNotNull() & (c("pin_state") != "")
    found = [
        (c("price") > c("poc") * 1.02, "above cost core"), ((c("price") > 0) & (c("price") < c("poc") * 0.98), "below cost core"), (c("obv_status").endswith("divergence"), "volume divergence"),
        (c("dpsv") > 50, "dark pool short high"), (c("dpsv") < 40, "dark pool short low"), (c("flip") > c("_week"), "flip up in a week"), (c("flip") < c("_week"), "flip down in a week"),
        (pinned & (c("pin_state") == "PIN_CANDIDATE"), "pin candidate"), (pinned & (c("pin_state") != "PIN_CANDIDATE"), "breakout pivot"), (c("charm") * F.lag("charm").over(w) < 0, "charm flipped"), (c("ivr") < 10, "volatility cheap"),
    ]
    return rows.select("ticker", "d", F.array_compact(F.array(*(F.when((c("_n") > 1) & hit, F.lit(text)) for hit, text in found))).alias("findings"))


def intraday_alert(rows: DataFrame, flip_alerts: bool = True) -> DataFrame:
    """``rows`` with alert, from (price, prev_close, expected_move, trin, ratio, ctick, flip, vwap); ordered rules.

    Reaching the lower bound under a high TRIN ends the ladder even when its inner test fails.
    """
    p, ratio = F.col("price"), F.col("ratio")
    bound = F.when(F.col("prev_close") > 0, F.col("prev_close") * (1 - F.col("expected_move"))).otherwise(p * 0.98)
    at_bound = (p <= bound * 1.002) & (F.col("trin") >= 1.5)
    under_flip = (F.col("flip") > 0) & (p < F.col("flip")) & (p < F.col("vwap")) if flip_alerts else F.lit(False)
    label = (
        F.when(at_bound, F.when((ratio >= 2) & (F.col("ctick") > 0), "capitulation bid"))
        .when(under_flip, F.when((ratio <= 0.25) & (F.col("ctick") < -300), "gamma slide"))
        .when((ratio >= 4) & (p > F.col("vwap")), "up-volume surge").when((ratio <= 0.20) & (p < F.col("vwap")), "down-volume surge")
    )
    return rows.withColumn("alert", label)


def volume_ratio(up: Column, down: Column) -> Column:
    """Up to down volume: 99 without down volume, 1 without any."""
    return F.when(down > 0, up / down).when(up > 0, 99.0).otherwise(1.0)


def job_status(missing: Column, expected: int) -> Column:
    return F.when(F.size(missing) == 0, "ok").when(F.size(missing) < expected, "partial").otherwise("failed")


def macro_probe(rows: DataFrame) -> DataFrame:
    """(d, level, findings) from (d, thrust, dix_divergence, term_inverted, vrp_panic, risk_averse): texts in order, points of the alert level."""
    c = F.col
    # What is found, and the points it adds to the alert level.
    found = [
        (c("thrust") == "thrust", "bottom confirmed by breadth", 0), (c("thrust") == "washout", "panic in breadth", 2), (c("dix_divergence"), "off-exchange divergence", 0),
        (c("term_inverted"), "volatility curve inverted", 2), (c("vrp_panic"), "volatility premium extreme", 1), (c("risk_averse"), "credit against bonds turns averse", 1),
    ]
    level = sum((F.when(hit, points).otherwise(0) for hit, _, points in found), F.lit(0))
    return rows.select("d", level.alias("level"), F.array_join(F.array_compact(F.array(*(F.when(hit, F.lit(text)) for hit, text, _ in found))), "; ").alias("findings"))


def momentum_scan(snapshots: DataFrame, least: int = 30, bound: float = 2.0) -> DataFrame:
    """(scope, metric, d, z, move): series more than ``bound`` deviations off with more than ``least`` rows, up or down."""
    return snapshots.where((F.col("n") > least) & (F.abs("z") > bound)).select("scope", "metric", "d", "z", F.when(F.col("z") > 0, "up").otherwise("down").alias("move"))
