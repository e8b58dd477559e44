"""Option-chain structure: exposure curves, flips, walls, expected move, ratios and selections.

Chains have (ticker, dte, strike, cp, oi, iv) and may carry mid and delta; spots have
(ticker, spot), one row a ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing

# Levels of the grid, and how far it reaches from spot.
GRID, WIDTH = 161, 0.20


def contracts(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """Contracts with open interest, volatility and a bucket, with their spot and years to expiry."""
    rows = chain.join(spots, "ticker").withColumn("bucket", pricing.bucket(F.col("dte"))).withColumn("years", F.greatest(F.col("dte"), F.lit(0.25)) / 365.0)
    return rows.where("bucket is not null and oi > 0 and iv > 0")


def gamma_curve(held: DataFrame) -> DataFrame:
    """(ticker, bucket, i, level, exposure): gamma re-priced on 161 levels within 20 percent of spot.

    Each contract meets its own grid (an explode, no join), summed map-side by bucket; ALL is
    summed from the buckets' few rows.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))
    level = F.col("spot") * (1 - WIDTH + 2 * WIDTH * F.col("i") / (GRID - 1))
    rows = held.select("ticker", "bucket", "spot", "strike", "years", "iv", "oi", "cp", at.alias("i"))
    value = pricing.dollar_gamma(level, F.col("strike"), F.col("years"), F.col("iv"), F.col("oi"), F.col("cp"))
    own = rows.groupBy("ticker", "bucket", "spot", "i").agg(F.sum(value).alias("exposure"))
    sets = own.groupingSets([["ticker", "spot", "i", "bucket"], ["ticker", "spot", "i"]], "ticker", "spot", "i", "bucket").agg(F.sum("exposure").alias("exposure"))
    return sets.select("ticker", F.coalesce("bucket", F.lit("ALL")).alias("bucket"), "i", level.alias("level"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"))


def zero_points(curve: DataFrame) -> DataFrame:
    """(ticker, bucket, level): levels at which the exposure changes sign, interpolated, to 4 places."""
    w = Window.partitionBy("ticker", "bucket").orderBy("i")
    scale = F.max(F.abs("exposure")).over(Window.partitionBy("ticker", "bucket"))
    y0, y1, x0, x1 = F.col("exposure"), F.lead("exposure").over(w), F.col("level"), F.lead("level").over(w)
    small = F.abs(y0) <= F.greatest(F.lit(1e-12), scale * 1e-9)
    cross = F.when(small, x0).when(y0 * y1 < 0, x0 - y0 * (x1 - x0) / (y1 - y0))
    found = curve.withColumn("scale", scale).withColumn("zero", F.round(cross, 4)).where("scale >= 1e-12 and zero is not null")
    return found.select("ticker", "bucket", F.col("zero").alias("level")).distinct()


def gamma_buckets(held: DataFrame) -> DataFrame:
    """(ticker, bucket, net_gamma_m, contract_count, expiration_count, expirations) by bucket and in ALL."""
    rows = held.withColumn("v", pricing.dollar_gamma(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv"), F.col("oi"), F.col("cp")))
    sets = rows.groupingSets([["ticker", "bucket"], ["ticker"]], "ticker", "bucket").agg(
        F.sum("v").alias("net_gamma_m"), F.count("*").alias("contract_count"), F.count_distinct("dte").alias("expiration_count"), F.array_join(F.array_sort(F.collect_set("dte")), ",").alias("expirations"),
    )
    return sets.withColumn("bucket", F.coalesce("bucket", F.lit("ALL")))


def primary_flip(zeroes: DataFrame, spots: DataFrame) -> DataFrame:
    """(ticker, bucket, flip): the zero point nearest to spot, the lower of two as near."""
    near = F.struct(F.abs(F.col("level") - F.col("spot")), F.col("level"))
    return zeroes.join(spots, "ticker").groupBy("ticker", "bucket").agg(F.min_by("level", near).alias("flip"))


def walls(held: DataFrame, near: tuple[str, ...] = ("0DTE", "1-7D")) -> DataFrame:
    """(ticker, call_wall, put_wall, pin_strike): strikes of the greatest near exposure, the lowest of equals."""
    v = F.abs(pricing.dollar_gamma(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv"), F.col("oi"), F.col("cp")))
    sums = held.where(F.col("bucket").isin(*near)).groupBy("ticker", "cp", "strike").agg(F.round(F.sum(v), 9).alias("w"))
    best = F.struct("w", -F.col("strike"))
    sides = sums.groupBy("ticker").agg(F.max_by(F.when(F.col("cp") == "C", F.col("strike")), F.when(F.col("cp") == "C", best)).alias("call_wall"), F.max_by(F.when(F.col("cp") == "P", F.col("strike")), F.when(F.col("cp") == "P", best)).alias("put_wall"))
    return sides.withColumn("pin_strike", F.when(F.col("call_wall") == F.col("put_wall"), F.col("call_wall")))


def pin_state(walls_: DataFrame, buckets: DataFrame) -> DataFrame:
    whole = buckets.where("bucket = 'ALL'").select("ticker", "net_gamma_m")
    label = F.when(F.col("pin_strike").isNull(), None).when(F.col("net_gamma_m") >= 0, "PIN_CANDIDATE").otherwise("BREAKOUT_PIVOT")
    return walls_.join(whole, "ticker", "left").select("ticker", "call_wall", "put_wall", "pin_strike", label.alias("pin_state"))


def put_call_ratio(chain: DataFrame) -> DataFrame:
    calls, puts = F.sum(F.when(F.col("cp") == "C", F.col("oi"))), F.coalesce(F.sum(F.when(F.col("cp") == "P", F.col("oi"))), F.lit(0))
    return chain.groupBy("ticker").agg(F.when(calls > 0, puts / calls).alias("oi_pcr"))


def max_open_interest(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """(ticker, dte, strike, cp, oi, distance_pct) of the contract with most open interest; ties by dte, strike, side."""
    order = F.struct("oi", -F.col("dte"), -F.col("strike"), F.when(F.col("cp") == "C", 1).otherwise(0))
    best = chain.where("oi > 0").groupBy("ticker").agg(F.max_by(F.struct("dte", "strike", "cp", "oi"), order).alias("m")).select("ticker", "m.*")
    return best.join(spots, "ticker").select("ticker", "dte", "strike", "cp", "oi", pricing.distance_pct(F.col("strike"), F.col("spot")).alias("distance_pct"))


def expected_move(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """(ticker, atm_strike, value, pct, source): straddle at the nearest strike of the shortest expiry, else spot·IV·√T.

    A missing straddle side falls back to the median volatility; without either all are null and
    the source is MISSING.  ``mid`` is optional in the chain.
    """
    rows = chain if "mid" in chain.columns else chain.withColumn("mid", F.lit(None).cast("double"))
    shortest = rows.groupBy("ticker").agg(F.min("dte").alias("dte"))
    rows = rows.join(shortest, ["ticker", "dte"]).join(spots, "ticker")
    atm = rows.groupBy("ticker").agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).alias("strike"))
    good = F.when(F.col("mid") > 0, F.col("mid"))
    sides = rows.join(atm, ["ticker", "strike"]).groupBy("ticker", "strike", "spot", "dte").agg(
        F.max(F.when(F.col("cp") == "C", good)).alias("call"), F.max(F.when(F.col("cp") == "P", good)).alias("put"), F.median("iv").alias("iv"),
    )
    straddle = F.col("call") + F.col("put")
    fallback = F.when(F.col("dte") > 0, F.col("spot") * F.col("iv") * F.sqrt(F.col("dte") / 365.0))
    source = F.when(straddle.isNotNull(), "ATM_STRADDLE_MID").when(fallback.isNotNull(), "ATM_IV_FALLBACK").otherwise("MISSING")
    value = F.coalesce(straddle, fallback)
    return sides.select("ticker", F.col("strike").alias("atm_strike"), value.alias("value"), (value / F.col("spot") * 100).alias("pct"), source.alias("source"))


def nearest_strikes(chain: DataFrame, spots: DataFrame, k: int = 31) -> DataFrame:
    """(ticker, strike, place): the k strikes around the one nearest to spot, by position in the ladder."""
    strikes = chain.select("ticker", "strike").distinct().join(spots, "ticker")
    w = Window.partitionBy("ticker")
    rows = strikes.withColumn("place", F.row_number().over(w.orderBy("strike")))
    centre = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("gap"), F.col("strike"), F.col("place"))).over(w)["place"]
    return rows.withColumn("centre", centre).where(F.abs(F.col("place") - F.col("centre")) <= k // 2).select("ticker", "strike", (F.col("place") - F.col("centre")).alias("place"))


def sample_expirations(chain: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(ticker, bucket, dte): evenly spread representatives of each bucket; with a limit of one, the first."""
    # Expirations kept of each bucket.
    limits = limits or {"0DTE": 1, "1-7D": 1, "8-30D": 2, "31-60D": 1}
    days = chain.select("ticker", "dte").distinct().withColumn("bucket", pricing.bucket(F.col("dte"))).where("bucket is not null")
    w = Window.partitionBy("ticker", "bucket")
    rows = days.withColumns({"i": F.row_number().over(w.orderBy("dte")) - 1, "n": F.count("*").over(w)})
    keep: Column = F.lit(False)
    for name, k in limits.items():
        picks = [F.lit(0)] if k == 1 else [F.floor(F.lit(j) * (F.col("n") - 1) / (k - 1)).cast("int") for j in range(k)]
        keep = keep | ((F.col("bucket") == name) & ((F.col("n") <= k) | F.array_contains(F.array(*(p.cast("int") for p in picks)), F.col("i"))))
    return rows.where(keep).select("ticker", "bucket", "dte")


def unusual_volume(trades: DataFrame, k: int = 5) -> DataFrame:
    """Top k contracts a ticker by volume to open interest, from those with oi > 100, volume > 500, ratio >= 3."""
    ratio = F.try_divide(F.col("volume"), F.col("oi"))
    rows = trades.withColumn("ratio", ratio).where("oi > 100 and volume > 500 and ratio >= 3")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ratio").desc(), "dte", "strike", "cp"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def delta_skew(held: DataFrame, target: float = 0.25) -> DataFrame:
    """(ticker, call_iv, put_iv, skew): volatilities nearest to 25 delta on either side."""
    value = pricing.delta(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv"), F.col("cp"))
    gap = F.struct(F.round(F.abs(F.abs("delta") - target), 6), "dte", "strike")
    sides = held.withColumn("delta", value).groupBy("ticker").agg(
        F.min_by(F.when(F.col("cp") == "C", F.col("iv")), F.when(F.col("cp") == "C", gap)).alias("call_iv"), F.min_by(F.when(F.col("cp") == "P", F.col("iv")), F.when(F.col("cp") == "P", gap)).alias("put_iv"),
    )
    return sides.withColumn("skew", F.col("put_iv") - F.col("call_iv"))


def flip_continuity(days: DataFrame) -> DataFrame:
    """(ticker, d, status) from (ticker, d, flip, spot, sign_model, expirations): how a day's flip follows the last one."""
    w = Window.partitionBy("ticker").orderBy("d")
    before = F.lag(F.struct("flip", "sign_model", "expirations")).over(w)
    jump = F.abs(F.col("flip") - F.col("p.flip")) >= F.greatest(F.lit(10.0), F.col("spot") * 0.05)
    status = (
        F.when(F.col("flip").isNull(), "NO_CROSSING").when(F.col("p.flip").isNull(), "BASELINE_RESET").when(~F.col("sign_model").eqNullSafe(F.col("p.sign_model")), "METHOD_CHANGED")
        .when(jump, "JUMP_REVIEW").when(~F.col("expirations").eqNullSafe(F.col("p.expirations")), "ROLL_CHANGED").otherwise("OK")
    )
    return days.withColumn("p", before).select("ticker", "d", status.alias("status"))


def assemble_chain(expirations: DataFrame, strikes: DataFrame, spots: DataFrame, most: int = 31) -> DataFrame:
    """(ticker, dte, strike, cp): each sampled expiration with the ``most`` strikes around spot, both rights.

    Strikes within 20 percent of spot count; half of ``most`` on either side of the nearest one,
    so a ticker has at most expirations * ``most`` * 2 contracts.
    """
    inside = strikes.join(spots, "ticker").where((F.col("strike") >= F.col("spot") * 0.80) & (F.col("strike") <= F.col("spot") * 1.20)).select("ticker", "strike", "spot").distinct()
    w = Window.partitionBy("ticker").orderBy("strike")
    placed = inside.withColumn("i", F.row_number().over(w))
    nearest = placed.groupBy("ticker").agg(F.min_by("i", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).alias("mid"))
    kept = placed.join(nearest, "ticker").where(F.abs(F.col("i") - F.col("mid")) <= most // 2).select("ticker", "strike")
    return expirations.select("ticker", "dte").distinct().join(kept, "ticker").select("ticker", "dte", "strike", F.explode(F.array(F.lit("C"), F.lit("P"))).alias("cp"))


def volume_ratio(chain: DataFrame) -> DataFrame:
    """(ticker, volume_pcr): put over call volume of the nearest living expiration, to 2 places; null without call volume."""
    alive = chain.where("dte >= 0")
    first = alive.groupBy("ticker").agg(F.min("dte").alias("dte"))
    calls, puts = (F.coalesce(F.sum(F.when(F.col("cp") == side, F.col("volume"))), F.lit(0)) for side in "CP")
    return alive.join(first, ["ticker", "dte"]).groupBy("ticker").agg(F.when(calls > 0, F.round(puts / calls, 2)).alias("volume_pcr"))


def middle_strikes(strikes: DataFrame, spots: DataFrame, share: float = 0.12, around: int = 20) -> DataFrame:
    """(ticker, strike): strikes within ``share`` of spot, or of a ticker without any the ``around`` on either side of its middle one."""
    rows = strikes.select("ticker", "strike").distinct().join(spots, "ticker")
    w = Window.partitionBy("ticker")
    near = (F.col("strike") >= F.col("spot") * (1 - share)) & (F.col("strike") <= F.col("spot") * (1 + share))
    rows = rows.withColumns({"near": near, "any": F.bool_or(near).over(w), "i": F.row_number().over(w.orderBy("strike")) - 1, "mid": F.floor(F.count("*").over(w) / 2)})
    between = (F.col("i") >= F.col("mid") - around) & (F.col("i") < F.col("mid") + around)
    return rows.where(F.when(F.col("any"), F.col("near")).otherwise(between)).select("ticker", "strike")
