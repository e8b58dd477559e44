"""Quotes, futures and logs: cascades with labels, nearest contracts, session rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import positive
from ..functions.pricing import midpoint

NEW_YORK = "America/New_York"

#: A quote feed's codes.
FEED = {1: "live", 2: "frozen", 3: "delayed", 4: "delayed frozen"}


def reference_price(quotes: DataFrame) -> DataFrame:
    """``quotes`` with price and price_source: two-sided midpoint, else last, else previous close."""
    mid, last, close = midpoint(F.col("bid"), F.col("ask")), positive(F.col("last")), positive(F.col("prev_close"))
    label = F.when(mid.isNotNull(), "mid").when(last.isNotNull(), "last").when(close.isNotNull(), "prev_close").otherwise("missing")
    return quotes.withColumns({"price": F.coalesce(mid, last, close), "price_source": label})


def feed_label(code: Column) -> Column:
    label = F.lit(None).cast("string")
    for k, v in FEED.items():
        label = F.when(code == k, v).otherwise(label)
    return F.coalesce(label, F.lit("unknown"))


def before_open(bars: DataFrame, day: Column, ts: str = "ts") -> DataFrame:
    """Bars of the local day before 09:30 New York; ``ts`` is a UTC instant."""
    local = F.from_utc_timestamp(F.col(ts), NEW_YORK)
    return bars.where((F.to_date(local) == day) & (F.date_format(local, "HH:mm") < "09:30"))


def nearest_contracts(contracts: DataFrame, today: Column, k: int = 2) -> DataFrame:
    """The k contracts of each root that expire after today, nearest first, with their place."""
    w = Window.partitionBy("root").orderBy("expiry")
    return contracts.where(F.col("expiry") > today).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def front_contract(contracts: DataFrame, today: Column, guard: int = 5) -> DataFrame:
    """(root, expiry): the first contract more than ``guard`` days off, else the first still alive."""
    alive = contracts.where(F.col("expiry") >= today)
    near = (F.datediff("expiry", today) <= guard).cast("int")
    return alive.groupBy("root").agg(F.min_by("expiry", F.struct(near, F.col("expiry"))).alias("expiry"))


def implied_reference(bars: DataFrame, closes: DataFrame, today: Column) -> DataFrame:
    """(root, reference): previous close moved by the future's change from its last prior day's last bar to today's."""
    days = bars.groupBy("root", F.to_date("ts").alias("d")).agg(F.max_by("price", "ts").alias("price"))
    now = days.groupBy("root").agg(
        F.max_by(F.when(F.col("d") == today, F.col("price")), F.when(F.col("d") == today, F.col("d"))).alias("now"),
        F.max_by(F.when(F.col("d") < today, F.col("price")), F.when(F.col("d") < today, F.col("d"))).alias("before"),
    )
    return now.join(closes, "root").select("root", (F.col("prev_close") * F.try_divide("now", "before")).alias("reference"))


def contango(first: Column, second: Column) -> Column:
    """Futures curve: second over first, in percent."""
    return (F.try_divide(second, first) - 1) * 100


def term_ratio_contango(spot: Column, three_months: Column) -> Column:
    """Spot form of the curve, a measure of its own: 1 - spot over three months, in percent."""
    return (1 - F.try_divide(spot, three_months)) * 100


def backfill_contango(spot: Column, three_months: Column) -> Column:
    """The third form, used for history alone: three months over spot - 1, in percent."""
    return (F.try_divide(three_months, spot) - 1) * 100


def net_liquidity(assets: DataFrame) -> DataFrame:
    """(d, net_liq_b, source_date) from billions of assets, tga and rrp with their dates; the oldest date counts."""
    return assets.select("d", (F.col("fed_assets_b") - F.col("tga_b") - F.col("rrp_b")).alias("net_liq_b"), F.least("fed_assets_date", "tga_date", "rrp_date").alias("source_date"))


def rate_spreads(rates: DataFrame) -> DataFrame:
    """``rates`` with spreads to the administered rate, and the dispersion of the secured one, in basis points."""
    spreads = {f"{r}_iorb_bps": (F.col(r) - F.col("iorb")) * 100 for r in ("sofr", "tgcr", "effr")}
    return rates.withColumns(spreads | {"sofr_75_iorb_bps": (F.col("sofr_p75") - F.col("iorb")) * 100, "sofr_dispersion_bps": (F.col("sofr_p99") - F.col("sofr")) * 100})


def log_date(line: Column) -> Column:
    """Whether a log's line begins with a date in brackets."""
    return F.startswith(line, F.lit("[20")) & (F.substring(line, 6, 1) == "-") & (F.length(line) >= 11)


def todays_log(lines: DataFrame, today: str, noise: list[str]) -> DataFrame:
    """A log's lines of today: those after a line whose bracketed date holds ``today``, up to one with another date.

    Lines before the first date count as today's.  Lines that hold a word of ``noise`` are left
    out first, dates and all, and so are blank ones.  ``lines`` has (file, n, line); order matters
    within a file alone.
    """
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line, quiet = F.col("line"), F.col("line").isNotNull()
    for word in noise:
        quiet = quiet & ~line.contains(word)
    gate = F.last(F.when(log_date(line), line.contains(today)), ignorenulls=True).over(w)
    return lines.where(quiet).withColumn("_open", F.coalesce(gate, F.lit(True))).where("_open").where(line.rlike(r"\S")).drop("_open")


def g3_liquidity(fed: Column, ecb: Column, boj: Column, eur_usd: Column, usd_jpy: Column) -> Column:
    """Three central banks' assets in billions of dollars: millions of dollars, millions of euros, units of 100 million yen."""
    value = fed / 1000 + ecb * F.coalesce(eur_usd, F.lit(1.0)) / 1000 + F.try_divide(boj / 10, F.coalesce(usd_jpy, F.lit(150.0)))
    return F.when(fed > 0, F.round(value, 2))


def sessions(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Intraday bars with their local day and session: PRE before 09:30 New York, RTH to 16:00, POST after."""
    local = F.from_utc_timestamp(F.col(ts), NEW_YORK)
    clock = F.date_format(local, "HH:mm")
    return bars.withColumns({"day": F.to_date(local), "session": F.when(clock < "09:30", "PRE").when(clock < "16:00", "RTH").otherwise("POST")})


def largest(snapshot: DataFrame, k: int = 500, by: str = "market_cap", name: str = "name") -> DataFrame:
    """The k rows with the greatest ``by``, ties by name: a top-k report, merged from each task's own top k."""
    return snapshot.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), name).limit(k)
