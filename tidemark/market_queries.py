"""Registered queries of quotes, options, probes, reports, readers, sinks and streams; twins in ``market_oracles``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries as base
from .functions import clean, pricing, series
from .operators import align, anomaly, bars, liquidity, market, options, probes, reports
from .plans import inputs
from .queries import QUERIES, query, rounded
from .sources import folders, readers, sinks
from .streaming import market as streams

__all__ = ["QUERIES"]

TODAY = "1998-06-30"


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote for each part, with gaps: one side missing, crossed sides, zero prices."""
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 3 > 0, p - 1).alias("bid"), F.when(k % 5 > 0, p + k % 4 - 2).alias("ask"), F.when(k % 7 > 0, F.when(k % 11 == 0, 0.0).otherwise(p)).alias("last"),
        F.when(k % 2 > 0, p - 3).alias("prev_close"), F.when(k % 4 == 1, p + 2).alias("market"), F.when(k % 9 == 1, p + 5).alias("close"), F.when(k % 13 == 1, p + 7).alias("latest_bar"),
        (k % 6).cast("int").alias("code"),
    )


@query
def reference_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.reference_price(_quotes(spark, sf_dir)).select("p_partkey", "price", "price_source"))


@query
def feed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("p_partkey", market.feed_label(F.col("code")).alias("feed"))


@query
def price_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote, index = clean.cascade("quote"), clean.cascade("index")
    return rounded(_quotes(spark, sf_dir).select("p_partkey", quote[0].alias("quote"), quote[1].alias("quote_from"), index[0].alias("index"), index[1].alias("index_from")))


def _raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as texts in every spelling that the inputs use."""
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    text = F.when(k % 7 == 0, "-").when(k % 7 == 1, "n/a").when(k % 7 == 2, "abc").when(k % 7 == 3, "NaN").when(k % 7 == 4, F.format_number(k * 1000, 0)).when(k % 7 == 5, F.concat(F.lit(" "), k.cast("string"), F.lit(".5 "))).otherwise(k.cast("string"))
    size = F.concat((k % 90).cast("string"), F.lit(".5"), F.element_at(F.array(*map(F.lit, ("K", "M", "b", " T", "", "X"))), (k % 6 + 1).cast("int")))
    period = F.concat((k % 30).cast("string"), F.element_at(F.array(*map(F.lit, ("y", "mo", "MO", "d", ""))), (k % 5 + 1).cast("int")))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), size.alias("size"), period.alias("period"), p.alias("price"))


@query
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _raw_texts(spark, sf_dir).select("p_partkey", clean.number(c("text")).alias("value"), F.round(clean.magnitude(c("size")), 6).alias("millions"), clean.period_days(c("period")).alias("days"), clean.positive(c("p_partkey") % 3 - 1).alias("positive"))


@query
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_texts(spark, sf_dir).withColumn("price", F.when(F.col("p_partkey") % 4 > 0, F.col("price")))
    missing = clean.missing_fields("text", "size", "price")
    return rows.select("p_partkey", F.array_join(missing, ",").alias("missing"), probes.job_status(missing, 3).alias("status"))


@query
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with holes, some of them corrected by a second one of the day, which may itself be no number."""
    facts, day = inputs.metric_facts(spark, sf_dir).withColumn("sent", F.lit(1)), F.dayofmonth("d")
    holes = facts.withColumn("value", F.when(day == 13, float("nan")).when(day == 14, float("inf")).otherwise(F.col("value")))
    again = facts.where(day.between(7, 9)).select("scope", "metric", "d", F.when(day == 8, float("nan")).otherwise(F.col("value") + 1).alias("value"), F.lit(2).alias("sent"))
    return rounded(clean.trading_days(holes.union(again), ["scope", "metric"], ["sent"]))


@query
def history_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four spellings, one of them unreadable; of a day the order with the greatest key counts."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(day, "yyyyMMdd")).when(k % 4 == 1, F.concat(day.cast("string"), F.lit("T21:30:00-05:00"))).when(k % 4 == 2, F.concat(F.lit("bad "), day.cast("string"))).otherwise(day.cast("string"))
    rows = inputs.table(spark, sf_dir, "orders").select(text.alias("d"), k.alias("ordinal"), _cents("o_totalprice").alias("cents"))
    return clean.normalised_history(rows)


@query
def new_york_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text, with an offset or without one."""
    k, ts = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(k % 3 == 0, F.concat(ts, F.lit("+00:00"))).when(k % 3 == 1, F.concat(F.translate(ts, " ", "T"), F.lit("+02:00"))).otherwise(ts)
    return inputs.table(spark, sf_dir, "events").select("event_id", clean.new_york(text).alias("local"))


@query
def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by local day and session."""
    rows = market.sessions(inputs.table(spark, sf_dir, "events"))
    return rows.groupBy("day", "session").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).withColumn("day", F.col("day").cast("string"))


@query
def bars_before_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every local day what came before 09:30 New York."""
    events = inputs.table(spark, sf_dir, "events")
    local = F.to_date(F.from_utc_timestamp("ts", market.NEW_YORK))
    return market.before_open(events, local).select("event_id", local.cast("string").alias("day"))


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "part").select(F.col("p_brand").alias("root"), F.date_add(F.lit(TODAY).cast("date"), F.col("p_size") - 12).alias("expiry")).distinct()


@query
def nearest_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.nearest_contracts(_contracts(spark, sf_dir), F.lit(TODAY).cast("date")).withColumn("expiry", F.col("expiry").cast("string"))


@query
def front_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.front_contract(_contracts(spark, sf_dir), F.lit(TODAY).cast("date")).withColumn("expiry", F.col("expiry").cast("string"))


@query
def implied_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures bars: each brand's line items, one a second of their ship day; today is a day amid the data."""
    lines = inputs.table(spark, sf_dir, "lineitem").join(inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    ts = F.timestamp_seconds(F.unix_timestamp(F.to_date("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 80000)
    prices = lines.groupBy(F.col("p_brand").alias("root"), ts.alias("ts")).agg(F.max(_cents("l_extendedprice")).alias("price")).where(F.to_date("ts") <= TODAY)
    closes = base._spots(spark, sf_dir).select(F.col("ticker").alias("root"), F.col("spot").alias("prev_close"))
    return rounded(market.implied_reference(prices, closes, F.lit(TODAY).cast("date")))


@query
def expiry_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each order's time to an expiration some days off; some are past."""
    k = F.col("o_orderkey")
    as_of = F.timestamp_seconds(F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")) + k * 3571 % 86400)
    expiration = F.date_add(F.to_date("o_orderdate"), (k % 60 - 2).cast("int"))
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", F.round(pricing.years_to_expiry(as_of, expiration) * 365 * 86400, 0).alias("seconds"))


@query
def expiry_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", F.datediff(pricing.third_friday(F.col("d")), "d").alias("days"))


@query
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text to eight digits and back."""
    days = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    compact = days.withColumn("compact", F.date_format("d", "yyyyMMdd"))
    return compact.select("d", "compact", F.expr("try_to_date(compact, 'yyyyMMdd')").cast("string").alias("again"))


@query
def curve_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three measures of the volatility curve that must not be mixed."""
    c = F.col
    return rounded(base._macro_wide(spark, sf_dir).select("d", market.contango(c("vix"), c("move")).alias("futures"), market.term_ratio_contango(c("vix"), c("move")).alias("ratio"), market.backfill_contango(c("vix"), c("move")).alias("backfill")))


OFFICIAL = {
    "fed_assets_b": ("2-HIGH", "move"), "tga_b": ("3-MEDIUM", "vix"), "rrp_b": ("5-LOW", "trin"), "iorb": ("2-HIGH", "trin"), "sofr_rate": ("3-MEDIUM", "trin"), "sofr_p75": ("4-NOT SPECIFIED", "trin"),
    "sofr_p99": ("4-NOT SPECIFIED", "credit_z"), "tgcr_rate": ("MACRO", "trin"), "effr_rate": ("MACRO", "credit_z"),
}


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for column, (scope, metric) in OFFICIAL.items() for x in (f"{scope}/{metric}", column)))
    facts = inputs.metric_facts(spark, sf_dir).withColumn("column", F.try_element_at(names, F.concat_ws("/", "scope", "metric"))).where("column is not null")
    return align.asof(base._calendar(spark, sf_dir), facts.select("column", "d", "value"), ["column"])


@query
def official_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.official_frame(_official(spark, sf_dir), list(OFFICIAL)))


@query
def net_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = align.official_frame(_official(spark, sf_dir), list(OFFICIAL))
    assets = wide.select("d", "fed_assets_b", "tga_b", "rrp_b", F.col("fed_assets_b_source_date").alias("fed_assets_date"), F.col("tga_b_source_date").alias("tga_date"), F.col("rrp_b_source_date").alias("rrp_date"))
    return rounded(market.net_liquidity(assets))


@query
def rate_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = align.official_frame(_official(spark, sf_dir), list(OFFICIAL)).select("d", "iorb", "sofr_p75", "sofr_p99", *(F.col(f"{r}_rate").alias(r) for r in ("sofr", "tgcr", "effr")))
    return rounded(market.rate_spreads(wide).select("d", "sofr_iorb_bps", "tgcr_iorb_bps", "effr_iorb_bps", "sofr_75_iorb_bps", "sofr_dispersion_bps"))


@query
def g3_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    value = market.g3_liquidity(c("vix") * 1000, c("move") * 1000, c("pct_200ma") * 1e5, c("credit_z"), c("trin") * 10 + 0.7)
    return base._macro_wide(spark, sf_dir).select("d", value.alias("g3_liq"))


@query
def values_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' last value at or before a day, and five weekdays before it."""
    facts = inputs.metric_facts(spark, sf_dir)
    now, then = align.at_or_before(facts, ["scope", "metric"], TODAY), align.at_or_before(facts, ["scope", "metric"], TODAY, 5)
    both = now.join(then.select("scope", "metric", F.col("value").alias("base"), F.col("source_date").alias("base_date")), ["scope", "metric"], "left")
    return rounded(both.withColumns({"source_date": F.col("source_date").cast("string"), "base_date": F.col("base_date").cast("string")}))


@query
def resampled_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily, weekly and monthly series carried to weekdays; the last of them."""
    facts = inputs.metric_facts(spark, sf_dir)
    mixed = facts.where(F.when(F.col("metric") == "vix", F.dayofweek("d") == 6).when(F.col("metric") == "move", F.dayofmonth("d") == 1).otherwise(True))
    return rounded(align.resampled(mixed, base._calendar(spark, sf_dir), ["scope", "metric"]))


@query
def strict_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' last value before the day, whatever lies between, and the change from it."""
    facts, w = base._series(spark, sf_dir)
    return rounded(facts.select("scope", "metric", "d", F.lag("d").over(w).cast("string").alias("previous"), series.change(F.col("value"), w, 1).alias("increment")))


@query
def merged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, ships = base._daily(spark, sf_dir)
    return align.merged_prices(orders.select("d", "price"), ships.select("d", F.when(F.col("n") % 3 > 0, F.col("ship_price")).alias("price")), ["d"])


@query
def priority_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one measure, each with gaps and the dates that its values are from."""
    orders, ships = base._daily(spark, sf_dir)
    first = ships.select("d", F.when(F.col("n") % 4 > 0, F.col("n")).alias("n"), F.date_sub("d", 1).alias("n_source_date"))
    second = orders.select("d", F.when(F.col("n") % 5 > 0, F.col("n")).alias("n"), F.date_sub("d", 7).alias("n_source_date"))
    return align.priority_merge(first, second, ["d"], ["n"])


@query
def with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table, and of another where the first has no such key."""
    orders, ships = base._daily(spark, sf_dir)
    return readers.with_fallback(ships.select("d", "n"), orders.select("d", "n"), ["d"])


@query
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(readers.latest(readers.history(inputs.metric_facts(spark, sf_dir), "1996-01-01", TODAY), ["scope", "metric"]))


@query
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(readers.wide_to_long(base._macro_wide(spark, sf_dir), ["d"]))


@query
def net_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly report of markets: long and short contracts by type and size of part."""
    reports_ = inputs.table(spark, sf_dir, "part").select(
        F.date_add(F.lit(TODAY).cast("date"), -7 * (F.col("p_size") % 3)).alias("d"), F.col("p_type").alias("market"), F.col("p_size").cast("long").alias("long"), (F.col("p_partkey") % 17).alias("short"),
    )
    return readers.net_positions(reports_, [("household", ["economy", "brushed"], ["copper"]), ("parts", ["small"], ["tin", "steel"]), ("offers", ["promo"], []), ("others", ["e"], ["large"])])


@query
def largest_by_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = inputs.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("market_cap"))
    return market.largest(snapshot, 500)


@query
def breadth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.breadth_counts(bars.market_snapshot(inputs.bars(spark, sf_dir)))


@query
def heatmap_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.heatmap(inputs.bars(spark, sf_dir)))


@query
def trailing_tick_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.trailing_mean(inputs.table(spark, sf_dir, "events"), ["event_type"]).select("event_id", "trailing_mean"), 6)


@query
def volume_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars.breadth(inputs.bars(spark, sf_dir))
    return rounded(days.select("d", probes.volume_ratio(F.col("up_volume"), F.col("down_volume")).alias("ratio")))


@query
def volume_pcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.volume_ratio(inputs.chain(spark, sf_dir).withColumn("volume", F.col("oi") * (F.col("strike").cast("long") % 7)))


@query
def chain_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain, spots = inputs.chain(spark, sf_dir), base._spots(spark, sf_dir)
    return options.assemble_chain(options.sample_expirations(chain), chain.select("ticker", "strike"), spots)


@query
def middle_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots of every other ticker are far off, so that the middle strikes stand in."""
    spots = base._spots(spark, sf_dir).withColumn("spot", F.when(F.col("ticker").rlike("[13579]$"), F.col("spot") * 3).otherwise(F.col("spot")))
    return options.middle_strikes(inputs.chain(spark, sf_dir), spots, 0.02)


@query
def option_vega(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = pricing.vega(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv"))
    return rounded(base._held(spark, sf_dir).groupBy("ticker", "bucket").agg(F.sum(value).alias("vega"), F.max(value).alias("most")))


@query
def expected_straddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with quotes: straddles where both sides have one, else the fallback."""
    chain = inputs.chain(spark, sf_dir).where("dte between 1 and 60").withColumn("mid", F.when(F.col("oi") % 5 > 0, F.col("oi") / 8))
    return rounded(options.expected_move(chain, base._spots(spark, sf_dir)))


@query
def all_zero_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeroes = options.zero_points(options.gamma_curve(base._held(spark, sf_dir)))
    return zeroes.groupBy("ticker", "bucket").agg(F.count("*").alias("zeroes"), F.round(F.min("level"), 3).alias("lowest"), F.round(F.max("level"), 3).alias("highest"))


@query
def flip_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of flips with gaps, changes of method and of expirations."""
    days = inputs.bars(spark, sf_dir).select(
        F.col("symbol").alias("ticker"), "d", F.when(F.col("volume") % 11 > 0, F.col("close") / 1000).alias("flip"), (F.col("close") / 900).alias("spot"),
        F.when(F.col("volume") % 13 == 0, "B").otherwise("A").alias("sign_model"), F.when(F.col("volume") % 3 == 0, "x").otherwise("y").alias("expirations"),
    )
    return options.flip_continuity(days)


def _probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = inputs.bars(spark, sf_dir)
    status = bars.obv(days).select("symbol", "d", F.col("status").alias("obv_status"))
    c = F.col
    rows = days.join(status, ["symbol", "d"])
    return rows.select(
        c("symbol").alias("ticker"), "d", (c("close") / 100.0).alias("price"), ((c("high") + c("low")) / 200.0).alias("poc"), (c("volume") % 70).alias("dpsv"), F.when(c("volume") % 11 > 0, F.floor(c("open") / 1000) * 10.0).alias("flip"),
        F.when(c("volume") % 3 > 0, c("open") / 100.0).alias("pin_strike"), F.when(c("volume") % 5 == 0, "PIN_CANDIDATE").when(c("volume") % 5 == 1, "BREAKOUT").alias("pin_state"), (c("volume") % 7 - 3).alias("charm"), (c("volume") % 40).alias("ivr"), "obv_status",
    )


@query
def micro_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.micro_probe(_probe_rows(spark, sf_dir)).withColumn("findings", F.array_join("findings", "; "))


@query
def intraday_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = inputs.bars(spark, sf_dir).select(
        "symbol", "d", c("close").alias("price"), c("open").alias("prev_close"), ((c("volume") % 10) / 100).alias("expected_move"), ((c("volume") % 4) * 0.8).alias("trin"), ((c("volume") % 9) / 2 - 0.1).alias("ratio"),
        (c("volume") % 1000 - 500).alias("ctick"), (c("high") * 0.9).alias("flip"), ((c("high") + c("low")) / 2).alias("vwap"),
    )
    return probes.intraday_alert(rows).select("symbol", "d", "alert")


def _macro_probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    thrust = bars.breadth_thrust(bars.breadth(inputs.bars(spark, sf_dir))).select("d", F.col("signal").alias("thrust"))
    c = F.col
    wide = base._macro_wide(spark, sf_dir).select("d", (c("vix") < 60).alias("dix_divergence"), (c("vix_contango_pct") < 0).alias("term_inverted"), (c("credit_z") > 2).alias("vrp_panic"), (c("trin") > 2).alias("risk_averse"))
    return wide.join(thrust, "d")


@query
def macro_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.macro_probe(_macro_probe_rows(spark, sf_dir))


@query
def momentum_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probes.momentum_scan(base._snapshot(spark, sf_dir)))


NOISE = ["heartbeat", "debug"]


def log_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(file, n, line) of a log for each event type, and the last day of all."""
    k, date = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    line = (
        F.when(k % 11 == 0, F.concat(date, F.lit(" scan"))).when(k % 7 == 1, F.concat(F.lit("["), date, F.lit(" 10:00:00] tick"))).when(k % 13 == 2, F.concat(F.lit("["), date, F.lit("] heartbeat")))
        .when(k % 5 == 2, "  heartbeat ok").when(k % 17 == 3, "  ").otherwise(F.concat(F.lit("detail "), k.cast("string")))
    )
    events = inputs.table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("file"), k.alias("n"), line.alias("line")), str(events.agg(F.max(F.to_date("ts"))).first()[0])


@query
def todays_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each event type: some lines begin with their date in brackets, others follow one; some are noise, dated or not."""
    lines, today = log_lines(spark, sf_dir)
    return market.todays_log(lines, today, NOISE)


@query
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.ordered(base._events(spark, sf_dir)).select("d", "place", "metric", "scope", "window_scope", "severity")


@query
def environment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.environment_lines(base.environment_scores(spark, sf_dir))


def _liquidity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = base._liquidity_facts(spark, sf_dir)
    return facts, liquidity.pillar_scores(base._components(spark, sf_dir)), liquidity.context(facts.select("d", "column", "value"))


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, pillars, context = _liquidity(spark, sf_dir)
    tga = facts.where(F.col("column") == "tga_b")
    w = Window.partitionBy("column").orderBy("d")  # one row a weekday, so five rows are five weekdays
    return liquidity.warnings(pillars, context, tga.select("d", series.change(F.col("value"), w, 5).alias("tga_5d")))


@query
def liquidity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_liquidity(spark, sf_dir)[2].select("d", "reserves_t", "tga_b", "sofr_iorb_bps", "nfci", "move", "hy_spread"))


@query
def liquidity_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warnings(spark, sf_dir)


@query
def liquidity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pillars, _ = _liquidity(spark, sf_dir)
    sides = liquidity.supports_and_drags(base._components(spark, sf_dir))
    return liquidity.summary_rows(base.liquidity_state(spark, sf_dir).withColumn("d", F.col("d").cast("date")), pillars, sides, _warnings(spark, sf_dir))


@query
def liquidity_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quadrant(_liquidity(spark, sf_dir)[1])


@query
def raw_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.appendix_rows(base._snapshot(spark, sf_dir), base._events(spark, sf_dir))


@query
def overview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [q(spark, sf_dir) for q in (base.macro_score, base.micro_score, base.regime_label, base.environment_composite, base.liquidity_state)]
    return reports.overview_rows(*parts)


@query
def degraded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays on which the most urgent orders give no metric."""
    snapshots = base._snapshot(spark, sf_dir).where("scope = 'MACRO'")
    return reports.degraded_days(base._calendar(spark, sf_dir), snapshots)


@query
def metadata_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source date that each row is stamped with; the times of the run are not compared."""
    orders, _ = base._daily(spark, sf_dir)
    given = orders.withColumn("source_date", F.when(F.col("n") % 2 == 0, "given"))
    return clean.stamped(given).select("d", "source_date", F.col("ingested_at").isNotNull().alias("ingested"))


@query
def short_volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pipe-delimited files, written and read again."""
    rows = inputs.bars(spark, sf_dir).select(F.date_format("d", "yyyyMMdd").alias("Date"), F.col("symbol").alias("Symbol"), (F.col("volume") % 37).alias("ShortVolume"), F.lit(0).alias("ShortExemptVolume"), F.col("volume").alias("TotalVolume"), F.lit("B").alias("Market"))
    folder = folders.fresh(spark, "short_volume")
    rows.write.option("header", "true").option("sep", "|").csv(folder)
    return rounded(readers.short_volume(spark, folder))


def _document(rows: DataFrame, field: str, item: Column) -> DataFrame:
    """One document a year with its items in one array."""
    return rows.groupBy(F.year("d").alias("y")).agg(F.array_sort(F.collect_list(item)).alias(field)).select(field)


@query
def observations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, folder = base._macro_wide(spark, sf_dir), folders.fresh(spark, "observations")
    item = F.struct(F.col("d").cast("string").alias("date"), F.when(F.dayofmonth("d") == 5, ".").otherwise(F.col("vix").cast("decimal(18,4)").cast("string")).alias("value"))
    _document(wide, "observations", item).write.option("maxRecordsPerFile", 1).json(folder)
    rows = readers.observations_json(spark, folder, "vix")
    return rounded(rows.withColumn("source_date", F.col("source_date").cast("string")))


@query
def treasury_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, folder = base._macro_wide(spark, sf_dir), folders.fresh(spark, "treasury")
    text = F.col("vix").cast("decimal(18,4)").cast("string")
    item = F.struct(F.col("d").cast("string").alias("record_date"), F.when(F.dayofmonth("d") < 20, text).otherwise("null").alias("close_today_bal"), F.when(F.dayofmonth("d") < 28, text).alias("open_today_bal"))
    _document(wide, "data", item).write.option("maxRecordsPerFile", 1).json(folder)
    return rounded(readers.treasury_json(spark, folder))


@query
def rates_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, folder = base._macro_wide(spark, sf_dir), folders.fresh(spark, "rates")
    item = F.struct(F.col("d").cast("string").alias("effectiveDate"), F.col("trin").alias("percentRate"), (F.col("trin") + 0.5).alias("percentPercentile75"), F.when(F.dayofmonth("d") > 3, F.col("trin") + 1).alias("percentPercentile99"), F.col("vix").alias("volumeInBillions"))
    _document(wide, "refRates", item).write.option("maxRecordsPerFile", 1).json(folder)
    return rounded(readers.rates_json(spark, folder))


@query
def dix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, folder = base._macro_wide(spark, sf_dir), folders.fresh(spark, "dix")
    wide.select(F.col("d").cast("string").alias("date"), F.lit("1").alias("price"), F.when(F.dayofmonth("d") == 9, "-").otherwise((F.col("trin") / 8).cast("string")).alias("dix"), F.format_number(F.col("vix") * 1e9, 0).alias("gex")).write.option("header", "true").csv(folder)
    return rounded(readers.dix_csv(spark, folder))


@query
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of a JSON document column."""
    props = F.from_json("props", "k long")
    return inputs.table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


STORED = "d date, scope string, metric string, value double, session string, is_final boolean"


def _stored(spark: SparkSession, sf_dir: str, session: str, share: int) -> DataFrame:
    facts = inputs.metric_facts(spark, sf_dir)
    return facts.select(F.trunc("d", "year").alias("d"), "scope", F.concat_ws("/", "metric", F.date_format("d", "MMdd")).alias("metric"), (F.col("value") + share).alias("value"), F.lit(session).alias("session"), (F.dayofyear("d") % 5 == 0).alias("is_final"))


@query
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by year: rows are written, some of them replaced by key, others added; keys hold the session."""
    folder, keys = folders.fresh(spark, "upserted"), ["d", "scope", "metric", "session"]
    first = _stored(spark, sf_dir, "PRE", 0)
    done = [sinks.retried(lambda rows=rows: sinks.upsert(rows, sinks.stored(spark, folder, STORED), keys, folder, "d")) for rows in (first, _stored(spark, sf_dir, "PRE", 1).where("scope <> 'MACRO'"), _stored(spark, sf_dir, "POST", 2).where("scope = 'MACRO'"))]
    if not all(done):
        raise RuntimeError("a batch was not written")
    return rounded(sinks.stored(spark, folder, STORED).groupBy("d", "scope", "session").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("total")))


@query
def finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final rows stay as they are when a later batch brings their keys again."""
    folder, keys = folders.fresh(spark, "finalised"), ["d", "scope", "metric", "session"]
    write = streams.finalise(folder, STORED, keys)
    for batch, share in enumerate((0, 5)):
        write(_stored(spark, sf_dir, "EOD", share), batch)
    return rounded(sinks.stored(spark, folder, STORED).groupBy("d", "is_final").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("total")))


@query
def synced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's rows become exactly the active ones; other years stay."""
    folder = folders.fresh(spark, "synced")
    sinks.sync_day(_stored(spark, sf_dir, "PRE", 0), folder, "d")
    active = _stored(spark, sf_dir, "PRE", 7).where("d = '1997-01-01' and is_final")
    sinks.sync_day(active, folder, "d")
    return sinks.stored(spark, folder, STORED).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("total"))


@query
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a log, one after the other."""
    folder = folders.fresh(spark, "appended")
    for _ in range(2):
        sinks.append(base._daily(spark, sf_dir)[0].select("d", "n"), folder)
    return spark.read.parquet(folder).groupBy("d").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


@query
def replaced_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited history in which later rows replace whole dates."""
    orders, ships = base._daily(spark, sf_dir)
    folder = folders.fresh(spark, "replaced")
    sinks.write_csv(sinks.replace_dates(ships.select("d", "n").where("n > 5"), orders.select("d", "n")), folder)
    return spark.read.csv(folder, header=True, schema="d date, n long")


@query
def rolling_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 dates of a cache after new rows."""
    orders, ships = base._daily(spark, sf_dir)
    return sinks.rolling_cache(orders.select("d", "n"), ships.select("d", "n"))


@query
def stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events that a day's active set no longer has."""
    keys, events = ["d", "scope", "metric", "window_scope", "layer"], base._events(spark, sf_dir)
    active = anomaly.gate(events.unionByName(base._resonance(spark, sf_dir)))
    return events.select(*keys).join(active.select(*keys), keys, "left_anti")


@query
def day_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of a table partitioned by report_date, one session, all scopes but one."""
    folder = folders.fresh(spark, "days")
    rows = inputs.metric_facts(spark, sf_dir).select(F.trunc("d", "month").alias("report_date"), "scope", "metric", "value", F.when(F.dayofmonth("d") < 15, "PRE").otherwise("POST").alias("session"))
    sinks.replace_partitions(rows, folder, "report_date")
    table = spark.read.schema("scope string, metric string, value double, session string, report_date date").parquet(folder)
    return rounded(readers.day_rows(table, "1997-03-01", "PRE", "MACRO").withColumn("report_date", F.col("report_date").cast("string")))


@query
def stream_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream into a table by day, one row an event type; the batch writer is idempotent."""
    folder, schema, keys = folders.fresh(spark, "stream_finalised"), "d date, event_type string, n long, is_final boolean", ["d", "event_type"]
    write = streams.finalise(f"{folder}/table", schema, keys)

    def batch(rows: DataFrame, i: int) -> None:
        write(rows.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).withColumn("is_final", F.lit(True)), i)

    events = streams.stream(spark, f"{sf_dir}/events*.parquet", files_per_trigger=1 << 30)
    streams.each_batch(events, batch, f"{folder}/state").awaitTermination()
    return sinks.stored(spark, f"{folder}/table", schema).select("d", "event_type", "n")
