"""The engine's registered queries over the driver's tables; their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pricing, series
from .operators import align, anomaly, bars, calendar, environment, liquidity, options, probes, reports
from .plans import inputs
from .sources import folders
from .streaming import market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: column of the liquidity model: (scope, metric) of the facts that stand in for it.
LIQUIDITY_INPUTS = {
    "net_liq_b": ("2-HIGH", "vix"), "reserves_t": ("2-HIGH", "trin"), "tga_b": ("3-MEDIUM", "vix"), "fed_assets_b": ("3-MEDIUM", "move"), "sofr_iorb_bps": ("4-NOT SPECIFIED", "trin"),
    "nfci": ("4-NOT SPECIFIED", "vix_contango_pct"), "move": ("MACRO", "move"), "hy_spread": ("MACRO", "credit_z"), "hyg_tlt_ratio": ("5-LOW", "vix"), "pct_20ma": ("5-LOW", "pct_200ma"), "vvix": ("MACRO", "vix"),
}
#: metric of the environment model: (MACRO or not, metric) of the facts that stand in for it.
ENVIRONMENT_INPUTS = [("vix", True, "vix"), ("move", True, "move"), ("vix_contango_pct", True, "vix_contango_pct"), ("pct_200ma", True, "pct_200ma"), ("trin", True, "trin"), ("credit_spread", True, "credit_z"), ("nfci", True, "credit_z"), ("ivr_pct", False, "vix"), ("expected_move_pct", False, "move")]
#: input of the resonance themes: (scope, metric) of the facts that stand in for it; of the ratio its change over 20 rows.
RESONANCE_INPUTS = {
    "vix_contango_pct": ("MACRO", "vix_contango_pct"), "move": ("MACRO", "move"), "pct_200ma": ("MACRO", "pct_200ma"), "credit_z": ("MACRO", "credit_z"), "trin": ("MACRO", "trin"),
    "hyg_tlt_ratio_roc": ("5-LOW", "vix"), "vrp_num": ("2-HIGH", "vix"), "pct_20ma": ("2-HIGH", "trin"), "breadth_diff_pct": ("3-MEDIUM", "trin"), "ivr_low": ("4-NOT SPECIFIED", "trin"),
}
#: The symbol that others are measured against.
BENCHMARK = "Brand#11"


def query(f: Query) -> Query:
    """Registers a query; its dates are given as ISO text, which every client reads alike."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _series(spark: SparkSession, sf_dir: str):
    return inputs.metric_facts(spark, sf_dir), Window.partitionBy("scope", "metric").orderBy("d")


@query
def zscore_252(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    return rounded(series.rolling_stats(facts.withColumn("n", series.count_so_far(w)), ["scope", "metric"]).select("scope", "metric", "d", "z"))


@query
def percentile_252(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    return rounded(series.rolling_stats(facts.withColumn("n", series.count_so_far(w)), ["scope", "metric"]).select("scope", "metric", "d", "pct"))


@query
def window_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    return rounded(facts.select("scope", "metric", "d", *(series.change(F.col("value"), w, k).alias(f"chg_{k}d") for k in (1, 5, 21, 63))))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.snapshot(inputs.metric_facts(spark, sf_dir))


@query
def metric_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_snapshot(spark, sf_dir).select("scope", "metric", "d", "value", "n", "z", "pct", "chg_1d", "chg_5d", "chg_21d", "chg_63d", "severity"))


@query
def days_in_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select("scope", "metric", "d", "days_in_risk")


@query
def distance_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_snapshot(spark, sf_dir).select("scope", "metric", "d", "dist_to_thr"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.single_and_multiwindow(_snapshot(spark, sf_dir))


@query
def anomaly_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir).where("layer = 'single'").select("d", "scope", "metric", "value", "window_scope", "severity", "confidence", "direction"))


@query
def anomaly_multiwindow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir).where("layer = 'multiwindow'").select("d", "scope", "metric", "value", "window_scope", "severity", "confidence", "direction"))


def _resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    names = F.create_map(*(F.lit(x) for name, (scope, metric) in RESONANCE_INPUTS.items() for x in (f"{scope}/{metric}", name)))
    moved = series.pct_change(F.col("value"), w, 20)
    named = facts.withColumn("value", F.when((F.col("scope") == "5-LOW") & (F.col("metric") == "vix"), moved).otherwise(F.col("value")))
    return anomaly.resonance(named.select("d", F.try_element_at(names, F.concat_ws("/", "scope", "metric")).alias("input"), "value").where("input is not null"))


@query
def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_resonance(spark, sf_dir).select("d", "resonance_key", "severity", "confidence"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.gate(_events(spark, sf_dir).unionByName(_resonance(spark, sf_dir)))


@query
def alert_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_alerts(spark, sf_dir).select("d", "metric", "scope", "window_scope", "layer", "severity", "confidence", "resonance_key"))


@query
def alert_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.fingerprints(_alerts(spark, sf_dir))


@query
def alert_cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.cluster_names(_events(spark, sf_dir))


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of all facts; each order is in a fact of its day."""
    return inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays from the first to the last fact."""
    return align.observed_weekdays(_order_days(spark, sf_dir))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the exchange from the first to the last fact."""
    return calendar.observed_sessions(_order_days(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.metric_facts(spark, sf_dir)
    return align.asof(_calendar(spark, sf_dir), facts, ["scope", "metric"])


@query
def asof_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)


@query
def effective_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.effective_observations(_aligned(spark, sf_dir), ["scope", "metric"]).select("scope", "metric", "d", "effective_obs")


@query
def weekday_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("scope", "metric", "d", align.weekday_lag(F.col("source_date"), F.col("d")).alias("lag_days"))


@query
def session_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the exchange between a weekday and the observation that it shows."""
    rows = _aligned(spark, sf_dir).where("source_date is not null").select("scope", "metric", "d", "source_date")
    return calendar.lag_days(rows, _sessions(spark, sf_dir), "source_date", "d").select("scope", "metric", "d", "lag_days")


@query
def five_day_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.metric_facts(spark, sf_dir).where("weekday(d) < 5")
    rows = align.offset_value(facts, _calendar(spark, sf_dir), ["scope", "metric"], 5)
    return rounded(rows.select("scope", "metric", "d", (F.col("value") - F.col("base")).alias("change")))


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = inputs.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("price"))
    ships = inputs.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("ship_price"))
    return orders, ships


@query
def unified_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unified(*_daily(spark, sf_dir), ["d"])


@query
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, ships = _daily(spark, sf_dir)
    return align.priority_merge(ships.select("d", "n"), orders.select("d", "n"), ["d"], ["n"])


@query
def finalized_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, ships = _daily(spark, sf_dir)
    return align.unless_final(orders, ships.select("d", (F.col("n") > 20).alias("is_final")), ["d"])


@query
def alerted_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, ships = _daily(spark, sf_dir)
    return align.already_sent(orders, ships, ["d"])


def _environment_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshot(spark, sf_dir)
    names = F.array(*(F.struct(F.lit(name).alias("as"), F.lit(macro).alias("macro"), F.lit(own).alias("own")) for name, macro, own in ENVIRONMENT_INPUTS))
    named = snapshots.withColumn("x", F.explode(F.filter(names, lambda x: (x["own"] == F.col("metric")) & (x["macro"] == (F.col("scope") == "MACRO")))))
    return named.select("d", F.col("x.as").alias("metric"), "scope", F.col("pct").alias("percentile"), F.col("n").alias("effective_obs"), F.col("n").alias("sample_len"), "lag_days")


@query
def environment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return environment.index_scores(_environment_days(spark, sf_dir))


@query
def environment_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return environment.composite(environment_scores(spark, sf_dir))


@query
def environment_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return environment.state(environment_scores(spark, sf_dir), _resonance(spark, sf_dir))


def _liquidity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for column, (scope, metric) in LIQUIDITY_INPUTS.items() for x in (f"{scope}/{metric}", column)))
    facts = inputs.metric_facts(spark, sf_dir).withColumn("column", F.try_element_at(names, F.concat_ws("/", "scope", "metric"))).where("column is not null")
    return align.asof(_calendar(spark, sf_dir), facts.select("column", "d", "value"), ["column"])


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.component_scores(_liquidity_facts(spark, sf_dir))


@query
def liquidity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select("d", "component", "score", "quality", "observations", "lag_days")


@query
def liquidity_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.pillar_scores(_components(spark, sf_dir))


@query
def liquidity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _liquidity_facts(spark, sf_dir).select("d", "column", "value")
    return liquidity.waterline(liquidity.pillar_scores(_components(spark, sf_dir)), latest)


@query
def supports_drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liquidity.supports_and_drags(_components(spark, sf_dir))


@query
def poc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.point_of_control(inputs.bars(spark, sf_dir)))


@query
def poc_profile_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on prices with decimals."""
    return rounded(bars.point_of_control(inputs.bars(spark, sf_dir).withColumn("close", F.col("close") / 100.0)))


@query
def obv_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.obv(inputs.bars(spark, sf_dir))


@query
def vwap_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.vwap(inputs.bars(spark, sf_dir), ["symbol"]))


@query
def cmf21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.money_flow(inputs.bars(spark, sf_dir)))


@query
def hv20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.realised_volatility(inputs.bars(spark, sf_dir)))


@query
def hv20_vrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIX less the benchmark's volatility, on the days that have both series."""
    vix = inputs.metric_facts(spark, sf_dir).where("scope = 'MACRO' and metric = 'vix'").select("d", F.col("value").alias("vix"))
    hv = bars.realised_volatility(inputs.bars(spark, sf_dir).where(F.col("symbol") == BENCHMARK)).select("d", "hv")
    return rounded(vix.join(hv, "d").withColumn("vrp", F.col("vix") - F.col("hv")))


@query
def ivr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.value_rank(inputs.bars(spark, sf_dir), "symbol", "close"))


@query
def leverage_drag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the benchmark with each other symbol, their closes raised to move by a few percent a day."""
    others = inputs.table(spark, sf_dir, "part").select(F.col("p_brand").alias("geared")).distinct()
    pairs = others.where(F.col("geared") != BENCHMARK).withColumn("base", F.lit(BENCHMARK))
    return rounded(bars.leverage_drags(inputs.bars(spark, sf_dir).withColumn("close", F.col("close") + 100_000_000), pairs), 2)


@query
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.relative_strength(inputs.bars(spark, sf_dir), "Brand#11"))


@query
def returns_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.returns(inputs.bars(spark, sf_dir)))


@query
def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = bars.returns(inputs.bars(spark, sf_dir), (1,))
    return rounded(bars.group_spread(returns, ["Brand#12", "Brand#13", "Brand#21"], "Brand#11"))


@query
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.momentum(inputs.bars(spark, sf_dir)))


@query
def prior_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.prior_low(inputs.bars(spark, sf_dir))


@query
def breadth_trin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.breadth(inputs.bars(spark, sf_dir)))


@query
def breadth_thrust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.breadth_thrust(bars.breadth(inputs.bars(spark, sf_dir)))


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("p_retailprice") * 100).cast("long"))
    return inputs.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg((F.floor(cents / F.count("*")) / 100).alias("spot"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.contracts(inputs.chain(spark, sf_dir), _spots(spark, sf_dir))


@query
def gamma_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = options.gamma_curve(_held(spark, sf_dir))
    return curve.select("ticker", "bucket", "i", F.round("level", 6).alias("level"), F.round("exposure", 4).alias("exposure"))


@query
def gamma_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(options.gamma_buckets(_held(spark, sf_dir)))


@query
def gamma_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(options.primary_flip(options.zero_points(options.gamma_curve(_held(spark, sf_dir))), _spots(spark, sf_dir)), 3)


@query
def gamma_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir)
    return options.pin_state(options.walls(held), options.gamma_buckets(held))


@query
def max_oi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(options.max_open_interest(inputs.chain(spark, sf_dir), _spots(spark, sf_dir)))


@query
def pcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(options.put_call_ratio(inputs.chain(spark, sf_dir)))


@query
def expected_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(options.expected_move(inputs.chain(spark, sf_dir), _spots(spark, sf_dir)))


@query
def vanna_charm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vanna, charm = pricing.vanna_charm(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv"))
    return rounded(_held(spark, sf_dir).groupBy("ticker").agg(F.sum(vanna * F.col("oi")).alias("vanna"), F.sum(charm * F.col("oi")).alias("charm")), 2)


@query
def nearest_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.nearest_strikes(inputs.chain(spark, sf_dir), _spots(spark, sf_dir))


@query
def expiration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.sample_expirations(inputs.chain(spark, sf_dir))


@query
def top5_unusual(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = inputs.chain(spark, sf_dir).withColumns({"volume": F.col("oi") * 10 * (F.col("strike").cast("int") % 7), "oi": F.col("oi") * 10})
    return rounded(options.unusual_volume(trades).select("ticker", "dte", "strike", "cp", "ratio", "place"))


@query
def bs_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = pricing.price(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv"), F.col("cp"))
    return rounded(_held(spark, sf_dir).groupBy("ticker", "cp").agg(F.sum(value).alias("premium"), F.max(value).alias("most")), 3)


@query
def delta_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(options.delta_skew(_held(spark, sf_dir)))


@query
def implied_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("spot", "strike", "years", "iv", "cp")]
    held = _held(spark, sf_dir).withColumn("premium", pricing.price(*c))
    solved = pricing.implied_volatility(F.col("premium"), F.col("spot"), F.col("strike"), F.col("years"), F.col("cp"))
    return rounded(held.select("ticker", "dte", "strike", "cp", "iv", solved.alias("implied")), 3)


def _macro_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.metric_facts(spark, sf_dir).where("scope = 'MACRO'")
    return facts.groupBy("d").pivot("metric", ["vix", "move", "vix_contango_pct", "pct_200ma", "credit_z", "trin"]).agg(F.first("value"))


@query
def macro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _macro_wide(spark, sf_dir).select(
        "d", (c("credit_z") - 1).alias("y10_z"), (c("move") - 95).alias("oil_roc"), (c("vix_contango_pct") - 4).alias("curve"), (c("trin") - 1).alias("curve_chg"),
        (c("pct_200ma") - 45).alias("netliq_roc"), (c("vix") - 19).alias("m2_yoy"), c("trin").alias("nfci"), "credit_z", (2 - c("trin") * 2).alias("cg_z"),
    )
    return probes.macro_score(rows)


@query
def micro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _macro_wide(spark, sf_dir).select("d", "vix", "move", c("credit_z").alias("credit"), "trin", (c("vix_contango_pct") - 4).alias("spy_ret"), (c("pct_200ma") / 40).alias("pcr"), (c("vix_contango_pct") / 20).alias("cmf"))
    return probes.micro_score(rows)


@query
def regime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _macro_wide(spark, sf_dir).select("d", c("vix_contango_pct").alias("y10"), (c("move") - 20).alias("oil"), c("vix").alias("cg"), (c("pct_200ma") + 40).alias("hyg"), c("pct_200ma").alias("breadth"))
    return probes.regime(rows)


@query
def vol_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _macro_wide(spark, sf_dir).select("d", c("vix_contango_pct").alias("contango"), c("trin").alias("breadth_gap"), (c("credit_z") - 3).alias("drag"))
    return probes.vol_probe(rows)


@query
def third_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", pricing.third_friday(F.col("d")).alias("expiry"))


def _events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, all that is there as one batch, so that no row comes late; a pattern, since a stream's source must not be a single file."""
    return market.stream(spark, f"{sf_dir}/events*.parquet", files_per_trigger=1 << 30)


@query
def stream_tick_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.drain(market.tick_mean(_events_table(spark, sf_dir)), ["start"], folders.fresh(spark, "tick_mean")), 9).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def stream_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.drain(market.session_vwap(_events_table(spark, sf_dir)), ["day", "event_type"], folders.fresh(spark, "session_vwap")))


@query
def stream_alert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.drain(market.alert_days(_events_table(spark, sf_dir)), ["day", "event_type"], folders.fresh(spark, "alert_days"))



@query
def rolling_z_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    return rounded(facts.select("scope", "metric", "d", series.rolling_z_or_zero(F.col("value"), w).alias("z")))


@query
def rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    return rounded(facts.select("scope", "metric", "d", *(series.pct_change(F.col("value"), w, k).alias(f"roc_{k}") for k in (20, 21, 62, 251))))


@query
def monthly_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve steps at the native monthly grain; sums are of whole ten-thousandths, so their order doesn't matter."""
    months = inputs.metric_facts(spark, sf_dir).groupBy("scope", "metric", F.trunc("d", "month").alias("d")).agg(F.sum(F.round(F.col("value") * 10000).cast("long")).alias("value"))
    return rounded(months.select("scope", "metric", "d", series.pct_change(F.col("value"), Window.partitionBy("scope", "metric").orderBy("d"), 12).alias("yoy")))


@query
def sma20(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("d")
    return rounded(inputs.bars(spark, sf_dir).select("symbol", "d", series.moving_average(F.col("close"), w, 20).alias("sma")))


@query
def sign_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, w = _series(spark, sf_dir)
    centred = F.col("value") - 4
    return facts.select("scope", "metric", "d", series.sign_flip(centred, w).alias("day"), series.sign_flip(centred, w, 5).alias("week"))


@query
def extreme_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series more than two deviations off, beyond 30 rows."""
    return rounded(_snapshot(spark, sf_dir).where("n > 30 and abs(z) > 2").select("scope", "metric", "d", "z"))


@query
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.metric_facts(spark, sf_dir)
    return facts.groupBy("scope", "metric").agg(F.max_by(F.struct("value", "d"), "d").alias("r")).select("scope", "metric", "r.value", "r.d")


@query
def weighted_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdings = inputs.bars(spark, sf_dir).select("symbol", "d", F.col("volume").alias("shares"), F.col("close").alias("price"))
    return rounded(bars.weighted_flow(holdings), 6)


@query
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_matrix(_snapshot(spark, sf_dir))


@query
def alert_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_bodies(_alerts(spark, sf_dir))


@query
def liquidity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.trend(liquidity_state(spark, sf_dir)))

