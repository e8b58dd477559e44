"""Registered queries of the exchange calendar, of replayed snapshots and of live feeds; twins in ``session_oracles``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries as base
from .functions import documents
from .market_queries import NOISE, QUERIES, _probe_rows, _raw_texts, log_lines
from .operators import calendar, environment, replay, reports, segments
from .plans import inputs, specs
from .queries import query, rounded
from .sources import folders, layout, live, sinks
from .streaming import logs, scan

__all__ = ["QUERIES"]


@query
def exchange_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions from the first to the last order's day."""
    return base._sessions(spark, sf_dir)


@query
def session_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ship day's sessions before and after it; those 1 and 21 sessions back. Ship days reach beyond the calendar of order days."""
    ships = inputs.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"))
    found = calendar.neighbours(ships, base._sessions(spark, sf_dir), "d", {"back_1": 1, "back_21": 21})
    return found.withColumns({c: F.col(c).cast("string") for c in ("previous", "next", "back_1", "back_21")})


def mixed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts, and two slower series a scope: ``nfci``, the week's last credit_z, and ``dxy``, the month's last move."""
    facts = inputs.metric_facts(spark, sf_dir)
    slower = []
    for metric, of, unit in (("nfci", "credit_z", "week"), ("dxy", "move", "month")):
        last = F.max_by(F.struct("d", "value"), "d").alias("r")
        slower.append(facts.where(F.col("metric") == of).groupBy("scope", F.trunc("d", unit).alias("_unit")).agg(last).select("scope", F.lit(metric).alias("metric"), "r.d", "r.value"))
    return facts.union(slower[0]).union(slower[1])


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(mixed_series(spark, sf_dir), base._sessions(spark, sf_dir))


@query
def replayed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replayed(spark, sf_dir)
    return rounded(rows.withColumns({c: F.col(c).cast("string") for c in ("report_date", "source_date")}))


@query
def replayed_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By series: sessions, filled ones among them, observations seen, and the longest lag."""
    rows = _replayed(spark, sf_dir)
    return rows.groupBy("scope", "metric").agg(F.count("*").alias("sessions"), F.count_if("is_filled").alias("filled"), F.max("effective_obs").alias("observations"), F.max("lag_days").alias("longest_lag"))


#: Records of one page of the stand-in feeds.
PAGE = 200


def _paged(rows: DataFrame, folder: str, record: Column, total: int) -> None:
    """``rows`` (n from 1, d, ...) as pages of a feed: a folder each, one document in it."""
    paged = rows.select(F.floor((F.col("n") - 1) / PAGE).cast("int").alias("at"), "n", record.alias("record"))
    documents = paged.groupBy((F.col("at") + 1).alias("page")).agg(F.sort_array(F.collect_list(F.struct("n", "record"))).alias("held"))  # PAGE records
    documents.select("page", F.struct(F.lit(-(-total // PAGE)).alias("pages")).alias("meta"), F.col("held.record").alias("data")).write.partitionBy("page").json(folder)


@query
def live_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paged feeds of order days, one with holes, read from 1995-06-01 on: the last usable value of each field and day."""
    days = inputs.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n_orders"), F.round(F.max("o_totalprice")).cast("long").alias("most"))
    rows = days.withColumn("n", F.row_number().over(Window.orderBy("d")))  # one row a day
    total, folder = rows.count(), folders.fresh(spark, "feeds")
    text = F.col("d").cast("string").alias("record_date")
    _paged(rows, f"{folder}/a", F.struct(text, F.col("n_orders").cast("string").alias("n"), F.when(F.dayofmonth("d") % 3 == 0, ".").otherwise(F.format_number("most", 0)).alias("close"), F.col("most").cast("string").alias("open")), total)
    _paged(rows, f"{folder}/b", F.struct(text, F.when(F.dayofmonth("d") == 5, "n/a").otherwise(F.col("n_orders").cast("string")).alias("n")), total)
    uri = folder if "://" in folder else f"file://{folder}"
    feeds = [
        live.Feed("a", f"{uri}/a/page={{page}}", "data", {"orders": ["n"], "most": ["close", "open"]}, "record_date", pages="meta.pages"),
        live.Feed("b", f"{uri}/b/page={{page}}", "data", {"orders": ["n"]}, "record_date", scale=0.5, pages="meta.pages"),
    ]
    return live.latest(live.observations(spark, feeds).where("d >= date '1995-06-01'"))


@query
def live_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of ship days that is whole, and one of which no page is there."""
    days = inputs.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("lines"))
    rows = days.withColumn("n", F.row_number().over(Window.orderBy("d")))  # one row a day
    total, folder = rows.count(), folders.fresh(spark, "feeds")
    _paged(rows, f"{folder}/ships", F.struct(F.col("d").cast("string").alias("date"), "lines"), total)
    uri = folder if "://" in folder else f"file://{folder}"
    feeds = [live.Feed(name, f"{uri}/{name}/page={{page}}", "data", {"lines": ["lines"]}, pages="meta.pages") for name in ("ships", "gone")]
    return live.health(live.observations(spark, feeds, status=True)).select("source", "status", "rows", F.col("error").isNotNull().alias("told"))


@query
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of ``todays_log``, grown in five steps and followed as a stream, a step a batch."""
    lines, today = log_lines(spark, sf_dir)
    folder = folders.fresh(spark, "log_tail")
    cuts = lines.approxQuantile("n", [0.2, 0.4, 0.6, 0.8], 0.01)
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
        lines.where((F.col("n") > low) & (F.col("n") <= high)).coalesce(1).write.mode("append").json(f"{folder}/lines")
    grown = spark.readStream.schema(logs.LINES).option("maxFilesPerTrigger", 1).json(f"{folder}/lines")
    return logs.appended(logs.tail(grown, today, NOISE), folder)


@query
def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every day's run, quiet days included."""
    events = base._events(spark, sf_dir).unionByName(base._resonance(spark, sf_dir))
    return reports.event_matrix(events, inputs.metric_facts(spark, sf_dir))


@query
def environment_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = environment.index_scores(base._environment_days(spark, sf_dir))
    return reports.environment_panels(scores, environment.composite(scores), sorted({i for i, *_ in specs.ENVIRONMENT}))


@query
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the events' properties, by type of event."""
    events = inputs.table(spark, sf_dir, "events").select("event_type", documents.document(F.col("props")).alias("doc")).where("doc is not null")
    return documents.fields(events, "doc", ["event_type"])


@query
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a day whose fields drift: some are missing on some days, some are texts, some days have no document.

    Columns that the table has itself, and source dates nested by native names.
    """
    wide, day = base._macro_wide(spark, sf_dir), F.dayofmonth("d")
    dates = F.struct(F.date_sub("d", 1).cast("string").alias("VIX"), F.when(day % 3 > 0, F.date_sub("d", 7).cast("string")).alias("MOVE"), F.lit("soon").alias("TRIN"))
    full = F.to_json(F.struct(F.col("vix").alias("vix_num"), F.when(day % 2 == 0, F.col("move")).alias("move"), F.col("credit_z").cast("decimal(18,4)").cast("string").alias("credit_z"), F.lit("top").alias("trin"), F.struct(F.lit(1).alias("deep")).alias("pct_200ma"), dates.alias("dates")))
    text = F.when(day == 9, "not json").when(day == 10, "[1, 2]").otherwise(full)
    rows = wide.select("d", F.when(day < 20, F.col("move")).alias("move"), F.col("trin").alias("own"), documents.document(text).alias("doc"))
    got = documents.expanded(rows, "doc", {"vix": "$.vix_num", "move": "$.move", "credit_z": "$.credit_z", "trin": "$.trin", "pct_200ma": "$.pct_200ma", "gone": "$.gone.deeper"})
    got = documents.source_dated(got, "doc", "dates", {"vix": "VIX", "move": "MOVE", "trin": "TRIN", "absent": "VIX"}, {"credit_z": ["vix", "move"], "own": ["vix", "absent"]}).drop("doc")
    return rounded(got.withColumns({c: F.col(c).cast("string") for c in got.columns if c.endswith("_source_date")}))


@query
def ticker_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _probe_rows(spark, sf_dir), F.col("dpsv")
    return reports.ticker_details(rows.withColumns({"reference": F.when(k % 2 == 0, F.col("price") + 1), "source": F.when(k % 4 == 0, "mid"), "prev_close": F.when(k % 3 > 0, F.col("price") - 1)}))


@query
def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after three loads: raw texts as they are, with an allowance, and none of them."""
    rows, folder = _raw_texts(spark, sf_dir), folders.fresh(spark, "ledger")
    for job, part, most in (("raw", rows, 0.0), ("allowed", rows, 1.0), ("none", rows.where("p_partkey < 0"), 0.0)):
        sinks.recorded(part, lambda df, job=job: df.write.parquet(f"{folder}/{job}"), f"{folder}/log", job, "2024-01-02", ["text", "size", "price"], most)
    ledger = spark.read.schema(sinks.LEDGER).parquet(f"{folder}/log")
    return ledger.select("job", F.col("report_date").cast("string").alias("report_date"), "rows", *(F.col("missing")[c].alias(f"no_{c}") for c in ("text", "size", "price")), "status", F.col("recorded_at").isNotNull().alias("recorded"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as quotes: each is a trade in the market of its type, and a reading of an index; the day's view of each market."""
    c = F.col
    events = inputs.table(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    names = F.array(*(F.lit(n) for n in ("tick", "trin", "up", "down")))
    size = F.when(c("event_id") % 4 == 0, c("value") * 20 - 800).when(c("event_id") % 4 == 1, c("value") / 20).otherwise(c("value"))
    trade = F.struct(F.lit("price").alias("name"), c("value").alias("value"), (c("user_id") % 100 + 1).alias("volume"))
    reading = F.struct(names[(c("event_id") % 4).cast("int")].alias("name"), size.alias("value"), F.lit(None).cast("long").alias("volume"))
    quotes = events.select("ts", c("event_type").alias("market"), F.explode(F.array(trade, reading)).alias("q")).select("ts", "market", "q.*")
    days = events.groupBy(c("event_type").alias("market"), F.to_date("ts").alias("d")).agg(F.max("value").alias("most"), F.count("*").alias("n"))
    return quotes, days.select("market", "d", (c("most") / 2).alias("prev_close"), ((c("n") % 10) / 20 + 0.4).alias("expected_move"), (c("most") / 3).alias("flip"))


@query
def stream_intraday_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all markets as a stream in two batches, up to half an hour out of order; rows without a value close the last steps."""
    quotes, context = _quotes(spark, sf_dir)
    folder, c = folders.fresh(spark, "scan"), F.col
    came = F.unix_seconds("ts") + F.pmod(F.xxhash64("ts", "market"), F.lit(1800))
    first, last = quotes.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    early = came < (first + last) / 2
    end = quotes.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts"))
    closing = end.select("ts", F.lit("none").alias("market"), F.explode(F.array(F.lit("price"), F.lit("tick"))).alias("name"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("volume"))
    for part in (quotes.where(early), quotes.where(~early).unionByName(closing)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/quotes")
    grown = spark.readStream.schema(scan.QUOTES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/quotes")
    rows = scan.emitted(scan.scan(grown, context), folder)
    return rounded(rows, 9).withColumn("ts", c("ts").cast("timestamp_ntz"))


#: Rows of a segment of the ticks below: few enough that small tables are cut too.
SEGMENT = 1000


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series a type: price in cents."""
    c = F.col
    return inputs.table(spark, sf_dir, "events").select("event_type", c("ts").cast("timestamp").alias("ts"), "event_id", F.round(c("value") * 100).cast("long").alias("close"), (c("user_id") % 100 + 1).alias("volume"))


_TICK_ORDER = ["ts", "event_id"]


@query
def segmented_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event, how many of its type in a row were below 40."""
    rows = segments.cut(_ticks(spark, sf_dir), ["event_type"], _TICK_ORDER, SEGMENT)
    return segments.joined(segments.run_length(rows, ["event_type"], _TICK_ORDER, F.col("close") < 4000, "run")).select("event_id", "run")


@query
def segmented_obv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.obv(_ticks(spark, sf_dir), ["event_type"], _TICK_ORDER, SEGMENT).select("event_id", "obv")


@query
def segmented_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last one over 100 of its type at or before it."""
    ticks = _ticks(spark, sf_dir)
    spine = ticks.select("event_id", "event_type", "ts")
    found = segments.asof(spine, ticks.where("close > 10000"), ["event_type"], value="close", most=SEGMENT)
    return found.select("event_id", F.col("value").alias("close"), (F.unix_micros("ts") - F.unix_micros("source_date")).alias("age"))


@query
def unified_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified view over two tables laid out by ticker and day: some days lack one side, one column both have."""
    c, bars, keys = F.col, inputs.bars(spark, sf_dir), ["d", "ticker"]
    rows = bars.withColumnRenamed("symbol", "ticker")
    pre = rows.where("volume % 3 > 0").select("d", "ticker", (c("open") / 100).alias("current_price"), (c("high") / 100).alias("call_wall"), (c("low") / 100).alias("put_wall"), c("low").alias("poc_price"), F.date_sub("d", 1).alias("source_date"))
    post = rows.where("volume % 4 > 0").select("d", "ticker", (c("close") / 100).alias("current_price"), ((c("high") + c("low")) / 200).alias("poc_price"), (c("volume") % 40).alias("ivr_pct"), c("d").alias("source_date"))
    name, folder = f"unified_{uuid.uuid4().hex}", folders.fresh(spark, "unified")
    tables = [layout.write(df, f"{name}_{part}", keys, 16, f"{folder}/{part}", ["current_price"]) for part, df in (("pre", pre), ("post", post))]
    layout.unified_view(*tables, name, keys, f"{name}_pre", f"{name}_post")
    return spark.table(name)
