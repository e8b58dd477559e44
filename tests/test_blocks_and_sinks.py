"""Series in blocks, calendars at their ends, sinks, readers and streams on hand-made rows; the fixed values."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clean, series
from tidemark.operators import align, anomaly, bars, calendar, liquidity, market, options, reports
from tidemark.plans import specs
from tidemark.sources import readers, sinks
from tidemark.streaming import market as streams

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("block", [60, 1 << 13])
def test_blocks_give_what_windows_give(spark, inclusive, block, monkeypatch):
    """Series longer and shorter than a block, with nulls and stretches without spread."""
    monkeypatch.setattr(series, "BLOCK", block)
    r = random.Random(1)
    rows = [(k, i, None if i % 17 == 3 else 5.0 if i > n - 60 else round(r.random() * 9, 2)) for k, n in (("a", 400), ("b", 31), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    w = Window.partitionBy("k").orderBy("d")
    size = 50
    numbered = df.withColumn("n", F.row_number().over(w))
    got = {(x.k, x.d): x for x in series.rolling_stats(numbered, ["k"], size, 10, "v", inclusive).collect()}
    want = df.select("k", "d", "v", series.zscore(F.col("v"), w, size, 10).alias("z"), series.percentile(F.col("v"), w, size, 10, inclusive).alias("pct")).collect()
    assert len(got) == len(want)
    for x in want:
        g = got[x.k, x.d]
        if x.v is None:
            assert g.z is None and g.pct is None
        else:
            assert (g.pct is None) == (x.pct is None) and (g.pct is None or math.isclose(g.pct, x.pct, rel_tol=1e-12))
            assert (g.z is None) == (x.z is None) and (g.z is None or math.isclose(g.z, x.z, rel_tol=1e-9, abs_tol=1e-12))


def test_blocks_of_nothing(spark):
    assert series.rolling_stats(spark.createDataFrame([], "k string, n int, value double"), ["k"]).count() == 0


def test_session_lag_beyond_the_calendar(spark):
    days = calendar.session_days(spark, "2024-01-01", "2024-01-12", holidays=[], closures=spark.createDataFrame([("2024-01-03",)], "d string").selectExpr("date(d) d"))
    pairs = [("2024-01-01", "2024-01-05", 3), ("2023-12-20", "2024-01-02", 1), ("2024-01-10", "2024-02-01", 2), ("2024-02-01", "2024-02-02", 0), ("2023-12-01", "2023-12-02", 0), ("2024-01-05", "2024-01-02", 0), ("2024-01-06", "2024-01-08", 0), (None, "2024-01-02", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    got = {r.i: r.lag_days for r in calendar.lag_days(df, days, "a", "b").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pairs)}


def test_values_so_many_weekdays_back(spark):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(i), float(i)) for i in range(20)], "k string, d date, value double")
    for day, back in [(4, 0), (6, 1), (7, 1), (5, 5), (8, 5), (12, 7), (13, 3), (15, 8), (1, 4)]:
        want = (pd.Timestamp(DAY + dt.timedelta(day)) - pd.offsets.BDay(back)).date() if back else DAY + dt.timedelta(day)
        got = align.at_or_before(df, ["k"], str(DAY + dt.timedelta(day)), back).collect()
        assert [r.source_date for r in got] == ([want] if want >= DAY else [])


def test_a_price_on_an_edge_and_prices_with_decimals(spark):
    closes = [100.0, 100.3, 100.6, 100.61, 101.0]
    df = spark.createDataFrame([("s", DAY + dt.timedelta(i), c, 10 * (i + 1)) for i, c in enumerate(closes)], "symbol string, d date, close double, volume long")
    r = bars.point_of_control(df).first()
    step = (101.0 - 100.0) / 50
    assert r.bin_volume == 70 and math.isclose(r.poc, 100.0 + 30.5 * step)  # 100.6 and 100.61 share a bin


def test_a_total_loss_compounds(spark):
    days = [DAY + dt.timedelta(i) for i in range(4)]
    base = spark.createDataFrame(list(zip(days, [100.0, 110.0, 99.0, 99.0])), "d date, close double")
    geared = spark.createDataFrame(list(zip(days, [100.0, 130.0, 0.0, 0.0])), "d date, close double")
    rows = {r.window: r for r in bars.leverage_drag(base, geared.where("close > 0 or d = '2024-01-03'")).collect()}
    assert set(rows) == {"all"}
    assert math.isclose(rows["all"].geared_return, -100.0) and math.isclose(rows["all"].theory_return, (1.3 * 0.7 - 1) * 100)


def test_events_have_a_total_order(spark):
    rows = [(DAY, "MACRO", "vix", "1D", "single", 2, 0.9, ""), (DAY, "MACRO", "move", "1D", "single", 3, 0.5, ""), (DAY, "MACRO", "abc", "1D", "single", 2, 0.9, "")]
    df = spark.createDataFrame(rows, "d date, scope string, metric string, window_scope string, layer string, severity int, confidence double, resonance_key string")
    assert [r.metric for r in anomaly.ordered(df).orderBy("place").collect()] == ["move", "abc", "vix"]


def test_upsert_takes_the_last_of_a_key_whatever_the_order(spark, tmp_path):
    schema, path = "d date, k string, v int, at int", str(tmp_path / "t")
    new = spark.createDataFrame([(DAY, "a", i, i) for i in range(50)] + [(DAY, "b", 1, None)], schema)
    for rows in (new, new.repartition(7)):
        sinks.upsert(rows, sinks.stored(spark, path, schema), ["d", "k"], path, "d", order=["at", "v"])
        assert sorted((r.k, r.v) for r in sinks.stored(spark, path, schema).collect()) == [("a", 49), ("b", 1)]


def test_writes_are_tried_three_times():
    tries, waits = [], []

    def write():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")

    assert sinks.retried(write, wait=waits.append) and waits == [1, 2]

    def never():
        raise OSError("away")

    assert not sinks.retried(never, wait=waits.append)


def test_append_adds(spark, tmp_path):
    for _ in range(2):
        sinks.append(spark.createDataFrame([(DAY, 1)], "d date, v int"), str(tmp_path / "log"), "d")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_final_rows_survive_later_batches(spark, tmp_path):
    schema, path = "d date, k string, v int, is_final boolean", str(tmp_path / "t")
    write = streams.finalise(path, schema, ["d", "k"])
    write(spark.createDataFrame([(DAY, "a", 1, True), (DAY, "b", 1, False)], schema), 0)
    write(spark.createDataFrame([(DAY, "a", 2, False), (DAY, "b", 2, True), (DAY, "c", 2, False)], schema), 1)
    assert sorted((r.k, r.v) for r in sinks.stored(spark, path, schema).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_newest_of_the_last_files(spark, tmp_path):
    head = "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n"
    for day, short in (("20240105", 10), ("20240109", 30), ("20231201", 50)):
        (tmp_path / f"CNMSshvol{day}.txt").write_text(head + f"{day}|SPY|{short}|0|100|B\n{day}|QQQ|1|0|0|B\n1\n")
    got = readers.newest_short_volume(spark, str(tmp_path), "2024-01-11", ["SPY"]).collect()
    assert [(r.symbol, str(r.d), r.dpsv_pct) for r in got] == [("SPY", "2024-01-09", 30.0)]
    assert readers.newest_short_volume(spark, str(tmp_path), "2024-01-20").count() == 0
    assert {r.symbol for r in readers.newest_short_volume(spark, str(tmp_path), "2024-01-09").collect()} == {"SPY", "QQQ"}


def test_a_day_is_read_from_its_partition(spark, tmp_path):
    df = spark.createDataFrame([(DAY, "PRE", "MACRO", 1.0), (DAY, "POST", "MACRO", 2.0), (DAY, "PRE", "COMPOSITE", 3.0), (DAY + dt.timedelta(1), "PRE", "MACRO", 4.0)], "report_date date, session string, scope string, value double")
    sinks.replace_partitions(df, str(tmp_path / "t"), "report_date")
    rows = readers.day_rows(spark.read.parquet(str(tmp_path / "t")), str(DAY), "PRE", "COMPOSITE")
    assert [r.value for r in rows.collect()] == [1.0]
    assert "PartitionFilters: [isnotnull(report_date" in rows._jdf.queryExecution().toString()


def test_streams_of_shuffled_files_lose_nothing(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=37 * i), i % 5, "ab"[i % 2], float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.repartition(6, "event_id").write.parquet(str(tmp_path / "events"))
    events = streams.stream(spark, str(tmp_path / "events"), files_per_trigger=1 << 30)
    got = streams.drain(streams.session_vwap(events), ["day", "event_type"], str(tmp_path / "a")).collect()
    days = {(r[1].date(), r[3]) for r in rows}
    assert {(r.day, r.event_type) for r in got} == days and len(got) == len(days)
    again = streams.drain(streams.alert_days(streams.stream(spark, str(tmp_path / "events"))), ["day", "event_type"], str(tmp_path / "b")).collect()
    assert {(r.day, r.event_type) for r in again} == days and len(again) == len(days)


def test_sessions_and_times_in_new_york(spark):
    ts = ["2024-07-01 13:29:00", "2024-07-01 13:30:00", "2024-07-01 20:00:00", "2024-12-02 14:29:00"]
    df = spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert [r.session for r in market.sessions(df).collect()] == ["PRE", "RTH", "POST", "PRE"]
    texts = spark.createDataFrame([("2024-07-01T12:00:00Z",), ("2024-07-01 12:00:00+02:00",), ("2024-07-01 12:00:00",), ("bad",)], "t string")
    assert [r.v and r.v.hour for r in texts.select(clean.new_york(F.col("t")).alias("v")).collect()] == [8, 6, 12, None]


def test_official_frame_with_absent_columns(spark):
    df = spark.createDataFrame([("sofr_rate", DAY, 5.31, DAY), ("iorb", DAY, 5.4, None)], "column string, d date, value double, source_date date")
    r = align.official_frame(df, ["sofr_rate", "iorb"]).first()
    assert math.isclose(r.sofr_iorb_bps, -9.0) and r.sofr_iorb_bps_source_date == DAY and "net_liq_b" not in r


def test_chain_of_a_ticker_without_near_strikes(spark):
    spots = spark.createDataFrame([("a", 100.0)], "ticker string, spot double")
    strikes = spark.createDataFrame([("a", float(s)) for s in range(300, 360)], "ticker string, strike double")
    expirations = spark.createDataFrame([("a", 3)], "ticker string, dte int")
    assert options.assemble_chain(expirations, strikes, spots).count() == 0
    assert [r.strike for r in options.middle_strikes(strikes, spots).orderBy("strike").collect()] == [float(s) for s in range(310, 350)]
    near = strikes.withColumn("strike", F.col("strike") / 3.2)
    assert options.assemble_chain(expirations, near, spots).groupBy("cp").count().where("count <= 31").count() == 2


def test_degraded_days_and_overview_of_nothing(spark):
    days = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(1),)], "d date")
    snapshots = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(1), None)], "d date, value double")
    assert [r.d for r in reports.degraded_days(days, snapshots).collect()] == [DAY + dt.timedelta(1)]


def test_warnings_need_values(spark):
    pillars = spark.createDataFrame([(DAY, "funding_health", 20.0, 0.9), (DAY, "market_distribution", None, 0.2)], "d date, pillar string, score double, coverage double")
    columns = ["rrp_b", "reserves_t", *(c for c, _ in specs.FUNDING_GUARDS + specs.CREDIT_GUARDS)]
    empty = spark.createDataFrame([(DAY, *[None] * len(columns))], "d date, " + ", ".join(f"{c} double" for c in columns))
    change = spark.createDataFrame([(DAY, 150.0)], "d date, tga_5d double")
    assert liquidity.warnings(pillars, empty, change).first().warnings == "treasury account up by 100 billion in five days; funding weak but within absolute bounds"
    stressed = empty.withColumn("nfci", F.lit(0.3))
    assert "funding weak" not in liquidity.warnings(pillars, stressed, change).first().warnings


def test_fixed_values():
    """Literals beside the tables that code and SQL both read."""
    registry = {r[0]: r for r in specs.REGISTRY}
    assert registry["vix"][3] == [(">", 30.0, 2), (">", 22.0, 1)] and registry["trin"][4:] == (2.5, 3.5) and registry["vix_contango_pct"][1] == -1 and len(registry) == 40
    assert [(t, need, base, len(c)) for t, need, base, c in specs.THEMES] == [("high_risk_selloff", 3, 3, 5), ("fake_selloff_reversal", 3, 2, 3), ("crowding_fragility", 3, 2, 4)]
    assert sum(w for *_, w in specs.ENVIRONMENT) == pytest.approx(13.1) and sum(w for _, w in specs.PILLARS) == 6.25 and len(specs.COMPONENTS) == 26
    assert specs.GATE == {"floor": 0.35, "solo_severity": 3, "solo_confidence": 0.5, "cluster_severity": 2, "cluster_confidence": 0.5, "cluster_count": 2}
    assert dict(specs.FUNDING_GUARDS)["sofr_dispersion_bps"] == 25.0 and dict(specs.CREDIT_GUARDS) == {"hy_spread": 5.0, "ig_spread": 1.5}
