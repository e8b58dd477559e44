"""Dirty values, calendars, readers, sinks and edge cases that the driver's tables don't hold."""

import datetime as dt
import itertools
import json
import math

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clean, pricing, series
from tidemark.operators import align, anomaly, bars, calendar, environment, liquidity, options, probes
from tidemark.sources import readers, sinks
from tidemark.streaming import market


def one(df, column):
    return [r[column] for r in df.select(column).collect()]


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("-",), ("null",), (".",), ("NaN",), ("abc",), (None,), ("1e999",), ("7",)], "t string")
    assert one(df.select(clean.number(F.col("t")).alias("v")), "v") == [1234.5, None, None, None, None, None, None, None, 7.0]


def test_magnitudes(spark):
    df = spark.createDataFrame([("1.5B",), ("250K",), ("2m",), ("1T",), ("3000000",), ("x",)], "t string")
    got = one(df.select(clean.magnitude(F.col("t")).alias("v")), "v")
    assert got[:4] == [1500.0, 0.25, 2.0, 1e6] and math.isclose(got[4], 3.0) and got[5] is None


def test_zero_price_is_missing(spark):
    df = spark.createDataFrame([(0.0, float("nan"), 5.0), (2.0, 1.0, 1.0), (None, 0.0, None)], "a double, b double, c double")
    assert one(df.select(clean.first_positive(F.col("a"), F.when(~F.isnan("b"), F.col("b")), F.col("c")).alias("p")), "p") == [5.0, 2.0, None]


def test_missing_fields(spark):
    df = spark.createDataFrame([("-", 1.0, None), ("a", 2.0, "b")], "x string, y double, z string")
    assert one(df.select(clean.missing_fields("x", "y", "z").alias("m")), "m") == [["x", "z"], []]


def test_zscore_needs_thirty_rows_and_is_zero_without_spread(spark):
    df = spark.createDataFrame([("a", i, 5.0) for i in range(40)], "k string, d int, v double")
    w = Window.partitionBy("k").orderBy("d")
    z = one(df.select("d", series.zscore(F.col("v"), w).alias("z")).orderBy("d"), "z")
    assert z[:29] == [None] * 29 and z[29:] == [0.0] * 11


def test_percentiles_strict_and_inclusive(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(300)] + [("b", i, 1.0) for i in range(40)], "k string, d int, v double")
    w = Window.partitionBy("k").orderBy("d")
    rows = df.select("k", "d", series.percentile(F.col("v"), w).alias("s"), series.percentile(F.col("v"), w, inclusive=True).alias("i")).collect()
    last = {r.k: r for r in rows if r.d in (299, 39) and (r.k, r.d) in (("a", 299), ("b", 39))}
    assert math.isclose(last["a"].s, 251 / 252 * 100) and last["a"].i == 100.0
    assert last["b"].s == 0.0 and last["b"].i == 50.0


def test_dirty_values_are_absent_from_snapshots(spark):
    day = dt.date(2024, 1, 1)
    rows = [("MACRO", "vix", day + dt.timedelta(i), v) for i, v in enumerate([20.0, float("nan"), None, float("inf"), 31.0])]
    got = anomaly.snapshot(spark.createDataFrame(rows, "scope string, metric string, d date, value double")).orderBy("d").collect()
    assert [(r.value, r.n, r.severity, r.days_in_risk) for r in got] == [(20.0, 1, 0, 0), (31.0, 2, 2, 1)]
    assert got[1].chg_1d == 11.0 and got[1].dist_to_thr == -9.0


def test_gate_and_fingerprint(spark):
    day = dt.date(2024, 1, 2)
    schema = "d date, scope string, metric string, value double, window_scope string, layer string, severity int, confidence double, direction string, resonance_key string"
    event = lambda metric, layer, severity, confidence, key="": (day, "MACRO", metric, 1.0, "1D", layer, severity, confidence, "up", key)
    alone = anomaly.gate(spark.createDataFrame([event("a", "single", 2, 0.9)], schema))
    assert alone.count() == 0
    pair = anomaly.gate(spark.createDataFrame([event("a", "single", 2, 0.9), event("b", "single", 2, 0.5), event("c", "single", 3, 0.3), event("R", "resonance", 3, 0.9, "x"), event("R", "resonance", 2, 0.9, "y")], schema))
    assert sorted((r.metric, r.severity) for r in pair.collect()) == [("R", 3), ("a", 2), ("b", 2)]
    keyed = anomaly.gate(spark.createDataFrame([event("R", "resonance", 3, 0.9, "x"), event("R", "resonance", 2, 0.9, "y")], schema), keyed=True)
    assert keyed.count() == 2
    import hashlib

    want = hashlib.md5(b"2024-01-02|R:MACRO:3|a:MACRO:2|b:MACRO:2").hexdigest()[:16]
    assert anomaly.fingerprints(pair).first().fingerprint == want


def test_asof_carries_value_and_date(spark):
    spine = calendar.session_days(spark, "2024-01-01", "2024-01-05", holidays=[]).select("d", "seq")
    seen = spark.createDataFrame([("x", dt.date(2024, 1, 1), 10.0), ("x", dt.date(2024, 1, 4), 12.0)], "k string, d date, value double")
    got = align.effective_observations(align.asof(spine, seen, ["k"]), ["k"]).orderBy("d").collect()
    assert [(r.value, r.source_date.day, r.effective_obs) for r in got] == [(10.0, 1, 1)] * 3 + [(12.0, 4, 2)] * 2


def test_lags(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), dt.date(2024, 1, 8)), (dt.date(2024, 1, 6), dt.date(2024, 1, 8)), (None, dt.date(2024, 1, 8)), (dt.date(2024, 1, 9), dt.date(2024, 1, 8))], "s date, r date")
    assert one(df.select(align.weekday_lag(F.col("s"), F.col("r")).alias("n")), "n") == [1, 0, None, 0]
    days = calendar.session_days(spark, "2024-01-02", "2024-01-31")
    rows = spark.createDataFrame([(dt.date(2024, 1, 12), dt.date(2024, 1, 16))], "s date, r date")
    assert one(calendar.lag_days(rows, days, "s", "r"), "lag_days") == [1]


def test_priority_merge_tells_the_table(spark):
    first = spark.createDataFrame([(1, 625.0), (2, None)], "k int, v double")
    second = spark.createDataFrame([(1, 600.0), (2, 5.0), (3, 6.0)], "k int, v double")
    got = sorted(map(tuple, align.priority_merge(first, second, ["k"], ["v"]).collect()))
    assert got == [(1, 625.0, "first"), (2, 5.0, "second"), (3, 6.0, "second")]


def test_environment_weights_by_quality(spark):
    day = dt.date(2024, 1, 2)
    rows = [(day, "vix", "MACRO", 99.0, 252, 252, 0), (day, "vvix", "MACRO", 5.0, 30, 30, 0), (day, "move", "MACRO", 50.0, 126, 126, 0), (day, "vix_contango_pct", "MACRO", 10.0, 252, 252, 1)]
    days = spark.createDataFrame(rows, "d date, metric string, scope string, percentile double, effective_obs int, sample_len int, lag_days int")
    got = environment.index_scores(days).first()
    weights = [1.0, 0.8 * 0.5, 1.0 * 0.85]
    assert got.score == round((99 * weights[0] + 50 * weights[1] + 90 * weights[2]) / sum(weights), 1)
    assert got.coverage == round(sum(weights) / 3.4, 3)


def test_environment_does_not_depend_on_order(spark):
    """Four series of 1995-07-22 at scale 0.01, in a row order a day: their coverage is 0.4375, which rounds by the last bit."""
    seen = [("2-HIGH", 149), ("3-MEDIUM", 152), ("4-NOT SPECIFIED", 143), ("5-LOW", 144)]
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), m, s, 50.0, n, n, 0) for i, order in enumerate(itertools.permutations(seen)) for m in ("ivr_pct", "expected_move_pct") for s, n in order]
    days = spark.createDataFrame(rows, "d date, metric string, scope string, percentile double, effective_obs int, sample_len int, lag_days int").coalesce(1)
    got = environment.index_scores(days)
    assert {(r.score, r.coverage) for r in got.collect()} == {(50.0, 0.437)}
    assert {(r.composite, r.overall_coverage) for r in environment.composite(got).collect()} == {(None, 0.0874)}


def test_environment_composite_rounds_as_sql(spark):
    """Means of 62.45 and 26.05, whose doubles lie just below."""
    rows = [(day, index, score, 1.0) for day, pair in enumerate([(71.6, 53.3), (8.7, 43.4)]) for index, score in zip("ab", pair, strict=True)]
    got = environment.composite(spark.createDataFrame(rows, "d int, index string, score double, coverage double")).orderBy("d")
    assert [r.composite for r in got.collect()] == [duckdb.execute(f"SELECT round({x}::DOUBLE, 1)").fetchone()[0] for x in ((71.6 + 53.3) / 2, (8.7 + 43.4) / 2)] == [62.5, 26.1]


def test_liquidity_needs_distinct_source_dates(spark):
    day = dt.date(2024, 1, 1)
    rows = [("m2_yoy", day + dt.timedelta(i), 1.0 + i, day) for i in range(80)]
    facts = spark.createDataFrame(rows, "column string, d date, value double, source_date date")
    last = liquidity.component_scores(facts).orderBy(F.col("d").desc()).first()
    assert last.score is None and last.quality == 0.0 and last.observations == 1


def test_reserve_ladder(spark):
    df = spark.createDataFrame([(3.12,), (2.85,), (2.65,), (2.0,), (9.0,)], "v double")
    got = one(df.select(liquidity.reserve_score(F.col("v")).alias("s")), "s")
    assert [round(x, 6) for x in got] == [84.8, 55.0, 25.0, 0.0, 100.0]


def test_point_of_control_single_price_and_ties(spark):
    schema = "symbol string, d date, open long, high long, low long, close long, volume long"
    day = lambda i: dt.date(2024, 1, 1 + i)
    flat = [("f", day(i), 5, 5, 5, 5, 10) for i in range(3)]
    tied = [("t", day(0), 100, 100, 100, 100, 7), ("t", day(1), 0, 0, 0, 0, 7)]
    got = {r.symbol: r.poc for r in bars.point_of_control(spark.createDataFrame(flat + tied, schema)).collect()}
    assert got == {"f": 5.0, "t": 99.0}


def test_expected_move(spark):
    spots = spark.createDataFrame([("A", 100.0), ("B", 100.0), ("C", 100.0)], "ticker string, spot double")
    chain = spark.createDataFrame(
        [("A", 30, 100.0, "C", 1, 0.3, 3.2), ("A", 30, 100.0, "P", 1, 0.3, 2.8), ("B", 30, 100.0, "C", 1, 0.30, None), ("C", 0, 100.0, "C", 1, None, None)],
        "ticker string, dte int, strike double, cp string, oi long, iv double, mid double",
    )
    got = {r.ticker: (r.value, r.source) for r in options.expected_move(chain, spots).collect()}
    assert math.isclose(got["A"][0], 6.0) and got["A"][1] == "ATM_STRADDLE_MID"
    assert math.isclose(got["B"][0], 30 * math.sqrt(30 / 365)) and got["B"][1] == "ATM_IV_FALLBACK"
    assert got["C"] == (None, "MISSING")


def test_flat_curve_has_no_zero_and_puts_alone_no_ratio(spark):
    curve = spark.createDataFrame([("A", "ALL", i, float(i), 0.0) for i in range(3)], "ticker string, bucket string, i int, level double, exposure double")
    assert options.zero_points(curve).count() == 0
    chain = spark.createDataFrame([("A", 1, 1.0, "P", 5, 0.2)], "ticker string, dte int, strike double, cp string, oi long, iv double")
    assert options.put_call_ratio(chain).first().oi_pcr is None


def test_flip_lies_near_the_strikes(spark):
    spots = spark.createDataFrame([("A", 100.0)], "ticker string, spot double")
    chain = spark.createDataFrame([("A", 30, 110.0, "C", 1000, 0.25), ("A", 30, 90.0, "P", 1000, 0.25)], "ticker string, dte int, strike double, cp string, oi long, iv double")
    held = options.contracts(chain, spots)
    flips = {r.bucket: r.flip for r in options.primary_flip(options.zero_points(options.gamma_curve(held)), spots).collect()}
    assert set(flips) == {"8-30D", "ALL"} and 97 < flips["ALL"] < 101


def test_flip_continuity(spark):
    day = lambda i: dt.date(2024, 1, 1 + i)
    rows = [("A", day(0), 100.0, 100.0, "m", "x"), ("A", day(1), 101.0, 100.0, "m", "x"), ("A", day(2), 120.0, 100.0, "m", "x"), ("A", day(3), 120.0, 100.0, "m", "y"), ("A", day(4), 120.0, 100.0, "n", "y"), ("A", day(5), None, 100.0, "n", "y")]
    got = options.flip_continuity(spark.createDataFrame(rows, "ticker string, d date, flip double, spot double, sign_model string, expirations string")).orderBy("d")
    assert one(got, "status") == ["BASELINE_RESET", "OK", "JUMP_REVIEW", "ROLL_CHANGED", "METHOD_CHANGED", "NO_CROSSING"]


def test_normal_distribution(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double")
    for r in df.select("x", pricing.cdf(F.col("x")).alias("c")).collect():
        assert abs(r.c - (1 + math.erf(r.x / math.sqrt(2))) / 2) < 1e-6


def test_implied_volatility_recovers_price(spark):
    df = spark.createDataFrame([(100.0, 105.0, 0.2, 0.35, "C"), (100.0, 95.0, 0.5, 0.2, "P")], "s double, k double, t double, v double, cp string")
    c = [F.col(x) for x in ("s", "k", "t", "v", "cp")]
    got = df.withColumn("p", pricing.price(*c)).select("v", pricing.implied_volatility(F.col("p"), F.col("s"), F.col("k"), F.col("t"), F.col("cp")).alias("i")).collect()
    assert all(abs(r.v - r.i) < 1e-3 for r in got)


def test_years_to_expiry_is_new_york_close(spark):
    df = spark.sql("select timestamp '2024-01-19 20:00:00' as now, date '2024-01-19' as e union all select timestamp '2024-01-19 22:00:00', date '2024-01-19'")
    got = one(df.select(pricing.years_to_expiry(F.col("now"), F.col("e")).alias("y")), "y")
    assert math.isclose(got[0], 3600 / (365 * 86400)) and got[1] is None


def test_intraday_ladder(spark):
    schema = "price double, prev_close double, expected_move double, trin double, ratio double, ctick double, flip double, vwap double"
    rows = [(98.0, 100.0, 0.02, 2.0, 2.5, 5.0, 0.0, 99.0), (98.0, 100.0, 0.02, 2.0, 5.0, -5.0, 0.0, 97.0), (100.0, 100.0, 0.02, 1.0, 0.2, -400.0, 101.0, 101.0), (100.0, 100.0, 0.02, 1.0, 5.0, 0.0, 0.0, 99.0), (100.0, 100.0, 0.02, 1.0, 0.1, 0.0, 0.0, 101.0)]
    assert one(probes.intraday_alert(spark.createDataFrame(rows, schema)), "alert") == ["capitulation bid", None, "gamma slide", "up-volume surge", "down-volume surge"]


def test_readers(spark, tmp_path):
    (tmp_path / "dix.csv").write_text("date,price,dix,gex\n2024-01-02,1,0.45,2500000000\nbad,1,2,3\n")
    assert [tuple(r) for r in readers.dix_csv(spark, str(tmp_path / "dix.csv")).collect()] == [(dt.date(2024, 1, 2), 45.0, 2.5)]
    (tmp_path / "short.txt").write_text("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20240102|SPY|40|0|100|Q\n20240102|QQQ|1|0|0|Q\n2\n")
    assert sorted(map(tuple, readers.short_volume(spark, str(tmp_path / "short.txt")).collect())) == [("QQQ", dt.date(2024, 1, 2), None), ("SPY", dt.date(2024, 1, 2), 40.0)]
    (tmp_path / "obs.json").write_text(json.dumps({"observations": [{"date": "2024-01-02", "value": "."}, {"date": "2024-01-03", "value": "1"}, {"date": "2024-01-03", "value": "2"}]}))
    assert [(r.d.day, r.value) for r in readers.observations_json(spark, str(tmp_path / "obs.json"), "x").collect()] == [(3, 2.0)]
    (tmp_path / "tga.json").write_text(json.dumps({"data": [{"record_date": "2024-01-02", "close_today_bal": "null", "open_today_bal": "700,000"}]}))
    assert [r.tga_b for r in readers.treasury_json(spark, str(tmp_path / "tga.json")).collect()] == [700.0]
    (tmp_path / "rates.json").write_text(json.dumps({"refRates": [{"effectiveDate": "2024-01-02", "percentRate": 5.3, "percentPercentile75": 5.35, "volumeInBillions": 1.0}]}))
    assert [(r.rate, r.p99) for r in readers.rates_json(spark, str(tmp_path / "rates.json")).collect()] == [(5.3, None)]


def test_upsert_is_idempotent_and_leaves_other_days(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, day string"
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (1, "c", "y")], schema)
    for _ in range(2):
        sinks.upsert(first, sinks.stored(spark, path, schema), ["k", "day"], path, "day")
    sinks.upsert(spark.createDataFrame([(2, "B", "x"), (3, "d", "x")], schema), sinks.stored(spark, path, schema), ["k", "day"], path, "day")
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "day").collect())) == [(1, "a", "x"), (1, "c", "y"), (2, "B", "x"), (3, "d", "x")]
    sinks.sync_day(spark.createDataFrame([(9, "z", "x")], schema), path, "day")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 9]


def test_fallback_and_latest(spark):
    new = spark.createDataFrame([("a", 1, 5)], "t string, d int, v int")
    old = spark.createDataFrame([("a", 1, 4), ("a", 0, 3), ("b", 1, 2)], "t string, d int, v int")
    both = readers.with_fallback(new, old, ["t", "d"])
    assert sorted(map(tuple, both.collect())) == [("a", 0, 3), ("a", 1, 5), ("b", 1, 2)]
    assert sorted(map(tuple, readers.latest(both, ["t"]).collect())) == [("a", 1, 5), ("b", 1, 2)]


def test_stream_dedupe_over_batches(spark, tmp_path):
    folder = tmp_path / "events"
    for i in range(3):
        spark.sql(f"select timestamp_ntz '2024-01-01 10:0{i}:00' as ts, 1L as user_id, 'a' as event_type, 1.0D as value").coalesce(1).write.mode("append").parquet(str(folder))
    out = market.drain(market.once_a_day(market.stream(spark, str(folder))), ["day", "event_type"], str(tmp_path / "out"))
    assert out.count() == 1


@pytest.mark.parametrize("f", [bars.obv, bars.money_flow, bars.breadth, bars.point_of_control, bars.returns])
def test_empty_bars(spark, f):
    empty = spark.createDataFrame([], "symbol string, d date, open long, high long, low long, close long, volume long")
    assert f(empty).count() == 0
