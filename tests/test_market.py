import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import market, reports
from tidemark.sources import sinks
from tidemark.streaming import logs


def test_reference_price(spark):
    rows = [(1.0, 2.0, 9.0, 8.0), (3.0, 2.0, 9.0, 8.0), (None, 2.0, 0.0, 8.0), (0.0, 0.0, None, None)]
    got = market.reference_price(spark.createDataFrame(rows, "bid double, ask double, last double, prev_close double")).collect()
    assert [(r.price, r.price_source) for r in got] == [(1.5, "mid"), (9.0, "last"), (8.0, "prev_close"), (None, "missing")]


def test_feed_label(spark):
    df = spark.createDataFrame([(1,), (4,), (9,), (None,)], "c int")
    assert [r[0] for r in df.select(market.feed_label(F.col("c"))).collect()] == ["live", "delayed frozen", "unknown", "unknown"]


def test_before_open_is_local(spark):
    bars = spark.sql("select explode(array(timestamp '2024-07-01 13:29:00', timestamp '2024-07-01 13:30:00', timestamp '2024-07-01 03:00:00')) as ts")
    assert [r.ts.hour for r in market.before_open(bars, F.lit("2024-07-01").cast("date")).collect()] == [13]


def test_contracts(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([("VX", day(n)) for n in (3, 10, 17, 24)] + [("ES", day(4))], "root string, expiry date")
    today = F.lit("2024-01-03").cast("date")
    near = market.nearest_contracts(rows, today).where("root = 'VX'").orderBy("place").collect()
    assert [(r.expiry.day, r.place) for r in near] == [(10, 1), (17, 2)]
    assert {r.root: r.expiry.day for r in market.front_contract(rows, today).collect()} == {"VX": 10, "ES": 4}


def test_implied_reference(spark):
    bars = spark.sql("select 'ES' as root, * from values (timestamp '2024-01-02 10:00:00', 90D), (timestamp '2024-01-02 20:00:00', 100D), (timestamp '2024-01-03 09:00:00', 105D) as t(ts, price)")
    closes = spark.createDataFrame([("ES", 400.0)], "root string, prev_close double")
    assert market.implied_reference(bars, closes, F.lit("2024-01-03").cast("date")).first().reference == 420.0


def test_curves_differ(spark):
    r = spark.range(1).select(market.contango(F.lit(20.0), F.lit(22.0)).alias("a"), market.term_ratio_contango(F.lit(20.0), F.lit(22.0)).alias("b"), market.backfill_contango(F.lit(0.0), F.lit(22.0)).alias("c")).first()
    assert round(r.a, 6) == 10.0 and round(r.b, 6) == round((1 - 20 / 22) * 100, 6) and r.c is None


def test_liquidity_inputs(spark):
    row = [(dt.date(2024, 1, 5), 7000.0, 700.0, 300.0, dt.date(2024, 1, 3), None, dt.date(2024, 1, 4))]
    got = market.net_liquidity(spark.createDataFrame(row, "d date, fed_assets_b double, tga_b double, rrp_b double, fed_assets_date date, tga_date date, rrp_date date")).first()
    assert got.net_liq_b == 6000.0 and got.source_date == dt.date(2024, 1, 3)
    rates = spark.createDataFrame([(5.31, 5.30, 5.33, 5.35, 5.45, 5.40)], "sofr double, tgcr double, effr double, sofr_p75 double, sofr_p99 double, iorb double")
    r = market.rate_spreads(rates).first()
    assert [round(x, 6) for x in (r.sofr_iorb_bps, r.sofr_75_iorb_bps, r.sofr_dispersion_bps)] == [-9.0, -5.0, 14.0]


def test_log_tail(spark):
    """A date counts in brackets alone; noise is left out before its date is looked at, and what comes before any date is kept."""
    lines = ["first", "[2024-01-01 10:00:00] old", "trace of old", "2024-01-02 plain", "[2024-01-02 10:00:00] new", "trace of new", " ", "[2024-01-03] heartbeat", "still", "[2024-01-03] more", None, "[2024-01-03] until 2024-01-02", "last"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, "alone")], "file string, n int, line string")
    got = market.todays_log(rows, "2024-01-02", ["heartbeat"]).orderBy("file", "n")
    assert [r.line for r in got.collect()] == ["first", "[2024-01-02 10:00:00] new", "trace of new", "still", "[2024-01-03] until 2024-01-02", "last", "alone"]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_log_tail_as_a_stream(spark, tmp_path, size):
    """The same lines as the batch form, whatever the batches' cuts; lines that come again are left out."""
    r = random.Random(5)
    kinds = ["[2024-01-01 1] a", "[2024-01-02 2] b", "[2024-01-02] heartbeat", "plain", "plain", "heartbeat", "", None]
    rows = [("fg"[i % 2], i, r.choice(kinds)) for i in range(60 if size == 1 else 300)]
    schema = logs.LINES
    size = 5 if size == 1 else size
    for a in range(0, len(rows), size):
        again = rows[max(0, a - 3) : a]
        path = tmp_path / "in" / f"{a:05d}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"file": f, "n": n, "line": x}) + "\n" for f, n, x in again + rows[a : a + size]))
        os.utime(path, (1_700_000_000 + a, 1_700_000_000 + a))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = logs.appended(logs.tail(stream, "2024-01-02", ["heartbeat"]), str(tmp_path / "out"))
    want = market.todays_log(spark.createDataFrame(rows, schema), "2024-01-02", ["heartbeat"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_tables_are_created_and_extended(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS tide")
    for _ in range(2):
        sinks.create_tables(spark, "tide")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN tide").collect() if not r.isTemporary} == set(sinks.SCHEMAS)
    sinks.add_columns(spark, "tide.sentinel_runs", "fingerprint string, host string")
    assert "host" in spark.table("tide.sentinel_runs").columns
    spark.sql("DROP DATABASE tide CASCADE")


def test_rolling_cache_and_duplicates(spark):
    old = spark.createDataFrame([(dt.date(2024, 1, n), 1) for n in (1, 2, 3)], "d date, v int")
    new = spark.createDataFrame([(dt.date(2024, 1, 3), 9)], "d date, v int")
    assert [(r.d.day, r.v) for r in sinks.rolling_cache(old, new, keep=2).collect()] == [(3, 9), (2, 1)]
    assert sinks.duplicate_keys(old.union(new), ["d"]).count() == 1


def test_environment_summary(spark):
    rows = [(dt.date(2024, 1, 2), "idx_b", None, 0.25), (dt.date(2024, 1, 2), "idx_a", 71.25, 1.0)]
    got = reports.environment_lines(spark.createDataFrame(rows, "d date, index string, score double, coverage double")).first().summary
    assert got == "idx_a 71.2 (100%); idx_b n/a (25%)" or got == "idx_a 71.3 (100%); idx_b n/a (25%)"
