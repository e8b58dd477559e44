"""The intraday scan: by hand, and as a stream under shuffled files, late rows and a restart."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import scan

DAY = dt.datetime(2024, 3, 4, tzinfo=dt.timezone.utc)
VIEW = "market string, d date, prev_close double, expected_move double, flip double"


def at(minute, second=0):
    return DAY + dt.timedelta(minutes=minute, seconds=second)


def quote(minute, name, value, volume=None, market="A", second=0):
    return (at(minute, second), market, name, None if value is None else float(value), volume)


def scanned(spark, quotes, view=(), **more):
    df = scan.scan(spark.createDataFrame(quotes, scan.QUOTES), spark.createDataFrame(list(view), VIEW), **more)
    return {(r["market"], r["minute"]): r for r in df.withColumn("minute", ((F.unix_seconds("ts") - int(DAY.timestamp())) / 60).cast("int")).collect()}


def test_a_step_by_hand(spark):
    rows = [
        quote(0, "price", 10, 100), quote(4, "price", 12, 100), quote(7, "price", 20, 50), quote(16, "price", 30, 50),
        quote(1, "tick", 100), quote(1, "tick", 200, second=30), quote(2, "tick", 400), quote(3, "tick", 0), quote(5, "trin", 2), quote(6, "trin", 1.5), quote(6, "up", 8), quote(6, "down", 2),
    ]
    got = scanned(spark, rows)
    first, second = got["A", 15], got["A", 30]
    # Bars of five minutes: close 12 with volume 200, close 20 with volume 50, close 30 with volume 50.
    assert (first["price"], first["vwap"], first["ctick"], first["trin"], first["ratio"]) == (20, (12 * 200 + 20 * 50) / 250, 300, 1.5, 4)
    assert (second["price"], second["vwap"], second["ctick"], second["trin"], second["ratio"]) == (30, (2400 + 1000 + 1500) / 300, 0, 0, 1)
    assert first["alert"] == "up-volume surge" and second["alert"] is None
    assert set(got) == {("A", 15), ("A", 30)}, "later steps have no price within reach"


def test_days_and_markets_stay_apart(spark):
    rows = [quote(23 * 60 + 50, "price", 10, 1), quote(24 * 60 + 2, "price", 30, 1), quote(24 * 60 + 2, "price", 7, 1, "B"), quote(24 * 60 + 2, "down", 5, market="B")]
    got = scanned(spark, rows)
    assert {k: r["vwap"] for k, r in got.items()} == {("A", 24 * 60): 10, ("A", 24 * 60 + 15): 30, ("B", 24 * 60 + 15): 7}
    assert got["A", 24 * 60 + 15]["ratio"] == 1 and got["B", 24 * 60 + 15]["ratio"] == 0


@pytest.mark.parametrize("rows", [[], [quote(1, "price", None, 5)], [quote(1, "price", 0, 5)], [quote(1, "price", "nan", 5)], [quote(1, "tick", 5)], [quote(1, None, 5, 5)], [(None, "A", "price", 1.0, 1)]])
def test_without_a_price_nothing_is_scanned(spark, rows):
    assert scanned(spark, rows) == {}


def test_volume_missing_or_zero_gives_the_price(spark):
    assert scanned(spark, [quote(1, "price", 9, None)])["A", 15]["vwap"] == 9
    assert scanned(spark, [quote(1, "price", 9, 0)])["A", 15]["vwap"] == 9


def test_the_view_of_the_day_sets_the_bound(spark):
    rows = [quote(0, "price", 100, 1), quote(1, "price", 90, 1), quote(1, "trin", 2), quote(1, "up", 6), quote(1, "down", 2), quote(1, "tick", 50)]
    view = [("A", DAY.date(), 95.0, 0.05, 0.0), ("A", DAY.date() + dt.timedelta(1), 1.0, 0.0, 0.0), ("B", DAY.date(), 1.0, 0.0, 0.0)]
    assert scanned(spark, rows, view)["A", 15]["alert"] == "capitulation bid"
    assert scanned(spark, rows, view[1:])["A", 15]["alert"] is None


def streamed(spark, batches, folder, start=0):
    """The scan after each of the batches was added and drained; the stream starts anew from its state every time."""
    for i, rows in enumerate(batches, start):
        spark.createDataFrame(rows, scan.QUOTES).coalesce(1).write.mode("append").parquet(f"{folder}/quotes")
        time.sleep(0.01)
        grown = spark.readStream.schema(scan.QUOTES).parquet(f"{folder}/quotes")
        out = scan.emitted(scan.scan(grown, spark.createDataFrame([], VIEW)), folder)
    return out


def test_stream_equals_batch_with_shuffled_quotes_and_restarts(spark, tmp_path):
    dice = random.Random(5)
    rows = [quote(dice.randrange(0, 1500), dice.choice(["price", "price", "tick", "trin", "up", "down"]), dice.randrange(-5, 50), dice.randrange(0, 9), dice.choice("AB"), i % 60) for i in range(900)]
    rows.sort(key=lambda r: r[0] + dt.timedelta(minutes=dice.randrange(0, 50)))  # within the hour that may be late
    closing = [quote(9000, "price", None), quote(9000, "tick", None)]
    got = streamed(spark, [rows[:300], rows[300:301], rows[301:], closing], str(tmp_path))
    expected = scan.scan(spark.createDataFrame(rows, scan.QUOTES), spark.createDataFrame([], VIEW))
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("market", "ts", "price", "vwap", "ctick", "trin", "ratio", F.coalesce("alert", F.lit("")).alias("alert")).collect())
    assert plain(got) == plain(expected) and got.count() > 100


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    both = [quote(600, "price", 5, 1), quote(600, "tick", 1)]
    late = [quote(10, "price", 77, 1), quote(590, "price", 3, 1)]
    closing = [quote(9000, "price", None), quote(9000, "tick", None)]
    got = streamed(spark, [[quote(0, "price", 4, 1)], both, late, closing], str(tmp_path))
    minutes = {(int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp()) - int(DAY.timestamp())) // 60: (r.price, r.vwap) for r in got.collect()}
    assert minutes[15] == (4, 4), "came out before the late row"
    assert minutes[600] == (3, 3.5) and minutes[615] == (5, 4), "a row that is late within bounds counts"
