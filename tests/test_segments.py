"""Running values over cut series against plain windows over whole ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import segments

START = dt.datetime(2024, 3, 4, tzinfo=dt.timezone.utc)
ROWS = "k string, ts timestamp, i long, v long, volume long, name string"
KEYS, ORDER = ["k"], ["ts", "i"]


def whole():
    return Window.partitionBy("k").orderBy("ts", "i")


def upto():
    return whole().rowsBetween(Window.unboundedPreceding, 0)


@pytest.fixture(scope="module")
def ticks(spark):
    dice = random.Random(3)
    rows = [("hot", START + dt.timedelta(minutes=dice.randrange(3000) if n % 3 else 77), n, dice.choice([None, 1, 2, 3, 3, 3]), dice.randrange(5), "x") for n in range(1500)]
    rows += [(None, START + dt.timedelta(minutes=n), n, n % 4 or None, 1, "x") for n in range(60)]
    rows += [("still", START + dt.timedelta(days=n), n, None if n < 7 else 5, 2, "x") for n in range(12)]
    rows += [("no time", None, n, n, 1, None) for n in range(5)] + [("one", START, 1, 9, None, "x")]
    return spark.createDataFrame(rows, ROWS).cache()


def same(got, expected):
    assert sorted(got.columns) == sorted(expected.columns)
    plain = lambda df: sorted(map(repr, df.select(*sorted(expected.columns)).collect()))
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("most", [1, 40, 10**9])
def test_sums_fills_and_lags(ticks, most):
    rows, v = segments.cut(ticks, KEYS, ORDER, most), F.col("v")
    for step, name in ((segments.running_sum, "s"), (segments.fill_forward, "f"), (segments.previous, "p")):
        rows = step(rows, KEYS, ORDER, v, name)
    same(segments.joined(rows), ticks.select("*", F.sum(v).over(upto()).alias("s"), F.last(v, True).over(upto()).alias("f"), F.lag(v).over(whole()).alias("p")))


@pytest.mark.parametrize("most", [1, 40, 10**9])
@pytest.mark.parametrize("hit", ["v >= 3", "v >= 2 or v is null", "false", "true"])
def test_run_lengths(ticks, most, hit):
    numbered = ticks.withColumn("n", F.row_number().over(whole()))
    miss = F.max(F.when(~F.coalesce(F.expr(hit), F.lit(False)), F.col("n"))).over(upto())
    expected = numbered.withColumn("run", F.col("n").cast("long") - F.coalesce(miss, F.lit(0))).drop("n")
    same(segments.joined(segments.run_length(segments.cut(ticks, KEYS, ORDER, most), KEYS, ORDER, F.expr(hit), "run")), expected)


@pytest.mark.parametrize("most", [1, 40, 10**9])
def test_balance_volume(ticks, most):
    bars = ticks.withColumnRenamed("v", "close")
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(whole())).cast("long") * F.col("volume"), F.lit(0))
    same(segments.obv(bars, KEYS, ORDER, most), bars.withColumn("step", step).withColumn("obv", F.sum("step").over(upto())).drop("step"))


@pytest.mark.parametrize("most", [1, 40, 10**9])
def test_asof(spark, ticks, most):
    spine = ticks.where("i % 5 = 0").select("k", "ts", "i", F.lit("mine").alias("value"))
    seen = {}
    for r in ticks.where("v is not null and ts is not null").collect():
        seen.setdefault(r.k, []).append((r.ts, r.v))
    got = segments.asof(spine, ticks, KEYS, value="v", most=most).collect()
    assert len(got) == spine.count()
    for r in got:
        held = [o for o in seen.get(r.k, []) if r.ts is not None and o[0] <= r.ts]
        assert (r.source_date, r.value) == (max(held) if held else (None, None))


def test_segments_are_bounded_and_in_order(ticks):
    cut = segments.cut(ticks, KEYS, ORDER, 40)
    assert cut.count() == ticks.count()
    sizes = cut.groupBy("k", "_segment").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    unit = max(r["count"] for r in ticks.groupBy("k", F.date_trunc("hour", "ts")).count().collect())
    assert max(r.n for r in sizes) < 40 + unit
    hot = sorted((r._segment, r.a, r.b) for r in sizes if r.k == "hot")
    assert len(hot) > 10 and all(x[2] < y[1] for x, y in zip(hot, hot[1:]))
    small = segments.cut(ticks.where("k is null"), KEYS, ORDER, 7, "minute").groupBy("_segment").count().collect()
    assert max(r["count"] for r in small) == 7 and len(small) == 9


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert segments.obv(empty.withColumnRenamed("v", "close"), KEYS, ORDER).columns == ["k", "ts", "i", "close", "volume", "name", "obv"]
    assert segments.joined(segments.run_length(segments.cut(empty, KEYS, ORDER), KEYS, ORDER, F.col("v") > 1, "run")).collect() == []
    assert segments.asof(empty, empty, KEYS, value="v").collect() == []


def test_no_window_holds_a_whole_series(ticks):
    """Every window over rows is by segment; those by series alone are over one row a unit or segment."""
    plan = segments.obv(ticks.withColumnRenamed("v", "close"), KEYS, ORDER, 40)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    by_series = [line for line in windows if "_segment" not in line.split("],")[1]]
    assert windows and all(any(total in line for total in ("sum(_n", "lag(_last", "sum(_flow")) for line in by_series)
