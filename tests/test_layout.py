"""Tables laid out by key: joins without a shuffle, rules that fail a write, the unified view."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.sources import layout, sinks

KEYS = ["d", "ticker"]


@pytest.fixture()
def days(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS laid")
    yield spark.range(600).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 6).cast("int")).alias("d"), F.concat(F.lit("T"), F.col("id") % 6).alias("ticker"), F.col("id").alias("price"))
    spark.sql("DROP DATABASE laid CASCADE")


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange")


def test_joins_by_key_need_no_shuffle(spark, days):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = layout.write(days, "laid.a", KEYS, 4)
        b = layout.write(days.where("price % 5 > 0").withColumn("is_final", F.col("price") % 2 == 0), "laid.b", KEYS, 4)
        joins = {"unified": align.unified(a, b, KEYS), "unless_final": a.join(b.where("is_final").select(*KEYS), KEYS, "left_anti"), "inner": a.join(b.select(*KEYS, "is_final"), KEYS)}
        assert {name: exchanges(df) for name, df in joins.items()} == dict.fromkeys(joins, 0)
        assert joins["unified"].count() == 600 and joins["inner"].count() == 480 and joins["unless_final"].count() == 600 - days.where("price % 5 > 0 and price % 2 = 0").count()
        assert exchanges(days.join(b, KEYS)) > 0, "what isn't laid out is shuffled"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_file_a_bucket(spark, days, tmp_path):
    layout.write(days, "laid.a", KEYS, 4, str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 4
    again = layout.write(days.where("price < 60"), "laid.a", KEYS, 4, str(tmp_path / "a"))
    assert again.count() == 60


@pytest.mark.parametrize(
    ("change", "text"),
    [
        (lambda df: df.unionByName(df.where("price = 7")), "d, ticker occurs twice"),
        (lambda df: df.withColumn("ticker", F.when(F.col("price") != 9, F.col("ticker"))), "ticker is null"),
        (lambda df: df.withColumn("price", F.when(F.col("price") != 9, F.col("price"))), "price is null"),
        (lambda df: df.withColumn("bucket", F.when(F.col("price") == 9, "2D").otherwise("ALL")), "bucket isn't one of its values"),
    ],
)
def test_broken_rules_fail_the_write(spark, days, change, text):
    rows = change(days.withColumn("bucket", F.lit("0DTE")))
    with pytest.raises(Exception, match=text):
        layout.write(rows, "laid.bad", KEYS, 4, None, ["price"], {"bucket": layout.GAMMA_BUCKETS})
    assert not spark.catalog.tableExists("laid.bad")


def test_sound_and_empty_tables_pass(spark, days):
    rules = ([*KEYS, "price"], {"bucket": layout.GAMMA_BUCKETS})
    rows = days.withColumn("bucket", F.when(F.col("price") > 5, "ALL"))
    assert layout.write(rows, "laid.good", KEYS, 4, None, *rules).count() == 600
    assert layout.write(rows.where("false"), "laid.none", KEYS, 4, None, *rules).count() == 0
    assert set(layout.GAMMA_BUCKETS) and "option_gamma_buckets" in sinks.SCHEMAS


def test_unified_view(spark, days):
    early, late = dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 16)
    pre = days.where("price < 12").select("d", "ticker", F.col("price").alias("current_price"), F.lit(1.5).alias("call_wall"), F.lit(9.0).alias("poc_price"), F.lit(early).alias("as_of_time"), F.col("d").alias("source_date"))
    post = days.where("price between 6 and 17").select("d", "ticker", (F.col("price") + 100).alias("current_price"), F.lit(2.0).alias("poc_price"), F.lit(late).alias("as_of_time"), F.lit("up").alias("obv_status"))
    layout.unified_view(layout.write(pre, "laid.pre", KEYS, 2), layout.write(post, "laid.post", KEYS, 2), "laid.unified", KEYS, "laid.pre", "laid.post")
    rows = {(r.d, r.ticker): r for r in spark.table("laid.unified").collect()}
    assert list(spark.table("laid.unified").columns) == ["d", "ticker", "close_price", "poc_price", "obv_status", "post_as_of_time", "pre_price", "call_wall", "pre_as_of_time"]
    day = dt.date(2024, 1, 1)
    only_pre, both, only_post = rows[day, "T0"], rows[day + dt.timedelta(1), "T0"], rows[day + dt.timedelta(2), "T0"]
    assert len(rows) == 18 and (only_pre.close_price, only_pre.poc_price, only_pre.pre_price) == (None, None, 0)
    assert (both.close_price, both.poc_price, both.pre_price, both.pre_as_of_time, both.post_as_of_time) == (106, 2.0, 6, early, late)
    assert (only_post.pre_price, only_post.call_wall, only_post.obv_status) == (None, None, "up")
