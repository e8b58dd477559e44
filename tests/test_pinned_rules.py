"""Cases that pin rules which are easily read otherwise."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import anomaly, bars, probes
from tidemark.sources import readers, sinks


def day(n):
    return dt.date(2024, 1, n)


def test_weekly_flip_follows_the_level(spark):
    schema = "ticker string, d date, price double, poc double, dpsv double, flip double, pin_strike double, pin_state string, charm double, ivr double, obv_status string"
    rows = [("A", day(i), 100.0, 100.0, 45.0, 90.0 + i, None, "PIN_CANDIDATE", 1.0, 50.0, "ok") for i in range(1, 9)]
    rows += [("B", day(i), 100.0, 100.0, 45.0, 90.0 - (i == 7), 95.0, "PIN_CANDIDATE" if i == 2 else "BREAKOUT" if i == 3 else "" if i == 4 else None, 1.0, 50.0, "ok") for i in range(1, 9)]
    rows += [("C", day(1), 200.0, 100.0, 60.0, 1.0, 95.0, "PIN_CANDIDATE", 1.0, 5.0, "divergence"), ("C", None, 200.0, 100.0, 60.0, 1.0, 95.0, "PIN_CANDIDATE", 1.0, 5.0, "divergence")]
    got = {(r.ticker, r.d.day): r.findings for r in probes.micro_probe(spark.createDataFrame(rows, schema)).collect()}
    assert [got["A", i] for i in range(1, 9)] == [[]] * 5 + [["flip up in a week"]] * 3
    assert [got["B", i] for i in range(1, 9)] == [[], ["pin candidate"], ["breakout pivot"], [], [], [], ["flip down in a week"], []]
    assert got["C", 1] == [] and len(got) == 17


def test_missing_members_count_as_zero(spark):
    rows = spark.createDataFrame([("a", day(1), 1.0), ("b", day(1), None), ("x", day(1), 0.5), ("a", day(2), 3.0), ("y", day(3), 1.0)], "symbol string, d date, r_1 double")
    got = {r.d.day: r.spread for r in bars.group_spread(rows, ["a", "b"], "x").collect()}
    assert got == {1: 0.0, 2: 1.5, 3: 0.0}


def test_of_one_key_the_most_confident_is_kept(spark):
    schema = "d date, metric string, scope string, window_scope string, layer string, severity int, confidence double, resonance_key string"
    rows = [(day(1), "RESONANCE", "MACRO", "multi", "resonance", severity, confidence, key) for severity, confidence, key in ((2, 0.6, "a"), (2, 0.9, "b"), (2, 0.9, "c"), (1, 1.0, "d"))]
    (got,) = anomaly.gate(spark.createDataFrame(rows, schema)).collect()
    assert (got.severity, got.confidence, got.resonance_key) == (2, 0.9, "b")
    assert anomaly.gate(spark.createDataFrame(rows, schema), keyed=True).count() == 4


def test_pages_are_read_in_their_order(spark, tmp_path):
    def page(name, offset, *observations):
        (tmp_path / name).write_text(json.dumps({"observations": [{"date": d, "value": v} for d, v in observations]} | ({} if offset is None else {"offset": offset})))

    page("p1.json", None, ("2024-01-02", "1.0"), ("2024-01-03", "2.0"))
    page("p2.json", None, ("2024-01-03", "9"), ("2024-01-04", "."))
    assert sorted((r.d.day, r.value) for r in readers.observations_json(spark, str(tmp_path), "x").collect()) == [(2, 1.0), (3, 9.0)]
    page("p0.json", 1000, ("2024-01-03", "7"), ("2024-01-03", "8"))  # a later page under an earlier name
    assert sorted((r.d.day, r.value) for r in readers.observations_json(spark, str(tmp_path), "x").collect()) == [(2, 1.0), (3, 8.0)]


def test_a_day_keeps_its_last_sound_value(spark):
    rows = spark.createDataFrame([("a", day(2), 1.0, 1), ("a", day(2), 2.0, 2), ("a", day(2), float("nan"), 3), ("a", day(6), 5.0, 1), ("b", day(2), 7.0, 1)], "k string, d date, value double, sent int")
    assert sorted((r.k, r.value) for r in clean.trading_days(rows, ["k"], ["sent"]).collect()) == [("a", 2.0), ("b", 7.0)]


def test_position_groups_exclude_words(spark):
    rows = spark.createDataFrame([(day(2), name, n, 0) for name, n in (("E-MINI S&P 500", 1), ("micro e-mini s&p 500", 2), ("NASDAQ-100 (mini)", 4), ("VIX FUTURES", 8), ("S&P 500 Consolidated", 16))] + [(day(1), "VIX FUTURES", 99, 0)], "d date, market string, long long, short long")
    groups = [("sp", ["s&p 500", "mini"], ["micro"]), ("nasdaq", ["nasdaq", "100"], ["micro"]), ("vix", ["vix futures"], []), ("rest", ["s&p"], [])]
    assert {r.group: r.net for r in readers.net_positions(rows, groups).collect()} == {"sp": 1, "nasdaq": 4, "vix": 8, "rest": 18}


def test_a_large_date_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(40_000).select(F.when(F.col("id") < 38_000, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date").alias("d"), "id", F.sha2(F.col("id").cast("string"), 512).alias("filler"))
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 5000)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        sinks.replace_partitions(rows, str(tmp_path / "t"), "d")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(str(tmp_path / "t")).groupBy("d", F.input_file_name().alias("f")).count().collect()
    tasks = {r.f.rpartition("/")[2].split("-")[1] for r in files if r.d.day == 1}
    assert len(tasks) > 1 and max(r["count"] for r in files) <= 5000 and sum(r["count"] for r in files) == 40_000


def test_a_load_is_recorded_by_its_own_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", 1.0), (2, " N/A ", None), (3, None, 2.0), (4, "y", 3.0)], "i int, text string, v double")
    ledger, seen = str(tmp_path / "ledger"), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def fail(_):
        raise OSError("no space")

    once = rows.mapInArrow(count, rows.schema)
    assert sinks.recorded(once, lambda df: df.write.parquet(str(tmp_path / "a")), ledger, "a", "2024-01-02", ["text", "v"]) == "degraded"
    assert seen.value == 4  # one pass
    assert sinks.recorded(rows, lambda df: df.write.parquet(str(tmp_path / "b")), ledger, "b", "2024-01-02", ["text", "v"], 0.5) == "ok"
    assert sinks.recorded(rows.limit(0), lambda df: df.write.parquet(str(tmp_path / "c")), ledger, "c", "2024-01-02", ["text"]) == "empty"
    with pytest.raises(OSError, match="no space"):
        sinks.recorded(rows, fail, ledger, "d", "2024-01-02", ["text"])
    got = {r.job: (r["rows"], r.missing, r.status) for r in spark.read.schema(sinks.LEDGER).parquet(ledger).collect()}
    assert got == {"a": (4, {"text": 2, "v": 1}, "degraded"), "b": (4, {"text": 2, "v": 1}, "ok"), "c": (0, {"text": 0}, "empty"), "d": (None, {}, "failed")}
