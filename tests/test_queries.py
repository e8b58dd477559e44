"""Every registered engine query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.session_oracles import ORACLE_SQL
from tidemark.plans import inputs
from tidemark.session_queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in values), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got, columns = rows(df.columns, df.collect())
    assert got
    if name not in ORACLE_SQL:
        return
    result = duck.execute(ORACLE_SQL[name])
    want, names = rows([d[0] for d in result.description], result.fetchall())
    assert columns == names
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["weekday_lag", "session_lag", "five_day_change", "rolling_z_or_zero", "rate_of_change", "monthly_yoy"])
def test_every_series_has_rows(spark, data, name):
    facts = inputs.metric_facts(spark, data).select("scope", "metric").distinct()
    found = QUERIES[name](spark, data).select("scope", "metric").distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, facts.collect()))


def test_leverage_drag_has_all_windows_of_all_symbols(spark, data):
    """Over enough days for each window; a pair with fewer days than a window has no row for it."""
    got = QUERIES["leverage_drag"](spark, "/root/testdata/sf0.01").collect()
    assert {r.window for r in got} == {"21", "63", "all"}
    assert {x for r in got for x in (r.base, r.geared)} == {r.symbol for r in inputs.bars(spark, data).select("symbol").distinct().collect()}


@pytest.mark.parametrize("name", ["asof_align", "effective_obs", "weekday_lag", "session_lag", "five_day_change", "liquidity_components", "liquidity_pillars", "liquidity_state", "supports_drags", "liquidity_trend"])
def test_calendar_follows_the_observations(spark, data, tmp_path, name):
    """A table that ends on Friday 2003-10-10."""
    orders = spark.read.parquet(f"{data}/orders.parquet")
    orders.withColumn("o_orderdate", F.date_add("o_orderdate", 800).cast(orders.schema["o_orderdate"].dataType)).write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).agg(F.max("d")).first()[0] == "2003-10-10"


def test_alert_days_of_shuffled_files(spark, data, tmp_path):
    """The file with the last days comes first, the rest are shuffled."""
    events = spark.read.parquet(f"{data}/events.parquet")
    last = events.agg(F.max("ts")).first()[0]
    path = str(tmp_path / "events.parquet")
    events.where(F.col("ts") == last).coalesce(1).write.parquet(path)
    for i in range(3):
        events.where(F.pmod(F.hash("ts"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    want = events.select(F.to_date("ts").cast("string"), "event_type").distinct().collect()
    assert sorted(map(tuple, QUERIES["stream_alert_dedupe"](spark, str(tmp_path)).collect())) == sorted(map(tuple, want))


def test_vrp_is_vix_less_volatility(spark, data):
    hv = {r.d: r.hv for r in QUERIES["hv20"](spark, data).where("symbol = 'Brand#11'").collect()}
    got = QUERIES["hv20_vrp"](spark, data).collect()
    assert any(r.vrp is not None for r in got)
    for r in got:
        assert r.hv == hv[r.d] and (r.vrp is None if r.hv is None else abs(r.vrp - (r.vix - r.hv)) < 2e-4)
