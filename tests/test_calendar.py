"""The exchange calendar against known holidays, and replayed snapshots against a day-by-day loop."""

import datetime as dt
import random

import pandas as pd
import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from tidemark.operators import calendar, replay

#: The exchange's full closures by year.
KNOWN = {
    1996: "01-01 02-19 04-05 05-27 07-04 09-02 11-28 12-25",
    1998: "01-01 01-19 02-16 04-10 05-25 07-03 09-07 11-26 12-25",
    2001: "01-01 01-15 02-19 04-13 05-28 07-04 09-03 09-11 09-12 09-13 09-14 11-22 12-25",
    2004: "01-01 01-19 02-16 04-09 05-31 06-11 07-05 09-06 11-25 12-24",
    2011: "01-17 02-21 04-22 05-30 07-04 09-05 11-24 12-26",
    2012: "01-02 01-16 02-20 04-06 05-28 07-04 09-03 10-29 10-30 11-22 12-25",
    2018: "01-01 01-15 02-19 03-30 05-28 07-04 09-03 11-22 12-05 12-25",
    2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24",
    2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26",
    2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25",
    2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
    2025: "01-01 01-09 01-20 02-17 04-18 05-26 06-19 07-04 09-01 11-27 12-25",
}
HALF = {1996: "07-05 11-29 12-24", 2012: "07-03 11-23 12-24", 2013: "07-03 11-29 12-24", 2021: "11-26", 2024: "07-03 11-29 12-24"}


@pytest.fixture(scope="module")
def years(spark):
    return [r for r in calendar.session_days(spark, "1990-01-01", "2050-12-31").collect()]


def test_easter(spark):
    got = spark.range(1900, 2101).select(F.col("id").cast("int").alias("y")).select("y", calendar.easter(F.col("y")).alias("d")).collect()
    assert all(r.d == easter(r.y) for r in got)


def test_known_holidays(years):
    open_ = {r.d for r in years}
    for year, days in KNOWN.items():
        shut = [d.date() for d in pd.bdate_range(f"{year}-01-01", f"{year}-12-31") if d.date() not in open_]
        assert [f"{d:%m-%d}" for d in shut] == days.split(), year
    assert not any(d.weekday() > 4 for d in open_)
    count = pd.Series([r.d.year for r in years]).value_counts()
    assert [count[y] for y in (2001, 2012, 2018, 2019, 2020, 2021, 2022, 2023, 2024)] == [248, 250, 251, 252, 253, 252, 251, 250, 252]
    assert [r.seq for r in sorted(years, key=lambda r: r.d)] == list(range(1, len(years) + 1))


def test_half_days(years):
    for year, days in HALF.items():
        assert [f"{r.d:%m-%d}" for r in sorted(years, key=lambda r: r.d) if r.half_day and r.d.year == year] == days.split(), year


def test_calendars_of_other_rules(spark):
    days = spark.createDataFrame([("2024-07-02",)], "d string").select(F.col("d").cast("date").alias("d"))
    got = calendar.session_days(spark, "2024-07-01", "2024-07-08", closures=days).collect()
    assert [r.d.day for r in sorted(got, key=lambda r: r.d)] == [1, 3, 5, 8]
    plain = calendar.session_days(spark, "2024-07-01", "2024-07-08", holidays=[], half_days=[], closures=days.limit(0))
    assert plain.count() == 6 and not plain.where("half_day").count()
    assert calendar.session_days(spark, "2024-07-06", "2024-07-07").count() == 0
    assert calendar.observed_sessions(spark.createDataFrame([], "d date")).count() == 0


def test_neighbours(spark):
    days = calendar.session_days(spark, "2024-07-01", "2024-07-12")
    asked = ["2024-06-28", "2024-07-01", "2024-07-04", "2024-07-06", "2024-07-12", "2024-07-20", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(asked)], "i int, d string").withColumn("d", F.col("d").cast("date"))
    got = {r.i: (r.is_session, r.previous and r.previous.day, r.next and r.next.day, r.back and r.back.day) for r in calendar.neighbours(df, days, "d", {"back": 2}).collect()}
    # Without a session of its own a day counts back from the last one before it.
    assert got == {0: (False, None, 1, None), 1: (True, None, 2, None), 2: (False, 3, 5, 1), 3: (False, 5, 8, 2), 4: (True, 11, None, 10), 5: (False, 12, None, 10), 6: (None, None, None, None)}


def brute_replay(series, days):
    """Rows of one series, recomputed on each session from all that is visible on it."""
    rows = []
    for i, day in enumerate(days):
        native = series[series.index <= day]
        if native.empty:
            continue
        seen = [series[series.index <= d].iloc[-1] for d in days[: i + 1] if (series.index <= d).any()]
        ref = native.iloc[-252:]
        z = pct = None
        if len(native) >= 30:
            z = 0.0 if ref.std() == 0 else (native.iloc[-1] - ref.mean()) / ref.std()
            pct = (ref < native.iloc[-1]).mean() * 100
        source = native.index[-1]
        change = {k: seen[-1] - seen[-1 - k] if len(seen) > k else None for k in replay.WINDOWS}
        rows.append((day.date(), native.iloc[-1], z, pct, len(native), source.date(), source != day, max(0, sum(source <= d <= day for d in days) - 1), change))
    return rows


def compare(got, want):
    got = sorted(got, key=lambda r: r.report_date)
    assert len(got) == len(want)
    near = lambda a, b, tolerance: (a is None) == (b is None) and (a is None or abs(a - b) <= tolerance)
    for g, w in zip(got, want, strict=True):
        assert (g.report_date, g.effective_obs, g.sample_len, g.source_date, g.is_filled, g.lag_days) == (w[0], w[4], w[4], w[5], w[6], w[7])
        assert near(g.value, w[1], 1e-4) and near(g.zscore, w[2], 1e-3) and near(g.percentile, w[3], 0.051)
        assert all(near(g[f"chg_{k}d"], w[8][k], 1e-4) for k in replay.WINDOWS)


def test_replay_of_weekly_daily_and_sparse_series(spark):
    r = random.Random(6)
    made = {
        "nfci": pd.date_range("2024-01-05", periods=80, freq="W-FRI"),
        "vix": pd.date_range("2024-11-01", periods=200, freq="D"),  # weekends and holidays too
        "move": pd.DatetimeIndex(["2025-05-24", "2025-05-25", "2025-06-07", "2025-06-30"]),  # two before any session, one after the last
        "dxy": pd.DatetimeIndex(["2025-07-30"]),
    }
    series = {m: pd.Series([r.gauss(0, 1) for _ in index], index=index) for m, index in made.items()}
    rows = [("MACRO", m, d.date(), float(v)) for m, s in series.items() for d, v in s.items()] + [("MACRO", "vix", dt.date(2025, 6, 4), float("nan")), ("MACRO", "unknown", dt.date(2025, 6, 4), 1.0)]
    rows = [x for x in rows if not (x[1] == "vix" and x[2] == dt.date(2025, 6, 4) and x[3] == x[3])]
    series["vix"] = series["vix"].drop(pd.Timestamp("2025-06-04"), errors="ignore")
    facts = spark.createDataFrame(rows, "scope string, metric string, d date, value double").repartition(5)
    sessions = calendar.session_days(spark, "2025-05-27", "2025-06-20")
    days = [pd.Timestamp(x.d) for x in sessions.orderBy("d").collect()]
    assert pd.Timestamp("2025-06-19") not in days
    got = replay.replay(facts, sessions).collect()
    assert {x.metric for x in got} == {"nfci", "vix", "move"}
    for metric in ("nfci", "vix", "move"):
        compare([x for x in got if x.metric == metric], brute_replay(series[metric], days))
    assert any(x.is_filled for x in got if x.metric == "nfci")
    assert replay.replay(facts, sessions.limit(0)).count() == 0 and replay.replay(facts.limit(0), sessions).count() == 0


def test_filled_sessions_add_no_observations(spark):
    """80 Fridays, ten sessions."""
    fridays = pd.date_range("2024-01-05", periods=80, freq="W-FRI")
    facts = spark.createDataFrame([("MACRO", "nfci", d.date(), -0.5 + 0.7 * i / 79) for i, d in enumerate(fridays)], "scope string, metric string, d date, value double")
    got = replay.replay(facts, calendar.session_days(spark, "2025-06-02", "2025-06-13")).collect()
    assert len(got) == 10
    for r in got:
        assert r.effective_obs == r.sample_len == sum(d.date() <= r.report_date for d in fridays)
        assert r.is_filled == (r.report_date.weekday() != 4)


def test_replay_crosses_no_series_with_the_calendar(spark):
    """The plan has no cross join of rows with rows, and shuffles by the series' keys alone."""
    facts = spark.range(100).select(F.lit("MACRO").alias("scope"), F.lit("vix").alias("metric"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.col("id").cast("double").alias("value"))
    plan = replay.replay(facts, calendar.session_days(spark, "2024-01-01", "2024-06-01"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
