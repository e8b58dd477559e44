"""An exchange's sessions from rules: holidays, observed shifts, half days, extra closures.

A calendar has one row a session, some 250 a year.  Looking a date up is a broadcast join with
one row a day of the calendar's span; nothing is computed row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weekdays counted from Monday as 0.
MONDAY, WEDNESDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = 0, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Rule:
    """A day of each year from ``since`` to ``until``: a date, the nth weekday of a month (-1: the last), or a distance from Easter.

    A date on a Saturday moves by ``saturday`` days and one on a Sunday by ``sunday``; None drops
    it.  With ``only``, the day counts on these weekdays alone.
    """

    name: str
    month: int = 0
    day: int = 0
    nth: int = 0
    weekday: int = 0
    after: int = 0
    easter: int | None = None
    saturday: int | None = 0
    sunday: int | None = 0
    only: tuple[int, ...] = ()
    since: int = 0
    until: int = 9999


#: The New York exchange's full holidays since 1990.
HOLIDAYS = [
    Rule("new year", 1, 1, saturday=None, sunday=1),
    Rule("king", 1, nth=3, weekday=MONDAY, since=1998),
    Rule("presidents", 2, nth=3, weekday=MONDAY),
    Rule("good friday", easter=-2),
    Rule("memorial", 5, nth=-1, weekday=MONDAY),
    Rule("juneteenth", 6, 19, saturday=-1, sunday=1, since=2022),
    Rule("independence", 7, 4, saturday=-1, sunday=1),
    Rule("labor", 9, nth=1, weekday=MONDAY),
    Rule("thanksgiving", 11, nth=4, weekday=THURSDAY),
    Rule("christmas", 12, 25, saturday=-1, sunday=1),
]
#: Its days that end early, where they are sessions.
HALF_DAYS = [
    Rule("before independence", 7, 3, only=(MONDAY, 1, THURSDAY), since=1995),
    Rule("before independence", 7, 3, only=(WEDNESDAY,), since=2013),
    Rule("after independence", 7, 5, only=(FRIDAY,), since=1995, until=2012),
    Rule("after thanksgiving", 11, nth=4, weekday=THURSDAY, after=1, since=1993),
    Rule("christmas eve", 12, 24, only=(MONDAY, 1, WEDNESDAY, THURSDAY), since=1993),
]
#: Its closures that no rule gives.
CLOSURES = [
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
]


def easter(year: Column) -> Column:
    """Easter Sunday in the Gregorian calendar, by golden number, solar and lunar corrections and the paschal moon's weekday."""
    century, golden = F.floor(year / 100), year % 19
    solar, lunar = century - F.floor(century / 4), F.floor((8 * century + 13) / 25)
    epact = (19 * golden + solar - lunar + 15) % 30
    # Two late moons are one day earlier.
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    march = F.make_date(year, F.lit(3), F.lit(21))
    full = F.date_add(march, moon.cast("int"))
    return F.date_add(full, 7 - (F.weekday(full) + 1) % 7)


def rule_day(rule: Rule, year: Column) -> Column:
    """The rule's day of a year, null where it has none."""
    if rule.easter is not None:
        day = F.date_add(easter(year), rule.easter)
    elif rule.nth:
        first = F.make_date(year, F.lit(rule.month), F.lit(1))
        if rule.nth < 0:
            last = F.last_day(first)
            day = F.date_sub(last, F.pmod(F.weekday(last) - rule.weekday, F.lit(7)))
        else:
            day = F.date_add(first, F.pmod(rule.weekday - F.weekday(first), F.lit(7)) + 7 * (rule.nth - 1))
        day = F.date_add(day, rule.after)
    else:
        day = F.make_date(year, F.lit(rule.month), F.lit(rule.day))
        moved = lambda by: F.lit(None).cast("date") if by is None else F.date_add(day, by)  # noqa: B023, E731
        day = F.when(F.weekday(day) == SATURDAY, moved(rule.saturday)).when(F.weekday(day) == SUNDAY, moved(rule.sunday)).otherwise(day)
    held = year.between(rule.since, rule.until)
    if rule.only:
        held = held & F.weekday(day).isin(*rule.only)
    return F.when(held, day)


def rule_days(years: DataFrame, rules: list[Rule]) -> DataFrame:
    """(d, name) of the rules in each row's ``year``."""
    days = F.array(*(F.struct(rule_day(r, F.col("year")).alias("d"), F.lit(r.name).alias("name")) for r in rules))
    return years.select(F.inline(days)).where("d is not null").distinct()


def sessions(span: DataFrame, holidays: list[Rule] | None = None, half_days: list[Rule] | None = None, closures: DataFrame | None = None) -> DataFrame:
    """(d, seq, half_day): the sessions of ``span``, one row (first, last), numbered from 1.

    ``closures`` has a column ``d`` of days that are closed besides the rules' (by default those
    of ``CLOSURES``).  A span with null ends, or an empty one, has no sessions.
    """
    spark = span.sparkSession
    holidays, half_days = HOLIDAYS if holidays is None else holidays, HALF_DAYS if half_days is None else half_days
    closures = spark.createDataFrame([(d,) for d in CLOSURES], "d string").select(F.col("d").cast("date")) if closures is None else closures.select("d")
    span = span.where("first <= last")
    days = span.select(F.explode(F.sequence("first", "last")).alias("d")).where(F.weekday("d") < SATURDAY)
    years = span.select(F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year"))
    open_ = days
    if holidays:
        open_ = open_.join(F.broadcast(rule_days(years, holidays).select("d")), "d", "left_anti")  # a dozen rows a year
    open_ = open_.join(F.broadcast(closures), "d", "left_anti")
    if half_days:
        early = rule_days(years, half_days).select("d", F.lit(True).alias("half_day")).distinct()
        open_ = open_.join(F.broadcast(early), "d", "left")
    else:
        open_ = open_.withColumn("half_day", F.lit(False))
    return open_.select("d", F.row_number().over(Window.orderBy("d")).alias("seq"), F.coalesce("half_day", F.lit(False)).alias("half_day"))


def session_days(spark: SparkSession, first: str, last: str, **rules) -> DataFrame:
    """``sessions`` from one day to another."""
    return sessions(spark.range(1).select(F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")), **rules)


def observed_sessions(observations: DataFrame, before: int = 0, after: int = 0, date: str = "d", **rules) -> DataFrame:
    """``sessions`` from so many days before the first observation to so many after the last; none without observations."""
    span = observations.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return sessions(span.select(F.date_sub("first", before).alias("first"), F.date_add("last", after).alias("last")), **rules)


def ordinals(calendar: DataFrame) -> DataFrame:
    """(d, upto, before): on each day from the first session to the last, how many sessions there are up to it, and before it."""
    span = calendar.agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first is not null")
    days = span.select(F.explode(F.sequence("first", "last")).alias("d")).join(calendar.select("d", F.lit(1).alias("open")), "d", "left")
    upto = F.sum(F.coalesce("open", F.lit(0))).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return days.select("d", upto.cast("int").alias("upto"), (upto - F.coalesce("open", F.lit(0))).cast("int").alias("before"))


def with_ordinals(df: DataFrame, calendar: DataFrame, dates: dict[str, str]) -> DataFrame:
    """``df`` with the struct (upto, before) of each date column under the name that ``dates`` gives it.

    A day before the first session has none up to it, one after the last has all before it; a
    null date has a null struct.
    """
    if not dates:
        return df
    days, total = ordinals(calendar), calendar.agg(F.max("d").alias("_last"), F.count("*").cast("int").alias("_all"))
    out = df.join(F.broadcast(total))
    for column, name in dates.items():
        own = F.broadcast(days.select(F.col("d").alias("_d"), F.struct("upto", "before").alias(name)))
        none, every = (F.struct(x.alias("upto"), x.alias("before")) for x in (F.lit(0), F.col("_all")))
        found = F.coalesce(F.col(name), F.when(F.col(column) > F.col("_last"), every).when(F.col(column).isNotNull(), none))
        out = out.join(own, F.col(column) == F.col("_d"), "left").withColumn(name, found).drop("_d")
    return out.drop("_last", "_all")


def lag_days(df: DataFrame, calendar: DataFrame, source: str, reference: str) -> DataFrame:
    """``df`` with lag_days: sessions in [source, reference] less one, at least 0; null if either date is null."""
    rows = with_ordinals(df, calendar, {source: "_source", reference: "_reference"})
    known = F.col(source).isNotNull() & F.col(reference).isNotNull()
    return rows.select(*df.columns, F.when(known, F.greatest(F.lit(0), F.col("_reference.upto") - F.col("_source.before") - 1)).alias("lag_days"))


def neighbours(df: DataFrame, calendar: DataFrame, date: str, back: dict[str, int]) -> DataFrame:
    """``df`` with is_session, previous and next session of a date, and under each name in ``back`` the session so many before.

    That counts from the date's own session, or from the last before it; null before the calendar
    begins or after it ends.
    """
    rows = with_ordinals(df, calendar, {date: "_at"}).withColumn("is_session", F.col("_at.upto") > F.col("_at.before"))
    wanted = {"previous": F.col("_at.before"), "next": F.col("_at.upto") + 1} | {name: F.col("_at.upto") - n for name, n in back.items()}
    for name, place in wanted.items():
        own = F.broadcast(calendar.select(F.col("seq").alias("_seq"), F.col("d").alias(name)))
        rows = rows.join(own, place == F.col("_seq"), "left").drop("_seq")
    return rows.select(*df.columns, "is_session", *wanted)
