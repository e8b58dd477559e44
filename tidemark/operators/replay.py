"""Snapshots of series of any frequency, replayed on an exchange's sessions.

Two grains meet in one plan.  z, percentile, severity and the number of observations belong to
a native observation, whose snapshot is taken once and carried; changes are those of the value
as it was visible on each session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from . import anomaly, calendar

#: Sessions over which a change is taken.
WINDOWS = (1, 5, 21, 63)


def carried(observations: DataFrame, sessions: DataFrame, keys: list[str], date: str = "d") -> DataFrame:
    """Each observation on every session from its own date until the next of its keys: (its columns, report_date, seq).

    A session sees one observation of a series, the last one not after it; an observation that a
    later one replaces before any session is seen by none.  Each observation is dealt out by
    itself over the range of its sessions: no series is crossed with the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    rows = observations.withColumn("_until", F.lead(date).over(w))
    rows = calendar.with_ordinals(rows, sessions, {date: "_from", "_until": "_to"})
    count = F.broadcast(sessions.agg(F.count("*").cast("int").alias("_all")))
    first, last = F.col("_from.before") + 1, F.coalesce(F.col("_to.before"), F.col("_all"))
    seen = rows.join(count).where(first <= last).withColumn("seq", F.explode(F.sequence(first, last)))
    days = F.broadcast(sessions.select("seq", F.col("d").alias("report_date")))
    return seen.join(days, "seq").select(*observations.columns, "report_date", "seq")


def replay(facts: DataFrame, sessions: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row a series and session from its first observation on.

    ``facts`` has (scope, metric, d, value) at the native frequency, one row a date; null, NaN and
    infinite values are no observations and metrics outside the registry are left out.
    ``sample_len`` and ``effective_obs`` count native observations, so filled sessions add none.
    Changes are null until there are enough sessions since the calendar's first or the series'.
    An empty calendar or no observations give no rows.
    """
    native = anomaly.snapshot(facts, registry).select("scope", "metric", "d", "value", "n", "z", "pct", "severity", "dist_to_thr", "days_in_risk")
    rows = carried(native, sessions, ["scope", "metric"])
    rows = calendar.lag_days(rows, sessions, "d", "report_date")
    w = Window.partitionBy("scope", "metric").orderBy("report_date")
    value = F.col("value")
    return rows.select(
        "scope", "metric", "report_date", F.round("value", 4).alias("value"), *(F.round(series.change(value, w, k), 4).alias(f"chg_{k}d") for k in WINDOWS),
        F.round("z", 3).alias("zscore"), F.round("pct", 1).alias("percentile"), "severity", "dist_to_thr", "days_in_risk", F.col("n").alias("sample_len"), F.col("n").alias("effective_obs"),
        F.col("d").alias("source_date"), (F.col("d") != F.col("report_date")).alias("is_filled"), "lag_days",
    )
