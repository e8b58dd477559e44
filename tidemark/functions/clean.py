"""Coercion and cleaning of raw values: only SQL NULL marks a missing value afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spellings of a missing value in text fields.
MISSING = ["", "-", ".", "null", "none", "nan", "n/a"]


def number(value: Column) -> Column:
    """Text or number to double; thousands commas are dropped, bad text, NaN and infinities become null."""
    text = F.regexp_replace(F.trim(value.cast("string")), ",", "")
    return finite(F.when(~F.lower(text).isin(MISSING), text).try_cast("double"))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def positive(value: Column) -> Column:
    return F.when((value > 0) & (value < float("inf")), value)


def magnitude(text: Column) -> Column:
    """``1.5B`` and the like to millions; K, M, B and T scale, a bare number counts units."""
    clean = F.upper(F.regexp_replace(F.trim(text), ",", ""))
    amount = F.regexp_extract(clean, r"^([0-9.]+)\s*([KMBT]?)$", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"^([0-9.]+)\s*([KMBT]?)$", 2)
    return amount * F.when(unit == "K", 1e-3).when(unit == "M", 1.0).when(unit == "B", 1e3).when(unit == "T", 1e6).otherwise(1e-6)


def first_positive(*values: Column) -> Column:
    """Price cascade: the first finite value above zero (zero counts as missing)."""
    return F.coalesce(*(positive(v) for v in values))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``, which should be total for a fixed result."""
    latest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def trading_days(df: DataFrame, keys: list[str], order: list[str], date: str = "d", value: str = "value") -> DataFrame:
    """Rows on weekdays with a finite value, one a key and date: of several such the last in ``order``."""
    finite_ = df.withColumn(value, finite(F.col(value).cast("double"))).where(F.col(value).isNotNull() & (F.weekday(date) < 5))
    return keep_last(finite_, [*keys, date], order)


def missing_fields(*columns: str) -> Column:
    """Names of the columns that hold no usable value, in the given order."""
    bad = [F.when(F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin(MISSING), F.lit(c)) for c in columns]
    return F.array_compact(F.array(*bad))


#: Price fields in the order in which they are tried.
CASCADES = {
    "quote": ["market", "close", "last"],
    "index": ["last", "close", "bid", "ask", "market", "latest_bar"],
}


def cascade(name: str) -> tuple[Column, Column]:
    """(price, field) of a named cascade over the fields' columns; in ``index`` zero counts as missing."""
    held = {c: finite(F.col(c)) for c in CASCADES[name]}
    if name == "index":
        held = {c: F.nullif(v, F.lit(0.0)) for c, v in held.items()}
    return F.coalesce(*held.values()), F.coalesce(*(F.when(v.isNotNull(), F.lit(c)) for c, v in held.items()), F.lit("missing"))


def normalised_history(df: DataFrame, date: str = "d", order: str = "ordinal") -> DataFrame:
    """Rows with a readable date, which loses its time zone; of a date the last row counts."""
    text = F.regexp_replace(F.trim(F.col(date).cast("string")), r"([T ].*)$", "")
    rows = df.withColumn(date, F.coalesce(text.try_cast("date"), F.try_to_date(text, "yyyyMMdd"))).where(F.col(date).isNotNull())
    return keep_last(rows, [date], [order])


def new_york(text: Column) -> Column:
    """A time in New York: text with a UTC offset is converted, text without one is taken to be there already."""
    zoned = text.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    local = F.try_to_timestamp(F.regexp_replace(text, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(zoned, F.from_utc_timestamp(text.try_cast("timestamp"), "America/New_York")).otherwise(local).cast("timestamp_ntz")


def period_days(text: Column) -> Column:
    """Days of a look-back such as ``2y`` or ``18mo``: years of 365 days, months of 30; null for other text."""
    clean = F.lower(text)
    count, unit = F.regexp_extract(clean, r"^(\d+)(y|mo)$", 1), F.regexp_extract(clean, r"^(\d+)(y|mo)$", 2)
    return F.when(unit != "", count.cast("int") * F.when(unit == "y", 365).otherwise(30))


def stamped(df: DataFrame, source_date: Column | None = None) -> DataFrame:
    """``df`` with source_date and as_of_time where it lacks them (by default its own date), and always a new ingested_at."""
    day = next((F.col(c) for c in ("date", "record_date", "d") if c in df.columns), F.lit(None))
    given = (source_date if source_date is not None else day).cast("string")
    held = {"source_date": given, "as_of_time": F.current_timestamp()}
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in held.items()} | {"ingested_at": F.current_timestamp()})
