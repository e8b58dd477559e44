"""Time-series functions over one ordered window per series.

Every function takes a window spec partitioned by the series' key and ordered by date.
Frames are bounded, so a series is processed as a stream of rows within its partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASELINE, LEAST = 252, 30


def count_so_far(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def zscore(value: Column, w: WindowSpec, size: int = BASELINE, least: int = LEAST) -> Column:
    """Trailing z including the current row; null below ``least`` rows, 0 without spread."""
    frame = w.rowsBetween(1 - size, 0)
    spread = F.stddev_samp(value).over(frame)
    z = F.when(spread > 0, (value - F.avg(value).over(frame)) / spread).otherwise(0.0)
    return F.when(count_so_far(w) >= least, z)


def percentile(value: Column, w: WindowSpec, size: int = BASELINE, least: int = LEAST, inclusive: bool = False) -> Column:
    """Share of the trailing rows below (or, inclusive, not above) the current one, in percent.

    The inclusive form gives 50 for a flat window.
    """
    frame = F.collect_list(value).over(w.rowsBetween(1 - size, 0))
    held = F.filter(frame, (lambda x: x <= value) if inclusive else (lambda x: x < value))
    share = F.size(held) / F.size(frame) * 100
    if inclusive:
        share = F.when(F.array_min(frame) == F.array_max(frame), 50.0).otherwise(share)
    return F.when(count_so_far(w) >= least, share)


def change(value: Column, w: WindowSpec, rows: int) -> Column:
    return value - F.lag(value, rows).over(w)


def pct_change(value: Column, w: WindowSpec, rows: int) -> Column:
    return F.try_divide(value, F.lag(value, rows).over(w)) * 100 - 100


def run_length(hit: Column, w: WindowSpec) -> Column:
    """Rows up to the current one that hit without a break."""
    row = F.row_number().over(w)
    last_miss = F.max(F.when(~F.coalesce(hit, F.lit(False)), row)).over(w.rowsBetween(-(1 << 63), 0))
    return row - F.coalesce(last_miss, F.lit(0))


def fill_forward(value: Column, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(-(1 << 63), 0))


def quality(observations: Column, lag: Column, base: int = BASELINE, tolerance: int = 0) -> Column:
    """Sample sufficiency times freshness: 15 % off per session beyond the tolerance."""
    return F.least(F.lit(1.0), observations / float(base)) * F.pow(F.lit(0.85), F.greatest(F.lit(0), lag - tolerance))


def ordered_sum(entries: Column, term: Callable[[Column], Column]) -> Column:
    """Sum of a term over an array's entries, added from the first to the last; 0 for none."""
    return F.aggregate(entries, F.lit(0.0), lambda total, x: total + term(x))


def rounded(value: Column, places: int) -> Column:
    """A double as SQL rounds it: scaled, then to a whole number; ``F.round`` rounds the shortest text instead."""
    return F.round(value * 10.0**places) / 10.0**places


def compare(op: Column, value: Column, bound: Column) -> Column:
    """A comparison whose operator is data; a null value never hits."""
    hit = F.when(op == "<", value < bound).when(op == "<=", value <= bound).when(op == ">", value > bound).when(op == ">=", value >= bound)
    return F.coalesce(hit, F.lit(False))


def rolling_z_or_zero(value: Column, w: WindowSpec, size: int = BASELINE) -> Column:
    """Rolling z that answers 0 instead of null: too few rows (max(30, half of those there are)), or no spread."""
    frame = w.rowsBetween(1 - size, 0)
    n = F.count(value).over(frame)
    total = F.count(value).over(w.rowsBetween(-(1 << 63), (1 << 63) - 1))
    least = F.greatest(F.lit(LEAST), F.floor(F.least(F.lit(size), total) / 2))
    z = F.try_divide(value - F.avg(value).over(frame), F.nullif(F.stddev_samp(value).over(frame), F.lit(0.0)))
    return F.coalesce(F.when(n >= least, z), F.lit(0.0))


def sign_flip(value: Column, w: WindowSpec, rows: int = 1) -> Column:
    """Whether the value's sign is the opposite of that so many rows before; zero and null flip nothing."""
    return F.coalesce(F.signum(value) * F.signum(F.lag(value, rows).over(w)) < 0, F.lit(False))


def moving_average(value: Column, w: WindowSpec, rows: int) -> Column:
    return F.avg(value).over(w.rowsBetween(1 - rows, 0))


#: Rows of a series that are ranked together; each block also holds the rows before it that its windows reach.
BLOCK = 8192


def rolling_stats(rows: DataFrame, keys: list[str], size: int = BASELINE, least: int = LEAST, value: str = "value", inclusive: bool = False) -> DataFrame:
    """``rows``, (keys, value, n) among others with n the row's number in its series, with z and pct.

    The same as ``zscore`` and ``percentile``, in numpy over blocks of a series: a frame that slides
    by one row is not summed and copied anew for each row, and no task holds more than a block.
    A null value gets nulls and doesn't count in others' frames.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("z", T.DoubleType()), T.StructField("pct", T.DoubleType())])
    names = rows.columns
    at = F.col("n") - 1
    spilled = F.when(at % BLOCK >= BLOCK - (size - 1), F.array(F.floor(at / BLOCK), F.floor(at / BLOCK) + 1)).otherwise(F.array(F.floor(at / BLOCK)))

    def stats(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        number = table["n"].to_numpy()
        z, pct = _frames(table[value].to_numpy(zero_copy_only=False).astype(np.float64), size, inclusive)
        few = (number < least) | np.isnan(pct)
        out = [*(table[c] for c in names), pa.array(z, mask=few), pa.array(pct, mask=few)]
        return pa.table(out, names=[*names, "z", "pct"]).filter(pa.array(number > key[-1].as_py() * BLOCK))

    return rows.withColumn("_block", F.explode(spilled)).groupBy(*keys, "_block").applyInArrow(stats, schema)


def _frames(value: np.ndarray, size: int, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
    """z and pct of each value in the frame of so many values that ends with it; NaN stands for null."""
    z, pct = np.full(len(value), np.nan), np.full(len(value), np.nan)
    for a in range(0, len(value), 1024):
        b = min(a + 1024, len(value))
        low = max(0, a - size + 1)
        frame = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1 - (a - low), np.nan), value[low:b]]), size)
        own, known = value[a:b], ~np.isnan(frame)
        held = known.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(known, frame, 0.0).sum(1) / held
            spread = np.sqrt(np.where(known, (frame - mean[:, None]) ** 2, 0.0).sum(1) / np.maximum(held - 1, 1))
            flat = np.where(known, frame, -np.inf).max(1) == np.where(known, frame, np.inf).min(1)
            z[a:b] = np.where(flat, 0.0, (own - mean) / np.where(flat, 1.0, spread))
            share = ((frame <= own[:, None]) if inclusive else (frame < own[:, None])).sum(1) / held * 100
        pct[a:b] = np.where(np.isnan(own), np.nan, np.where(flat & inclusive, 50.0, share))
    return z, pct
