"""Tables laid out for their joins: hashed and sorted by their key, checked while they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a gamma bucket may have (fixed values).
GAMMA_BUCKETS = ["0DTE", "1-7D", "8-30D", "31-60D", "ALL"]
#: Columns of the unified view that come from the table after the close, and those of the other that are renamed or left out (fixed values).
POST = {"current_price": "close_price", "poc_price": "poc_price", "obv_status": "obv_status", "ivr_pct": "ivr_pct", "as_of_time": "post_as_of_time"}
PRE = {"current_price": "pre_price", "as_of_time": "pre_as_of_time"}
PRE_WITHOUT = ["source_date", "ingested_at"]


def checked(df: DataFrame, keys: list[str], needed: list[str] | None = None, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """``df``, whose evaluation fails at a row that breaks the table's rules.

    No key occurs twice, keys and ``needed`` columns aren't null, and columns of ``allowed`` hold
    one of their values or null.  The check of keys uses the layout by key that the write needs anyway.
    """
    c = F.col
    broken = [(c(k).isNull(), f"{k} is null") for k in [*keys, *(needed or [])]]
    broken += [(~c(k).isin(values), f"{k} isn't one of its values") for k, values in (allowed or {}).items()]
    broken.append((c("_same") > 1, f"{', '.join(keys)} occurs twice"))
    fault: Column = F.lit(None).cast("string")
    for hit, text in reversed(broken):
        fault = F.when(hit, F.lit(text)).otherwise(fault)
    told = F.concat(F.lit("broken rule: "), c("_fault"), F.lit(" at "), F.to_json(F.struct(*keys)))
    rows = df.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_fault", fault)
    return rows.where(F.when(c("_fault").isNull(), True).otherwise(F.raise_error(told).cast("boolean"))).drop("_same", "_fault")


def write(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None, needed: list[str] | None = None, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Stores ``df`` as ``table`` in ``buckets`` files, cut by a hash of ``keys`` and sorted by them; the stored table.

    One shuffle puts a bucket into one task, checks its rows (see ``checked``) and writes its file.
    Tables with the same keys and number of buckets are joined by these keys without a shuffle; by
    ``keys`` without nulls and repeats no bucket is hot.  Choose ``buckets`` so that a file holds some
    hundred megabytes.  A write that fails leaves no table.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    laid = checked(df.repartition(buckets, *keys), keys, needed, allowed)
    try:
        laid.sortWithinPartitions(*keys).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table, **({"path": path} if path else {}))
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise
    return spark.table(table)


def _unified(pre: list[str], post: list[str], keys: list[str]) -> list[str]:
    """The view's columns as SQL over ``pre`` and ``post``; columns that a table lacks are left out."""
    shown = [f"coalesce(pre.`{k}`, post.`{k}`) AS `{k}`" for k in keys]
    shown += [f"post.`{c}` AS `{name}`" for c, name in POST.items() if c in post]
    taken = {*keys, *POST.values()}
    names = {c: PRE.get(c, c) for c in pre if c not in keys and c not in PRE_WITHOUT}
    return shown + [f"pre.`{c}` AS `{name}`" for c, name in names.items() if name not in taken]


def unified_view(pre: DataFrame, post: DataFrame, name: str, keys: list[str], pre_table: str, post_table: str) -> None:
    """Makes or replaces the view ``name``: both tables' rows by key, each with its own time; spot columns are those after the close."""
    on = " AND ".join(f"pre.`{k}` = post.`{k}`" for k in keys)
    pre.sparkSession.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {', '.join(_unified(pre.columns, post.columns, keys))} FROM {pre_table} pre FULL JOIN {post_table} post ON {on}")
