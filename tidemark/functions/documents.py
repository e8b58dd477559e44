"""Documents whose fields come and go, as variants: parsed once, read by path, no schema declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document(text: Column) -> Column:
    """A JSON text as a variant; null where it is none, or holds anything but an object."""
    doc = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), doc)


def expanded(df: DataFrame, doc: str, fields: dict[str, str], kind: str = "double") -> DataFrame:
    """``df`` with a column for each field (name: its path); null where it is absent or can't be read as ``kind``.

    A column that is there already is kept where the document has no such value.
    """
    found = {}
    for name, path in fields.items():
        value = F.try_variant_get(F.col(doc), path, kind)
        found[name] = F.coalesce(value, F.col(name)) if name in df.columns else value
    return df.withColumns(found)


def source_dated(df: DataFrame, doc: str, nested: str, names: dict[str, str], oldest: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``<column>_source_date`` of those columns that it has, from the document's object ``nested`` by native name.

    ``oldest`` names columns made of others: theirs is the oldest date of those that are known,
    where ``df`` has all of them.
    """
    text = {f"{c}_source_date": F.try_variant_get(F.col(doc), f"$.{nested}.{native}", "string") for c, native in names.items() if c in df.columns}
    dated = df.withColumns({c: F.try_to_date(F.substring(v, 1, 10)) for c, v in text.items()})
    parts = {c: [f"{p}_source_date" for p in own] for c, own in (oldest or {}).items()}
    least = {f"{c}_source_date": F.least(*own) if len(own) > 1 else F.col(own[0]) for c, own in parts.items() if c in df.columns and set(own) <= set(dated.columns)}
    return dated.withColumns(least)


def kind_of(value: Column) -> Column:
    """What a variant holds: number, text, boolean, null, list or object."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(schema == "STRING", "text").when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null").when(F.startswith(schema, F.lit("ARRAY")), "list").otherwise("object")
    )


def fields(df: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """(keys, field, kind, n, low, high): which top-level fields the documents of each key have, of what kind, with the range of their numbers.

    Counts are summed map-side; a field that changes its kind has a row for each, and an empty
    document none.
    """
    each = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(doc).outer()))
    number = F.try_variant_get(F.col("value"), "$", "double")
    held = each.select(*keys, F.col("key").alias("field"), kind_of(F.col("value")).alias("kind"), number.alias("number"))
    return held.groupBy(*keys, "field", "kind").agg(F.count("*").alias("n"), F.min(F.when(F.col("kind") == "number", F.col("number"))).alias("low"), F.max(F.when(F.col("kind") == "number", F.col("number"))).alias("high"))
