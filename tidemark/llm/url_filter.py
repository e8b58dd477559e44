"""URL filters (operator 9), native: a blocked Bloom filter in front of an exact hash join.

The list's canonical URLs set ``PROBES`` bits in one 64-bit block each; the blocks are a
two-column table.  A page whose block holds all its bits is a possible hit and goes to an
exact join with the list, which removes false positives; every other page is in no join but
the filter's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
PROBES = 4
#: The filter is broadcast up to this many 64-bit blocks (at 16 bytes each), and shuffled beyond.
MAX_BROADCAST_BLOCKS = 1 << 19

#: (host, path prefix, verdict), as the query's contract gives them.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host_: Column, path_: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last ``.html`` or ``/``; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host_, r"^(www|m)\.", ""), F.regexp_replace(path_, r"(\.html|/)$", ""))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host_ == name) | F.endswith(host_, F.lit(f".{name}"))) & F.startswith(path_, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def _bits(url: Column) -> Column:
    hashed = F.xxhash64(F.lit(9), url)
    bits = [F.expr("1L").alias("one")]
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        at = F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", bits[0], at))
    return mask


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the filter over the column ``canonical``."""
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("canonical"))).alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row of ``pages``.

    ``listed`` has a column ``canonical`` of blocked canonical URLs; nulls, empty strings and
    repeats in it count for nothing.  A rule that fits decides; else a listed page is blocked
    and any other allowed.  A null url, or one without ``://``, has empty host and path, fits
    no rule and is allowed.  Repeated pages are judged one by one, other columns are ignored,
    and empty tables give empty results (an empty list blocks nothing).
    """
    listed = listed.select("canonical").where("canonical <> ''").distinct()
    blocks = 1 << max(0, (max(1, listed.count()) * BITS_PER_URL // 64 - 1).bit_length())
    filter_ = bloom_blocks(listed, blocks)
    if blocks <= MAX_BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    parts = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    parts = parts.withColumns({"block": _block(F.col("canonical"), blocks), "want": _bits(F.col("canonical"))})
    maybe = F.col("bits").bitwiseAND(F.col("want")) == F.col("want")
    probed = parts.join(filter_, "block", "left").withColumn("maybe", F.coalesce(maybe, F.lit(False)))
    exact = listed.select("canonical", F.lit(True).alias("listed"))
    hits = probed.where("maybe").join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    both = hits.unionByName(probed.where("not maybe").withColumn("listed", F.lit(False)))
    both = both.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return both.select(
        id_col, "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
