"""Engine inputs built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts (scope, metric, d, value): one series per order priority and metric, the most urgent as MACRO."""
    orders = table(spark, sf_dir, "orders")
    daily = orders.groupBy(
        F.when(F.col("o_orderpriority") == "1-URGENT", "MACRO").otherwise(F.col("o_orderpriority")).alias("scope"),
        F.to_date("o_orderdate").alias("d"),
    ).agg(
        F.sum((F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long")).alias("total"),
        (F.max(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("long").alias("most"),
        F.count("*").alias("n"),
    )
    # Whole cents and whole division give the same four decimals in every engine.
    metrics = {
        "vix": F.expr("total div 200") / 1e4, "move": F.expr("most div 30") / 1e4, "vix_contango_pct": F.expr("total div n div 400 - 20000") / 1e4,
        "pct_200ma": F.col("n") * 20.0, "credit_z": F.expr("(total - most) div 1000") / 1e4, "trin": F.col("n") / 2.0,
    }
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items())))
    return daily.select("scope", "d", long.alias("m")).select("scope", "m.metric", "d", "m.value")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, d, open, high, low, close, volume) of each brand, in cents and units."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    tick = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return lines.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("d")).agg(
        F.min_by(cents, tick).alias("open"), F.max(cents).alias("high"), F.min(cents).alias("low"), F.max_by(cents, tick).alias("close"),
        F.sum(F.col("l_quantity").cast("long")).alias("volume"),
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option contracts (ticker, dte, strike, cp, oi, iv): quantities by brand, ship day, price and line status."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice"), "l_partkey")
    return lines.groupBy(
        F.col("p_brand").alias("ticker"),
        (F.dayofyear("l_shipdate") % 70).alias("dte"),
        F.floor("p_retailprice").cast("double").alias("strike"),
        F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("cp"),
    ).agg(F.sum(F.col("l_quantity").cast("long")).alias("oi"), (F.max(F.col("l_discount").cast("decimal(9,2)")).cast("double") + 0.1).alias("iv"))
