"""The driver's tables, and the tick series that stand in for a market feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOUR, DAY = 60, 1440  # minutes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # calendar rules and epoch times are UTC throughout
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column | str) -> Column:
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ms, seq, price, volume of the events table; seq breaks ties within a millisecond."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), millis("ts").alias("ms"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def ticks_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ticks by return flag; the four keys together break ties."""
    x = table(spark, sf_dir, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return x.select(F.col("l_returnflag").alias("symbol"), millis("l_shipdate").alias("ms"), seq.alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))


def trades_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade list: pnl in money, exit order by ship date and keys, and the regime at entry (null where unknown)."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_linestatus").alias("strategy"), millis("l_shipdate").alias("exit_ms"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.when(F.col("l_linenumber") < 6, F.col("l_returnflag")).alias("regime"), F.col("l_quantity").alias("units"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        F.when(F.col("l_discount") == 0.05, F.lit(0.0)).otherwise(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
    )


EXIT_ORDER = ["exit_ms", "k1", "k2", "k3", "k4"]
