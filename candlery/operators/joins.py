"""Joins in time: the last closed bar of a longer timeframe, and merges of ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .candles import MS, indexed


def asof_closed(base: DataFrame, htf: DataFrame, minutes: int, value_columns: list[str]) -> DataFrame:
    """base with the columns of the longest-timeframe bar that has closed by each bar's start; null before there is one.

    A union and one window, in the order of time with closes before starts, so each symbol is read once; no pair of
    bars is formed. The values must not be null themselves.
    """
    columns = [c for c in base.columns if c not in value_columns]
    left = base.select(*columns, F.col("bar_ts").alias("_t"), F.lit(1).alias("_side"))
    right = htf.select("symbol", (F.col("bar_ts") + minutes * MS).alias("_t"), F.lit(0).alias("_side"), F.struct(*value_columns).alias("_v"))
    w = W.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*columns, *(F.col(f"_v.{c}").alias(c) for c in value_columns))


def range_join_closed(base: DataFrame, htf: DataFrame, minutes: int) -> DataFrame:
    """The same index by a range join, in which only starts of the same or the two days before can meet.

    For a timeframe up to a day; keys of symbol and day make it an equi-join, so no side is broadcast.
    """
    day = 1440 * MS
    closed = indexed(htf).select("symbol", F.col("i").alias("idx"), (F.col("bar_ts") + minutes * MS).alias("closes"))
    last = closed.groupBy("symbol", F.floor(F.col("closes") / day).alias("day")).agg(F.max("idx").alias("last"))
    base = base.withColumn("day", F.floor(F.col("bar_ts") / day))
    today = base.join(closed.withColumn("day", F.floor(F.col("closes") / day)), ["symbol", "day"], "left")
    today = today.groupBy("symbol", "day", "bar_ts").agg(F.max(F.when(F.col("closes") <= F.col("bar_ts"), F.col("idx"))).alias("idx"))
    days = base.select("symbol", "day").distinct().unionByName(last.select("symbol", "day")).distinct().join(last, ["symbol", "day"], "left")
    before = days.withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy("symbol").orderBy("day").rowsBetween(W.unboundedPreceding, -1)))
    return today.join(before.select("symbol", "day", "before"), ["symbol", "day"]).select("symbol", "bar_ts", F.coalesce("idx", "before").alias("idx"))


def merge_ordered(a: DataFrame, b: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Full outer join of two lists on key and the place within the key; diverges where one side lacks the entry."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    x = a.withColumn("place", place).select(*key, "place", F.lit(True).alias("in_a"))
    y = b.withColumn("place", place).select(*key, "place", F.lit(True).alias("in_b"))
    out = x.join(y, [*key, "place"], "full_outer")
    return out.select(*key, "place", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b")).withColumn("diverges", F.col("in_a") != F.col("in_b"))


def slope(ma: Column, back: int) -> Column:
    """Change over `back` bars of the series itself, as a share of now."""
    past = F.lag(ma, back).over(W.partitionBy("symbol").orderBy("bar_ts"))
    return (ma - past) / F.nullif(ma, F.lit(0.0))
