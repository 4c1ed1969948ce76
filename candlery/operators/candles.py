"""Bars from ticks, and what is asked of a table of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MS = 60_000


def bucket(ms: Column | str, minutes: int) -> Column:
    """Start of the epoch-aligned bar that holds a time (weeks start on Thursday, months are 30 days)."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return (F.floor(ms / (minutes * MS)) * (minutes * MS)).cast("long")


def roll_up(ticks: DataFrame, minutes: int, start: int | None = None) -> DataFrame:
    """OHLCV bars: one partial and one final aggregate; `start` cuts ticks before they are dealt into bars."""
    if start is not None:
        ticks = ticks.where(F.col("ms") >= start)
    at = F.struct("ms", "seq")
    return ticks.groupBy("symbol", bucket("ms", minutes).alias("bar_ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))


def roll_up_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of a longer timeframe from shorter bars."""
    return bars.groupBy("symbol", bucket("bar_ts", minutes).alias("bar_ts")).agg(
        F.min_by("open", F.col("bar_ts")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.col("bar_ts")).alias("close"), F.sum("volume").alias("volume"))


def symbol_stats(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.min("ms").alias("first_ts"), F.max("ms").alias("last_ts"), F.count("*").alias("n"))


def merge_insert(staging: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of staging whose key target lacks, one for each key."""
    return staging.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def gap_report(bars: DataFrame, minutes: int) -> DataFrame:
    """Steps between neighbouring bars: how many aren't one bar, how many exceed three."""
    w = W.partitionBy("symbol").orderBy("bar_ts")
    step = F.col("bar_ts") - F.lag("bar_ts").over(w)
    steps = bars.select("symbol", "bar_ts", step.alias("step"))
    return steps.groupBy("symbol").agg(F.count_if(F.col("step") != minutes * MS).alias("uneven"), F.count_if(F.col("step") > 3 * minutes * MS).alias("holes"), F.max("step").alias("widest"))


def holes(bars: DataFrame, minutes: int, n: int = 20) -> DataFrame:
    """The first n steps of more than three bars."""
    w = W.partitionBy("symbol").orderBy("bar_ts")
    return bars.withColumn("step", F.col("bar_ts") - F.lag("bar_ts").over(w)).where(F.col("step") > 3 * minutes * MS).select("symbol", "bar_ts", "step").orderBy("bar_ts", "symbol").limit(n)


def update_gaps(stats: DataFrame, now: int, earliest: int) -> DataFrame:
    """Minutes missing after the last and before the first stored time."""
    return stats.select("symbol", F.ceil((now - F.col("last_ts")) / MS).alias("recent_gap"), F.greatest(F.lit(0), F.ceil((F.col("first_ts") - earliest) / MS)).alias("historical_gap"))


def indexed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", (F.row_number().over(W.partitionBy("symbol").orderBy("bar_ts")) - 1).cast("long"))


def start_bar(bars: DataFrame, start: int) -> DataFrame:
    """Index of the first bar at or after start: `bundle` is the number of bars if there is none, `runner` 0."""
    first = F.min(F.when(F.col("bar_ts") >= start, F.col("i")))
    return indexed(bars).groupBy("symbol").agg(F.coalesce(first, F.count("*")).alias("bundle"), F.coalesce(first, F.lit(0).cast("long")).alias("runner"))


def price_source(name: str) -> Column:
    """One of eight price series by name."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    known = {"open": o, "high": h, "low": l, "close": c, "volume": F.col("volume"), "hl2": (h + l) / 2, "hlc3": (h + l + c) / 3, "ohlc4": (o + h + l + c) / 4}
    if name not in known:
        raise ValueError(f"unknown price source {name!r}; known: {', '.join(known)}")
    return known[name]
