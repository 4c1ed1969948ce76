"""Saved exchange klines: JSON arrays whose first element is a time in ms, followed by text numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIELDS = ["open", "high", "low", "close", "volume"]


def decode(df: DataFrame, column: str) -> DataFrame:
    """Adds ts and the five numbers from a column of one-kline JSON arrays."""
    parts = F.from_json(column, "array<string>")
    return df.withColumn("_k", parts).select(*df.columns, F.element_at("_k", 1).cast("long").alias("ts"), *(F.element_at("_k", i + 2).cast("double").alias(f) for i, f in enumerate(FIELDS))).drop(column)


def read_pages(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars from saved response pages, each a JSON array of klines; repeated open times count once."""
    pages = spark.read.text(path, wholetext=True)
    rows = pages.select(F.explode(F.from_json("value", "array<array<string>>")).alias("_k"))
    out = rows.select(F.lit(symbol).alias("symbol"), F.element_at("_k", 1).cast("long").alias("ts"), *(F.element_at("_k", i + 2).cast("double").alias(f) for i, f in enumerate(FIELDS)))
    return out.dropDuplicates(["symbol", "ts"])
