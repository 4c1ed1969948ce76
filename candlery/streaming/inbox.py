"""The alert inbox: a stream of alerts, each logical signal once, late and early ones turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

ALERT = "deployment_id long, bar_time timestamp, received_at timestamp, timeframe int, action string, direction string, price double"


def timeliness(bar_ms: Column, received_ms: Column, minutes: Column) -> Column:
    """stale: older than two bars; future: a bar or more ahead; else ok."""
    age = received_ms - bar_ms
    return F.when(age > 2 * minutes * 60_000, "stale").when(-age >= minutes * 60_000, "future").otherwise("ok")


def first_alerts(alerts: DataFrame, order: str) -> DataFrame:
    """Of each deployment and key the first; in a batch."""
    return alerts.groupBy("deployment_id", "dedup_key").agg(F.min(order).alias(order))


def accepted(alerts: DataFrame, delay: str = "2 days") -> DataFrame:
    """Alerts in time, each logical signal once while the watermark remembers it; for a stream or a batch."""
    from ..functions.scalars import dedup_key

    ok = timeliness(F.unix_millis("bar_time"), F.unix_millis("received_at"), F.col("timeframe")) == "ok"
    rows = alerts.where(ok).withColumn("dedup_key", dedup_key(F.unix_millis("bar_time"), F.col("action"), F.col("direction")))
    if not alerts.isStreaming:
        return rows.dropDuplicates(["deployment_id", "dedup_key"])
    return rows.withWatermark("bar_time", delay).dropDuplicatesWithinWatermark(["deployment_id", "dedup_key"])


def run_inbox(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """All alert files there are, as JSON lines, into Parquet; run again it takes up where it stopped."""
    alerts = spark.readStream.schema(ALERT).json(source)
    return accepted(alerts).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars_stream(ticks: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Bars from a stream of ticks (symbol, t, price, volume): a bar comes out once, when the watermark has closed it."""
    w = F.window("t", f"{minutes} minutes")
    at = F.struct("t", "seq")
    bars = ticks.withWatermark("t", delay).groupBy("symbol", w.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.unix_millis("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def closed_windows(events: DataFrame) -> DataFrame:
    """Four-hour counts of windows that end by the latest event; what an append-mode stream would have put out."""
    e = events.withColumn("t", F.col("ts").cast("timestamp"))
    n = e.groupBy("event_type", F.window("t", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    last = e.agg(F.max("t").alias("last"))
    return n.join(F.broadcast(last), F.col("w.end") <= F.col("last")).select("event_type", F.unix_millis("w.start").alias("start"), "n")  # one row is broadcast
