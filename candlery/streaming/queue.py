"""The run queue as rewrites of a runs table: Spark's files have no UPDATE, so each step is one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def claim(runs: DataFrame) -> DataFrame:
    """The pending run of highest priority, then least id, becomes running; runs to be cancelled are passed over."""
    free = (F.col("status") == "pending") & ~F.coalesce("cancel_requested", F.lit(False))
    chosen = runs.where(free).orderBy(F.desc("priority"), "id").limit(1).select("id", F.lit(True).alias("_chosen"))
    out = runs.join(F.broadcast(chosen), "id", "left")  # one row
    return out.withColumn("status", F.when(F.col("_chosen"), "running").otherwise(F.col("status"))).drop("_chosen")


def recover(runs: DataFrame, timeout: int) -> DataFrame:
    """Running runs without a heartbeat: completed if they have results, else pending again."""
    stale = (F.col("status") == "running") & (F.col("beat_age") > timeout)
    return runs.withColumn("status", F.when(stale & F.col("has_results"), "completed").when(stale, "pending").otherwise(F.col("status")))


def cancel(runs: DataFrame) -> DataFrame:
    asked = F.coalesce("cancel_requested", F.lit(False)) & F.col("status").isin("pending", "running")
    return runs.withColumn("status", F.when(asked, "cancelled").otherwise(F.col("status")))


def complete(runs: DataFrame, done: Column, failed: Column) -> DataFrame:
    running = F.col("status") == "running"
    return runs.withColumn("status", F.when(running & done, "completed").when(running & failed, "failed").otherwise(F.col("status")))
