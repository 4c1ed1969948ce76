"""Exactly-once inserts from a stream: a table with a folder for each batch, and a ledger of the batches that are in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import first_of
from ..sources.files import exists, hadoop, write_text


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows; those of a batch that has not been entered in the ledger, if a write broke off, are left out."""
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in batches(spark, path)] or [path])
    return rows.drop("batch")


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches in the ledger."""
    system, place = hadoop(spark, f"{path}/_ledger")
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def insert_batch(rows: DataFrame, batch: str, path: str, keys: list[str], order: list[str], within: str | None = None) -> bool:
    """Adds those rows whose keys the table lacks, each key once, the first by `order`; False if the batch is in already.

    The ledger's entry comes last. A write that broke off before it is done over by the next attempt, in the same
    folder, so a batch is in the table once or not at all. within: a column of keys whose range in the batch bounds
    what is read of the table. One stream at a time may write to a table.
    """
    spark, entry = rows.sparkSession, f"{path}/_ledger/{batch}"
    if exists(spark, entry):
        return False
    rows = first_of(rows, keys, order)
    if batches(spark, path):
        known = read(spark, path)
        if within:
            low, high = rows.agg(F.min(within), F.max(within)).first()
            known = known.where(F.col(within).between(low, high)) if low is not None else known.limit(0)
        rows = rows.join(known.select(*keys), keys, "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    write_text(spark, entry, "", False)
    return True


def insert_stream(rows: DataFrame, name: str, path: str, keys: list[str], order: list[str], checkpoint: str, within: str | None = None) -> StreamingQuery:
    """All that the stream has now into the table; `name` tells its batches from other streams'. Run again it goes on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            insert_batch(batch, f"{name}-{number:012d}", path, keys, order, within)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def marks(table: DataFrame, key: str = "symbol", time: str = "ts") -> dict[str, int]:
    """The last stored time of each key: where a stream has to go on. A row a symbol comes to the driver."""
    return {r[0]: r[1] for r in table.groupBy(key).agg(F.max(time)).collect()}
