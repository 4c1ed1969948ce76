"""Tables that are added to or replaced: bars, the fitness cache, trade lists and deployments."""

from __future__ import annotations

import hmac
import json
import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tables import keep_best
from .files import exists, hadoop, scratch
from .klines import read_pages

CACHE = "gene_key string, fitness double, metrics string"
MOST_CACHED = 50_000
MODES = ["dry-run", "paper", "live-stub"]
DEPLOYMENT = "run_id long, spec_hash string, symbol string, timeframe int, mode string, status string, secret_key string, max_position_size double, max_loss_per_day_usd double, config_json string, created_at timestamp"


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of files as they are."""
    rows.write.mode("append").parquet(path)


def insert_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Adds those rows whose keys the table lacks, each key once; the table is read by its key columns only."""
    rows = rows.dropDuplicates(keys)
    if exists(rows.sparkSession, path):
        rows = rows.join(rows.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    append(rows, path)


def ingest(spark: SparkSession, pages: str, symbol: str, path: str) -> None:
    """Saved kline pages of a symbol into the bars table; bars that are there stay."""
    insert_new(read_pages(spark, pages, symbol), path, ["symbol", "ts"])


def by_symbol(rows: DataFrame, path: str) -> None:
    """Adds rows to a table with a folder for each symbol."""
    rows.write.mode("append").partitionBy("symbol").parquet(path)


def _folder(spark: SparkSession, path: str, symbol: str) -> str:
    return f"{path.rstrip('/')}/symbol={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)}"


def delete_symbol(spark: SparkSession, path: str, symbol: str) -> bool:
    """Removes a symbol's folder from a table by symbol; no other file is touched or read. False if there was none."""
    system, place = hadoop(spark, _folder(spark, path, symbol))
    return bool(system.delete(place, True))


def delete_between(spark: SparkSession, path: str, symbol: str, first: int, last: int) -> None:
    """Removes a symbol's rows with ts from first to last: its folder alone is written anew, and gone if none are left."""
    rest = spark.read.option("basePath", path).parquet(_folder(spark, path, symbol)).where(~F.col("ts").between(first, last))
    staged = scratch(spark)
    rest.write.parquet(staged)  # what is overwritten can't be read meanwhile
    rest = spark.read.schema(rest.schema).parquet(staged)
    if rest.isEmpty():
        delete_symbol(spark, path, symbol)
    else:
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the finished versions of a table, the oldest first."""
    system, place = hadoop(spark, path)
    names = sorted(f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()) if system.exists(place) else []
    return [f"{path.rstrip('/')}/{n}" for n in names if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS")]


def save_cache(entries: DataFrame, path: str, most: int = MOST_CACHED) -> None:
    """The best entries with a positive finite fitness as a new version of the cache.

    Readers take the newest finished version, so there is always one, whole; the one before stays for those who read
    it now, and older ones go.
    """
    spark = entries.sparkSession
    there = _versions(spark, path)
    number = int(there[-1].rpartition("=")[2].split("-")[0]) + 1 if there else 0
    keep_best(entries.select("gene_key", "fitness", "metrics"), "fitness", most, ["gene_key"]).write.parquet(f"{path.rstrip('/')}/version={number:012d}-{uuid.uuid4().hex}")
    for old in _versions(spark, path)[:-2]:
        system, place = hadoop(spark, old)
        system.delete(place, True)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the cache; a missing one is empty, and damaged files count as missing."""
    there = _versions(spark, path)
    if not there:
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).option("ignoreCorruptFiles", True).parquet(there[-1])


def trade_rows(trades: DataFrame) -> DataFrame:
    """A trade list as people read it: twelve text columns with fixed decimals, numbered within each symbol and gene."""
    from pyspark.sql import Window as W

    def fixed(x, places):
        return F.when(x.isNotNull(), F.format_string(f"%.{places}f", F.round(x, places))).otherwise("")

    c, run = F.col, W.partitionBy("symbol", "gene_id").orderBy("exit_ts", "position", "signal")  # one run's trades
    at = lambda x: F.date_format(F.timestamp_millis(x), "yyyy-MM-dd HH:mm")
    return trades.select(
        "symbol", "gene_id", F.row_number().over(run).cast("string").alias("#"), c("direction").alias("Direction"), at("entry_ts").alias("Entry Date"), at("exit_ts").alias("Exit Date"), c("signal").alias("Signal"),
        fixed(c("entry_price"), 2).alias("Entry Price"), fixed(c("exit_price"), 2).alias("Exit Price"), fixed(c("units"), 4).alias("Size Asset"), fixed(c("units") * c("exit_price"), 2).alias("Size USDT"),
        fixed(c("risk"), 2).alias("Risk $"), fixed(c("pnl"), 2).alias("Net PnL"), fixed(c("pnl") / 100_000.0 * 100, 3).alias("PnL %"),
    )


def export_trades(trades: DataFrame, path: str) -> None:
    """CSV files with a header, a folder for each symbol and gene."""
    trade_rows(trades).write.partitionBy("symbol", "gene_id").mode("errorifexists").csv(path, header=True, emptyValue="")


def mint_secret() -> str:
    """32 random bytes in hexadecimal."""
    return secrets.token_hex(32)


def same_secret(a: str, b: str) -> bool:
    """Compared in a time that does not depend on where they differ."""
    return hmac.compare_digest(a.encode(), b.encode())


def deploy(spark: SparkSession, path: str, spec_hash: str, symbol: str, timeframe: int, mode: str | None = None, run_id: int | None = None,
           max_position_size: float | None = None, max_loss_per_day_usd: float | None = None, config: dict | None = None) -> DataFrame:
    """Adds a draft deployment with a new secret and returns its row as the table has it."""
    if not isinstance(spec_hash, str) or not spec_hash or not isinstance(symbol, str) or not symbol:
        raise ValueError("spec_hash and symbol are needed")
    if isinstance(timeframe, bool) or not isinstance(timeframe, int) or timeframe <= 0:
        raise ValueError("timeframe: whole minutes")
    mode = mode or "paper"
    if mode not in MODES:
        raise ValueError(f"mode: one of {', '.join(MODES)}")
    secret = mint_secret()
    row = (run_id, spec_hash, symbol, timeframe, mode, "draft", secret, max_position_size, max_loss_per_day_usd, None if config is None else json.dumps(config))
    fields = DEPLOYMENT.removesuffix(", created_at timestamp")
    append(spark.createDataFrame([row], fields).withColumn("created_at", F.current_timestamp()).coalesce(1), path)
    return spark.read.schema(DEPLOYMENT).parquet(path).where(F.col("secret_key") == secret)
