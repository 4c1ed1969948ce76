"""Evaluated genes kept across runs: a cache for each spec and dataset, asked before anything is simulated."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import dataset_id
from ..operators.tables import last_wins
from ..sources.sinks import MOST_CACHED, load_cache, save_cache
from . import search as S


def dataset_of(bars: DataFrame) -> str:
    """An id of the bars: which symbols, from when to when, how many, and the sum of their closes."""
    per = bars.groupBy("symbol").agg(F.min("bar_ts").alias("a"), F.max("bar_ts").alias("z"), F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("c"))
    rows = per.agg(F.array_sort(F.collect_list(F.to_json(F.struct("symbol", "a", "z", "n", "c")))).alias("all"))  # a row a symbol
    return rows.select(dataset_id(F.to_json("all"))).first()[0]


def key_of(gene: dict) -> str:
    """A gene's values in the order of their names."""
    return ",".join(f"{name}={float(gene[name]):g}" for name in sorted(gene) if name != "gene_id")


def evaluate(bars: DataFrame, spec: dict, genes: list[dict], folder: str, settings: dict | None = None, most: int = MOST_CACHED) -> DataFrame:
    """gene_id, gene_key, fitness (the mean score over symbols), metrics (JSON) and known (whether it came from the cache).

    Genes that the cache of this spec and these bars lacks are evaluated, in one job, and saved with it; those without
    a positive fitness aren't kept and are evaluated again. Equal genes are evaluated once.
    """
    spark = bars.sparkSession
    path = f"{folder.rstrip('/')}/{spec['hash']}/{dataset_of(bars)}"
    asked = spark.createDataFrame([(int(g.get("gene_id", k)), key_of(g)) for k, g in enumerate(genes)], "gene_id long, gene_key string")
    cache = load_cache(spark, path)
    there = {r.gene_key for r in asked.join(cache, "gene_key", "left_semi").collect()}  # of the genes given
    new = {key_of(g): g for g in genes if key_of(g) not in there}
    found = cache.withColumn("known", F.lit(True))
    if new:
        keys = spark.createDataFrame([(k, key) for k, key in enumerate(new)], "gene_id long, gene_key string")
        out = S.evaluate(bars, spec, [g | {"gene_id": k} for k, g in enumerate(new.values())], settings)
        metrics = F.to_json(F.struct(F.sum("trades").alias("trades"), F.sum("net").alias("net"), F.max("max_dd_pct").alias("max_dd_pct")))
        out = out.groupBy("gene_id").agg(F.avg("score").alias("fitness"), metrics.alias("metrics")).join(keys, "gene_id").select("gene_key", "fitness", "metrics")
        out = spark.createDataFrame(out.collect(), "gene_key string, fitness double, metrics string")  # a row a gene given
        both = last_wins(cache.withColumn("seq", F.lit(0)).unionByName(out.withColumn("seq", F.lit(1))), ["gene_key"], "seq")
        save_cache(both, path, most)
        found = found.join(out, "gene_key", "left_anti").unionByName(out.withColumn("known", F.lit(False)))
    return asked.join(found, "gene_key")
