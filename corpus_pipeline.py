"""A corpus pipeline: each stage takes documents and hands on what it keeps.

Every stage takes any other columns too, whatever their names, and hands them on; an empty table stays empty. Rows
without a doc_id stay unless their text is toxic, holds a benchmark's passage or is empty after cutting; repeated rows
share one fate; null texts and texts without words are never toxic, near another or contaminated.

Toxic documents go, one document of each near-duplicate group stays, repeated bytes are cut, documents with benchmark
passages go, and what is left is encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlery.llm import bpe, decontaminate, jaccard, suffix, toxicity
from candlery.llm.common import plain_names, scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more for toxicity."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group linked by five-word shingles at 0.75 or more."""
    return jaccard.one_of_each(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; documents of which nothing is left go."""
    rows, back = plain_names(docs, ("doc_id", "text", "n_chars"), ())
    out = suffix.dedup(rows).where("n_removed = 0 or n_removed < n_bytes")
    return back(out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and digests of those and of the text decoded from them; null has no tokens."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: Not expressible: byte-level repeats and BPE have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read back for the next."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
