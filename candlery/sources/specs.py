"""Spec files: a folder of JSON, one spec each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.spec import validate
from .files import exists, write_text

LISTED = "filename string, name string, description string, size_bytes long, modified timestamp"


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(specs, malformed): names, short descriptions, sizes and times, newest first; and files that aren't a spec, with why.

    A missing folder is an empty one.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], LISTED), spark.createDataFrame([], "filename string, error string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    text = F.decode("content", "UTF-8")
    parsed = F.from_json(text, "name string, description string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "modificationTime", parsed.alias("s"), F.get_json_object(text, "$.name").alias("named"))
    error = F.when(F.col("s._bad").isNotNull() | F.col("s").isNull(), "not a JSON object").when(F.col("named").isNull(), "no name")
    rows = rows.withColumn("error", error)
    short = F.when(F.length("s.description") > 280, F.concat(F.substring("s.description", 1, 280), F.lit("…"))).otherwise(F.col("s.description"))
    specs = rows.where("error is null").select("filename", F.col("s.name").alias("name"), short.alias("description"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return specs.orderBy(F.desc("modified"), "filename"), rows.where("error is not null").select("filename", "error")


def load(spark: SparkSession, path: str) -> dict:
    """One spec, validated; raises SpecError with all that is wrong, or ValueError if it is no JSON."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return validate(json.loads(rows[0].value))


def save(spark: SparkSession, spec: dict, folder: str, overwrite: bool = False) -> tuple[str, bool]:
    """Writes a valid spec without its hash under its name; (path, whether it replaced one). Raises FileExistsError unless told to overwrite."""
    valid = {k: v for k, v in validate(spec).items() if k != "hash"}
    path = f"{folder.rstrip('/')}/{valid['name']}.json"
    return path, write_text(spark, path, json.dumps(valid, indent=2) + "\n", overwrite)
