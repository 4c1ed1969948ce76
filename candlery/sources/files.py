"""Folders and small files on any file system that Spark knows."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = hadoop(spark, path)
    return system.exists(place)


def replace(spark: SparkSession, made: str, path: str) -> None:
    """Puts a finished file in the place of another in one step: a reader finds the old one or the new one."""
    fs, sc = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
    how = sc._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    _, new = hadoop(spark, made)
    _, old = hadoop(spark, path)
    fs.FileContext.getFileContext(old.toUri() if old.toUri().getScheme() else fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()), sc._jsc.hadoopConfiguration()).rename(new, old, how)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """One small text file, whole or not at all; returns whether it was there before."""
    system, place = hadoop(spark, path)
    there = system.exists(place)
    if there and not overwrite:
        raise FileExistsError(path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    out = system.create(hadoop(spark, temporary)[1])
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    replace(spark, temporary, path)
    return there


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder (spark.checkpoint.dir), gone with the session; only in local runs without it a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="candlery-")
        atexit.register(shutil.rmtree, base, True)
    path = f"{base.rstrip('/')}/candlery-{uuid.uuid4().hex}"
    system, place = hadoop(spark, path)
    system.deleteOnExit(place)
    return path
