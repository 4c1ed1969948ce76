"""Rows with a JSON payload: parsed once into a VARIANT column, which Parquet stores in columns by field.

A list of rows reads no payload, and a field of it reads that field's column alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def parsed(text: Column | str) -> Column:
    """JSON text as a variant; null for null, for what is no JSON, and for objects that name a field twice."""
    return F.try_parse_json(text)


def field(payload: str, path: str, kind: str) -> Column:
    """A value by its path ($.a.b[0]) as a SQL type; null where it is missing or is no such value."""
    return F.try_variant_get(payload, path, kind)


def save(rows: DataFrame, path: str, *texts: str) -> None:
    """Adds rows to a table, the columns named in texts as variants."""
    rows.withColumns({c: parsed(c) for c in texts}).write.mode("append").parquet(path)


def listing(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The rows without their payloads (or just `columns`): files are not asked for what is left out."""
    rows = spark.read.parquet(path)
    return rows.select(*(columns or [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.VariantType)]))


def lookup(spark: SparkSession, path: str, key: str, value, **fields: tuple[str, str, str]) -> DataFrame:
    """The rows whose key has that value, with fields of their payloads: name=(column, path, type)."""
    rows = spark.read.parquet(path).where(F.col(key) == value)
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.VariantType)]
    return rows.select(*plain, *(field(*of).alias(name) for name, of in fields.items()))
