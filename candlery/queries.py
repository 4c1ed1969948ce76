"""Queries over the driver's tables, one for each operator, with the SQL that each has to equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _load() -> tuple[dict, dict[str, str]]:
    from . import catalog
    from .catalog import bars, files, indicators, metrics, scalars, search, simulation, streams  # noqa: F401

    return catalog.QUERIES, catalog.ORACLES


def all_queries() -> dict:
    return dict(_load()[0])


def all_oracles() -> dict[str, str]:
    return dict(_load()[1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, moving averages, the last closed 4-hour bar and votes: signals by symbol."""
    return all_queries()["m0_signal_counts"](spark, sf_dir)
