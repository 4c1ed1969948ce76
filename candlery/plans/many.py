"""Specs as rows: what is asked of one spec, asked of a table of them (id, and the spec as JSON) by Spark's tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import params as P, runtime as R
from .spec import SpecError, completed, spec_hash

#: Tasks for each core that specs are dealt to: a file of millions of specs may come as one task's rows.
TASKS_A_CORE = 4


def _spec(text: str | None) -> dict:
    """A valid spec of a text with its defaults, without its hash; else SpecError."""
    try:
        spec = json.loads(text)
    except (ValueError, TypeError):
        spec = None
    if not isinstance(spec, dict):
        raise SpecError("not a JSON object")
    return completed(spec)  # the text's own objects, so none are copied


def _dealt(specs: DataFrame) -> DataFrame:
    """id and spec, dealt to all cores: reading them takes far less time than judging them."""
    rows = specs.select(F.col("id").cast("long").alias("id"), F.col("spec").cast("string").alias("spec"))
    return rows.repartition(TASKS_A_CORE * specs.sparkSession.sparkContext.defaultParallelism, "id", "spec")


def per_spec(specs: DataFrame, schema: str, told: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """id and a row for each tuple told(valid spec) gives; specs that are not valid, and null ones, give none (see checked)."""
    target = to_arrow_schema(StructType.fromDDL("id long, " + schema))

    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    spec = _spec(text)
                except SpecError:
                    continue
                out += [(key, *row) for row in told(spec)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

    return _dealt(specs).mapInArrow(run, "id long, " + schema)


def checked(specs: DataFrame) -> DataFrame:
    """id, the spec's hash if it is valid, else all that is wrong with it, one line each."""

    def verdict(text):
        try:
            return spec_hash(_spec(text)), None
        except SpecError as e:
            return None, str(e)

    def run(batches):
        for batch in batches:
            found = [verdict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in range(2))], names=["id", "hash", "problems"])

    return _dealt(specs).mapInArrow(run, "id long, hash string, problems string")


def spaces(specs: DataFrame) -> DataFrame:
    """Each spec's free parameters."""
    return per_spec(specs, "param string, type string, min double, max double, step double", lambda s: [(i, t, float(a), float(b), float(c)) for i, t, a, b, c in P.derive(s)[0]])


def lookbacks(specs: DataFrame) -> DataFrame:
    """Bars of history by timeframe that each spec may need."""
    return per_spec(specs, "timeframe int, bars int", lambda s: P.lookback(s).items())


def slots(specs: DataFrame) -> DataFrame:
    """Each spec's slots in the order in which they act, with the parameters of its first gene."""
    return per_spec(specs, "place int, path string, kind string, block string, version int, params string",
                    lambda s: [(i, x.path, x.block.kind, x.block.id, x.block.version, json.dumps(x.p, sort_keys=True)) for i, x in enumerate(R.resolve(s, {}))])
