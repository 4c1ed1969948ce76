"""Specs as rows against the same asked one by one."""

import json

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from candlery.plans import many, params as P, runtime as R, search as S
from candlery.plans.spec import completed, spec_hash, validate


def test_specs_as_rows(spark):
    good = S.TREND
    texts = [json.dumps(good), json.dumps(good | {"name": "20240102-7-other--name"}), json.dumps(good | {"name": "no"}), "[1]", "{", None, json.dumps({k: v for k, v in good.items() if k != "sizing"}), json.dumps(good)]
    specs = spark.createDataFrame(list(enumerate(texts)), "id int, spec string").withColumn("hash", F.lit("own")).repartition(3)
    found = {r.id: r for r in many.checked(specs).collect()}
    assert found[0].hash == found[7].hash == validate(good)["hash"] and found[0].problems is None
    assert [found[k].hash is None for k in range(8)] == [False, False, True, True, True, True, found[6].hash is None, False]
    assert "isn't YYYYMMDD" in found[2].problems and found[4].problems == found[5].problems == "not a JSON object"
    valid = {k for k, r in found.items() if r.hash}
    free, _ = P.derive(validate(good))
    space = many.spaces(specs).collect()
    assert {r.id for r in space} == valid and sorted(tuple(r)[1:] for r in space if r.id == 0) == sorted((i, t, float(a), float(b), float(c)) for i, t, a, b, c in free)
    assert {tuple(r)[1:] for r in many.lookbacks(specs).where("id = 1").collect()} == set(P.lookback(validate(good)).items())
    assert [(r.place, r.path, r.block, json.loads(r.params)) for r in many.slots(specs).where("id = 0").orderBy("place").collect()] == [(i, s.path, s.block.id, s.p) for i, s in enumerate(R.resolve(validate(good), {}))]
    assert many.spaces(specs.limit(0)).count() == many.checked(specs.limit(0)).count() == 0


def test_windows_of_many_lengths(spark):
    lengths = spark.createDataFrame([("a", 1200), ("b", 999), (None, 5000)], "symbol string, length int")
    got = {}
    for r in S.windows(lengths, 200, 5, 0.2).orderBy("index").collect():
        got.setdefault(r.length, []).append((r["index"], r.is_start, r.is_end, r.oos_end))
    for length in (1200, 999, 5000):
        assert got[length] == [(r["index"], r.is_start, r.is_end, r.oos_end) for r in S.window_bounds(spark, length, 200, 5, 0.2).orderBy("index").collect()]
    with pytest.raises(Exception, match="too few"):
        S.windows(spark.createDataFrame([(205,)], "length int"), 200, 5, 0.2).collect()


def test_specs_of_one_task_are_dealt(spark):
    """F1 to F5: specs that come as one task's rows, as of one file, are judged by many tasks, and come out the same."""
    texts = [json.dumps(S.TREND | {"name": f"20240101-{k}-{'Bad' if k % 9 == 0 else 'x'}"}) for k in range(200)]
    specs = spark.createDataFrame(list(enumerate(texts)), "id int, spec string").coalesce(1)
    tasks = many.per_spec(specs, "task long", lambda s: [(TaskContext.get().partitionId(),)]).collect()
    assert len(tasks) == sum(k % 9 != 0 for k in range(200)) and len({r.task for r in tasks}) > 4
    found = many.checked(specs).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) > 4
    assert {r.id: r.hash for r in found} == {k: None if k % 9 == 0 else validate(json.loads(t))["hash"] for k, t in enumerate(texts)}


def test_completed_and_validate():
    """validate gives a copy throughout, completed the same without its hash."""
    spec = json.loads(json.dumps(S.TREND)) | {"hash": "old"}
    before = json.dumps(spec)
    valid, shared = validate(spec), completed(spec)
    assert {k: v for k, v in valid.items() if k != "hash"} == shared and valid["hash"] == spec_hash(shared)
    valid["entries"]["blocks"].clear()
    valid["fitness"]["weights"].clear()
    assert json.dumps(spec) == before and validate(spec)["entries"]["blocks"]
