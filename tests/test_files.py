"""Specs, caches, trade lists and deployments on disk."""

import json
import os

import pytest
from pyspark.sql import functions as F

from candlery.operators import metrics, tables as T
from candlery.plans import search as S
from candlery.plans.spec import SpecError
from candlery.sources import sinks, specs


def test_specs(spark, tmp_path):
    folder = str(tmp_path / "specs")
    good, bad = specs.scan(spark, folder)
    assert good.count() == bad.count() == 0
    path, replaced = specs.save(spark, S.TREND | {"description": "d" * 300}, folder)
    assert not replaced and "hash" not in json.load(open(path)) and specs.load(spark, path)["hash"]
    with pytest.raises(FileExistsError):
        specs.save(spark, S.TREND, folder)
    with pytest.raises(SpecError):
        specs.save(spark, S.TREND | {"name": "no"}, folder)
    (tmp_path / "specs" / "x.json").write_text("[1, 2]")
    (tmp_path / "specs" / "y.txt").write_text("{}")
    good, bad = specs.scan(spark, folder)
    assert [r.name for r in good.collect()] == [S.TREND["name"]] and len(good.first().description) == 281
    assert [r.filename for r in bad.collect()] == ["x.json"]
    assert specs.save(spark, S.TREND, folder, overwrite=True)[1]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(f"g{k}", float(10 * k), "{}") for k in range(10)] + [("bad", float("nan"), "{}"), ("worse", -1000.0, "{}"), ("most", float("inf"), "{}"), ("none", None, "{}")]
    sinks.save_cache(spark.createDataFrame(rows, sinks.CACHE), path, 3)
    assert {r.gene_key for r in sinks.load_cache(spark, path).collect()} == {"g9", "g8", "g7"}
    sinks.save_cache(sinks.load_cache(spark, path).limit(0), path)  # of itself
    assert sinks.load_cache(spark, path).count() == 0
    sinks.save_cache(spark.createDataFrame(rows, sinks.CACHE), path)
    assert len(os.listdir(path)) == 2  # the newest, and the one before for its readers
    (tmp_path / "cache" / "version=000000000099-unfinished").mkdir()  # a write that broke off is no version
    assert sinks.load_cache(spark, path).count() == 9
    for top, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                os.remove(os.path.join(top, f".{name}.crc"))
                with open(os.path.join(top, name), "wb") as f:
                    f.write(b"no parquet")
    assert sinks.load_cache(spark, path).count() == 0


def test_deployments(spark, tmp_path):
    path = str(tmp_path / "deployments")
    row = sinks.deploy(spark, path, "h", "ETH", 60, run_id=3, config={"a": 1}).collect()
    assert len(row) == 1 and (row[0].mode, row[0].status, row[0].run_id, row[0].config_json) == ("paper", "draft", 3, '{"a": 1}')
    assert sinks.same_secret(row[0].secret_key, row[0].secret_key) and not sinks.same_secret(row[0].secret_key, sinks.mint_secret())
    for wrong in ({"mode": "live"}, {"timeframe": 0}, {"symbol": ""}, {"spec_hash": None}):
        with pytest.raises(ValueError):
            sinks.deploy(spark, path, **({"spec_hash": "h", "symbol": "ETH", "timeframe": 60} | wrong))
    assert spark.read.parquet(path).count() == 1


def test_trade_list(spark, tmp_path):
    trades = spark.createDataFrame([("S", 1, 0, "Long", 0, 3_600_000, "TP1", 100.0, 101.005, 0.5, None, 0.4, 100_000.4, "up"), ("S", 1, 1, "Short", 60_000, 7_200_000, "SL", 99.999, 98.0, 2.0, 3.14159, -1.25, 99_999.15, None)],
                                   "symbol string, gene_id long, position long, direction string, entry_ts long, exit_ts long, signal string, entry_price double, exit_price double, units double, risk double, pnl double, equity double, regime string")
    sinks.export_trades(trades, str(tmp_path / "t"))
    lines = [line for p in (tmp_path / "t" / "symbol=S" / "gene_id=1").glob("*.csv") for line in p.read_text().splitlines()]
    assert lines[0].replace('"', "") == "#,Direction,Entry Date,Exit Date,Signal,Entry Price,Exit Price,Size Asset,Size USDT,Risk $,Net PnL,PnL %"
    assert "2,Short,1970-01-01 00:01,1970-01-01 02:00,SL,100.00,98.00,2.0000,196.00,3.14,-1.25,-0.001" in lines and len(lines) == 3
    assert any(line.startswith("1,Long,1970-01-01 00:00,1970-01-01 01:00,TP1,100.00,") and ",0.40," in line for line in lines)


def test_unknown_source_raises(spark, sf_dir):
    from candlery.operators import candles

    names = [n for n in dir(candles) if "source" in n]
    with pytest.raises(ValueError):
        getattr(candles, names[0])("nothing")


def test_large_caches_take_many_tasks(spark, tmp_path, monkeypatch):
    """what is kept of more rows than a task sorts never meets in one task, and is exact, ties included."""
    for of, setting, value in ((T, "IN_ONE_TASK", 20), (metrics, "STRETCH_ROWS", 25), (metrics, "CELLS", 40), (metrics, "MOST_CELLS", 40)):
        monkeypatch.setattr(of, setting, value)
    odd = [float("nan"), float("inf"), None, 0.0, -1.0]
    values = {"spread": [float(k * 37 % 211) for k in range(400)] + odd, "busy": [1.0 if k % 3 else 1e9 / (k + 1) for k in range(400)] + odd, "equal": [7.0] * 400 + odd}
    for fitness in values.values():
        data = [(f"g{k:03d}", x, "{}") for k, x in enumerate(fitness)]
        best = sorted((r for r in data if r[1] is not None and 0 < r[1] < float("inf")), key=lambda r: (-r[1], r[0]))
        rows = spark.createDataFrame(data, sinks.CACHE).repartition(4)
        for n in (0, 20, 21, 130, len(best) - 1, 1 << 30):
            got = [tuple(r) for r in T.keep_best(rows, "fitness", n, ["gene_key"]).collect()]
            assert sorted(got) == sorted(best[:n]) and (n > 20 or got == best[:n])
        assert T.keep_best(rows, "fitness", 1 << 30, ["gene_key"]).select(F.spark_partition_id()).distinct().count() == 4
    path = str(tmp_path / "large")
    sinks.save_cache(rows, path, 1 << 30)
    assert sorted(tuple(r) for r in sinks.load_cache(spark, path).collect()) == sorted(best)
