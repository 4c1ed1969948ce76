"""Blocks through SQL's table function."""

import pytest

from candlery.plans import sqlblocks

BARS = "symbol string, bar_ts long, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def block(spark):
    sqlblocks.register(spark)
    rows = [(s, t, *[float(p)] * 4, 1.0) for s, prices in (("up", range(1, 31)), ("down", range(30, 0, -1)), (None, range(12))) for t, p in enumerate(prices)]
    spark.createDataFrame(rows, BARS).repartition(6).createOrReplaceTempView("bars")
    return lambda name, params, source="bars": spark.sql(f"select * from block(table({source}), '{name}', '{params}')")


def test_each_symbol_in_order(block):
    rows = block("donchianBreakout", '{"period": 10}').collect()
    assert len(rows) == 72
    assert {(r.symbol, r.bar_ts) for r in rows if r.long} == {("up", t) for t in range(10, 30)} | {(None, 10), (None, 11)}
    assert {(r.symbol, r.bar_ts) for r in rows if r.short} == {("down", t) for t in range(10, 30)}


def test_columns_depend_on_the_block(block):
    assert block("emaTrend", '{"emaFast": 5, "emaSlow": 10}').columns == ["symbol", "bar_ts", "long", "short"]
    out = block("rangeRegime", '{"adxLen": 7, "adxThreshold": 25}')
    assert out.columns == ["symbol", "bar_ts", "regime"] and {r.regime for r in out.where("symbol = 'up'").collect()} == {None, "trending"}


def test_bars_without_prices_and_empty_tables(block, spark):
    spark.sql("select symbol, bar_ts, if(bar_ts = 3, null, open) as open, high, low, close, if(bar_ts = 5, null, volume) as volume, 'x' as `a.b` from bars").createOrReplaceTempView("gaps")
    rows = {(r.symbol, r.bar_ts): r for r in block("volumeSurge", '{"volLen": 5, "multiplier": 1.2}', "gaps").collect()}
    assert len(rows) == 72 and not any(r.long or r.short for r in rows.values())
    assert block("donchianBreakout", '{"period": 10}', "gaps").where("long and symbol = 'up'").count() == 19  # a bar fewer is known
    spark.table("bars").limit(0).createOrReplaceTempView("none")
    assert block("stochCross", '{"stochLen": 14, "stochSmth": 3, "longLevel": 30, "shortLevel": 70}', "none").count() == 0


@pytest.mark.parametrize("name, params, source, why", [
    ("nothing", "{}", "bars", "has to be one of"), ("emaTrend", '{"emaFast": 5}', "bars", "needs the parameters"), ("emaTrend", '{"emaFast": 5.5, "emaSlow": 10}', "bars", "whole number"),
    ("donchianBreakout", '{"period": 9}', "bars", "from 10 to 100"), ("donchianBreakout", "[]", "bars", "needs the parameters"), ("donchianBreakout", '{"period": 10}', "(select symbol from bars)", "lacks bar_ts"),
])
def test_refused_before_it_runs(block, name, params, source, why):
    with pytest.raises(Exception, match=why):
        block(name, params, source)
