"""Small rules that no table shows: canonical JSON, the block catalogue, lookback and window errors."""

import json

import pytest

from candlery.functions.scalars import canonical_json
from candlery.operators import indicators as I
from candlery.plans import params as P, search as S
from candlery.plans.spec import BLOCKS, catalogue, rules_of, spec_hash, validate


def test_canonical_json():
    a = {"b": [1, {"z": None, "a": "ü"}], "a": 2.5}
    assert canonical_json(a) == canonical_json(json.loads(json.dumps({"a": 2.5, "b": [1, {"a": "ü", "z": None}]})))
    assert " " not in canonical_json(a) and json.loads(canonical_json(a)) == a and canonical_json(a).startswith('{"a":')
    assert spec_hash({"x": 1, "hash": "old"}) == spec_hash({"x": 1}) != spec_hash({"x": 2}) and len(spec_hash({})) == 64


def test_catalogue(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == 27 and {(r.kind, r.id) for r in rows} == {(k, b) for k, blocks in BLOCKS.items() for b in blocks}
    assert json.loads(next(r.params for r in rows if r.id == "emaTrend")) == {"emaFast": ["int", 5, 100, 1], "emaSlow": ["int", 10, 400, 1]}


def test_windows_golden(spark):
    """Window bounds as worked by hand: 1,200 bars, 200 of warm-up, 5 windows, a fifth out of sample."""
    rows = lambda *a: [tuple(r)[1:] for r in S.window_bounds(spark, *a).orderBy("index").collect()]
    assert [rows(1200, 200, 5, 0.2)[k] for k in (0, 1, 4)] == [(200, 1000, 1040), (200, 1040, 1080), (200, 1160, 1200)]
    assert [rows(1200, 200, 5, 0.2, "rolling")[k] for k in (0, 1, 4)] == [(200, 1000, 1040), (240, 1040, 1080), (360, 1160, 1200)]
    for bad in ((205, 200, 5, 0.2), (220, 200, 5, 0.1)):
        with pytest.raises(ValueError):
            S.window_bounds(spark, *bad)


def test_composite_golden(spark):
    """Profit factor 1.34, drawdown 0.18, return 2.4, 1,020 positions: 0.335, 0.82 and 1.0 make 0.6135; half the trades wanted, half the score."""
    row = spark.createDataFrame([(1.34, 0.18, 2.4, 0.0, 1020, 1.1, None)], "pf double, max_dd_pct double, annual_return double, net_pct double, positions int, worst_pf double, wfe double")
    weights, caps, gates = {"pf": 0.5, "dd": 0.3, "ret": 0.2}, {"pf": 4.0, "ret": 1.0}, {"minTradesPerWindow": 30, "worstRegimePfFloor": 1.0, "wfeMin": 0.5}
    score = lambda target, g=gates: row.select(S.composite(weights, caps, g, target)["score"]).first()[0]
    assert abs(score(0) - 0.6135) < 1e-9 and abs(score(2040) - 0.30675) < 1e-9 and abs(score(1000) - 0.6135) < 1e-9
    assert score(0, gates | {"worstRegimePfFloor": 1.2}) == -1000.0


def test_rules_repair_genes(spark):
    """A block's own rule repairs genes even where the spec lists no constraint."""
    assert rules_of(S.TREND) == [{"lhs": "emaTrend.main.emaFast", "op": "<", "rhs": "emaTrend.main.emaSlow", "repair": "clamp-lhs"}]
    pinned = S.TREND | {"entries": {"mode": "all", "blocks": [{"block": "emaTrend", "params": {"emaFast": {"min": 5, "max": 30, "step": 1}, "emaSlow": {"value": 20}}}]}}
    assert rules_of(pinned)[0]["rhs"] == 20
    genes = spark.createDataFrame([(28.0, 20.0), (5.0, 20.0)], "fast double, slow double")
    out = P.repair(genes, [("fast", "int", 5, 30, 1), ("slow", "int", 20, 100, 5)], [{"lhs": "fast", "op": "<", "rhs": "slow", "repair": "clamp-lhs"}]).collect()
    assert [r.fast for r in out] == [19.0, 5.0]
    assert P.lookback(validate(S.TREND))[0] >= 200


def test_unknown_indicator_raises(spark):
    bars = spark.createDataFrame([("S", 0, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, bar_ts long, open double, high double, low double, close double, volume double")
    with pytest.raises(ValueError):
        I.with_recursive(bars, {"x": ("macd", 3)})
    assert I.with_recursive(bars, {"x": ("ema", 3)}).first().x is None
