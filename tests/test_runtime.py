"""Specs run end to end: hand-worked trades, a plain walk over the same columns, blocks that look ahead, bad blocks."""

import math

import pytest
from pyspark.sql import functions as F

from candlery.plans import exits as X, runtime as R
from candlery.plans.contract import Block, BlockError, Registry, looks_ahead, problems_of
from candlery.plans.library import REGISTRY
from candlery.plans.spec import BLOCKS, SpecError, problems, validate

BARS = "symbol string, bar_ts long, open double, high double, low double, close double, volume double"
HOUR = 3_600_000


class FixedStop:
    def __init__(self, params):
        self.share = params["share"] / 100

    def open(self, a, p, i):
        pass

    def bar(self, a, p, i):
        stop = p.price * (1 - p.way * self.share)
        hit = a.low[i] <= stop if p.way > 0 else a.high[i] >= stop
        return ("close", stop, "SL") if hit else None


class Timed:
    def __init__(self, params):
        self.most = params["maxBars"]

    def open(self, a, p, i):
        pass

    def bar(self, a, p, i):
        return ("next", "Time") if i - p.bar >= self.most - 1 else None


class Units:
    def __init__(self, params):
        self.n = params["units"]

    def units(self, a, price, i, distance):
        return self.n


def periodic(bars, p, name):
    from candlery.operators.candles import indexed

    return indexed(bars).withColumns({f"{name}_long": F.col("i") % p["period"] == 0, f"{name}_short": F.lit(False)}).drop("i")


def stubs():
    r = Registry()
    r.register(Block("periodic", "entry", {"period": ("int", 2, 100, 1)}, columns=periodic, direction="long"))
    r.register(Block("fixedStop", "exit", {"share": ("float", 1, 20, 1)}, acts=FixedStop, slot="hardStop"))
    r.register(Block("timed", "exit", {"maxBars": ("int", 1, 50, 1)}, acts=Timed, slot="target"))
    r.register(Block("units", "sizing", {"units": ("int", 1, 100, 1)}, acts=Units))
    return r


def test_sawtooth_trades(spark):
    rows = [("T", 1_700_000_000_000 + i * HOUR, w := 100.0 + i % 20, w + 1, w - 1, w + 0.5, 1000.0) for i in range(200)]
    bars, registry = spark.createDataFrame(rows, BARS), stubs()
    spec = {
        "entries": {"mode": "any", "blocks": [{"block": "periodic", "params": {"period": {"value": 10}}}]},
        "exits": {"hardStop": {"block": "fixedStop", "params": {"share": {"value": 5}}}, "target": {"block": "timed", "params": {"maxBars": {"value": 5}}}},
        "sizing": {"block": "units", "params": {"units": {"value": 1}}},
    }
    series = R.series(bars, spec, [{}], registry)
    trades = R.trades(series, spec, [{}], registry=registry).orderBy("position").collect()
    assert len(trades) == 20 and {t.signal for t in trades} == {"Time"}
    for k, t in enumerate(trades):
        entry, leave, pnl = ((101.02, 105.98, 4.8358), (111.02, 115.98, 4.8238))[k % 2]
        assert math.isclose(t.entry_price, entry) and math.isclose(t.exit_price, leave) and abs(t.pnl - pnl) < 1e-4
    s = R.summaries(series, spec, [{}], registry=registry).first()
    assert abs(s.net - 96.596) < 1e-3 and abs(s.equity - 100_096.596) < 1e-3 and (s.trades, s.positions, s.wins, s.pf) == (20, 20, 20, None)
    late = R.summaries(series, spec, [{}], {"fitness": 100}, registry).first()
    assert late.trades == 10 and abs(late.net - 48.298) < 1e-3


def walk(spark, n=400):
    rows, price = [], 100.0
    for i in range(n):
        new = price + 0.02 * math.sin(i / 80) + 0.6 * (math.sin(1.3 * i) + math.cos(0.7 * i)) + 0.15 * math.sin(i / 23)
        rows.append(("W", i * HOUR, price, max(price, new) + 0.2, min(price, new) - 0.2, new, 1000 + 400 * abs(math.sin(i / 11)) ** 3))
        price = new
    return spark.createDataFrame(rows, BARS)


FULL = {
    "name": "20240101-001-full-walk",
    "regime": {"block": "volRegime", "params": {"atrLen": {"value": 7}, "rankLen": {"value": 20}, "highThreshold": {"value": 70}, "lowThreshold": {"value": 30}}},
    "entries": {"mode": "score", "threshold": {"min": 1, "max": 2, "step": 1}, "blocks": [
        {"block": "emaTrend", "params": {"emaFast": {"min": 5, "max": 12, "step": 1}, "emaSlow": {"value": 20}}},
        {"block": "rsiPullback", "params": {"rsiLen": {"value": 7}, "longLevel": {"value": 45}, "shortLevel": {"value": 55}}}]},
    "filters": {"mode": "all", "blocks": [{"block": "volumeFilter", "params": {"volLen": {"value": 10}, "minMultiplier": {"value": 0.6}}}]},
    "exits": {
        "hardStop": {"block": "atrHardStop", "params": {"atrLen": {"value": 7}, "atrSL": {"min": 0.5, "max": 3, "step": 0.25}, "emergencySlPct": {"value": 5}}},
        "target": {"block": "atrScaleOutTarget", "params": {"atrLen": {"value": 9}, "tp1Mult": {"value": 1.5}, "tp1Pct": {"value": 30}, "tp2Mult": {"value": 0.75}, "tp2Pct": {"value": 20}, "tp3Mult": {"value": 3}, "tp3Pct": {"value": 30}}},
        "trail": {"block": "structuralExit", "params": {"stochLen": {"value": 9}, "stochSmth": {"value": 3}, "rsiLen": {"value": 9}, "maxBars": {"value": 12}}}},
    "sizing": {"block": "atrRisk", "params": {"riskPct": {"value": 1.0}, "useInitialCapital": {"value": 0}}},
}
GENES = [{"gene_id": 4, "emaTrend.main.emaFast": 6, "atrHardStop.main.atrSL": 1.0, "_meta.entries.threshold": 1}, {"gene_id": 9, "emaTrend.main.emaFast": 10, "atrHardStop.main.atrSL": 2.0, "_meta.entries.threshold": 2}]


def plain_run(rows, stop, targets, most, risk, emergency=5.0):
    """The same rules as one loop over dicts, written apart from the account."""
    money, held, order, want, out = 100_000.0, None, None, 0, []

    def sell(i, part, price, tag):
        nonlocal money
        pnl = part[0] * (price - held["price"]) * held["way"] - 0.0006 * part[0] * (price + held["price"])
        money = max(0.0, money + pnl)
        held["parts"].remove(part)
        out.append((held["n"], tag, round(price, 9), round(part[0], 9), round(pnl, 7)))

    def sell_all(i, price, tag):
        nonlocal held
        for part in list(held["parts"]):
            sell(i, part, price, tag)
        held = None

    n = 0
    for i, r in enumerate(rows):
        if order and held:
            sell_all(i, r.open - held["way"] * 0.02, order)
        order = None
        if want and not held and i:
            a, b, price = rows[i - 1].hardStop_atr, rows[i - 1].target_atr, r.open + want * 0.02
            units = min(money * risk / 100 / (a * stop), money / price) if a else 0
            if units > 0:
                held = {"n": n, "way": want, "price": price, "at": i, "a": a, "armed": False, "first": None, "parts": [[units, None, ""]]}
                n += 1
                if b:
                    left, held["parts"] = units, []
                    for k, (m, s) in enumerate(sorted(targets)):
                        part = left if k == len(targets) - 1 else units * s / sum(x for _, x in targets)
                        left -= part
                        held["parts"].append([part, price + want * b * m, f"TP{k + 1}"])
        want = 0
        if held:
            way, price = held["way"], held["price"]
            floor = price * (1 - way * emergency / 100)
            level = price * (1 + way * 0.003) if held["first"] is not None and i > held["first"] else price - way * held["a"] * stop
            if (r.low <= floor) if way > 0 else (r.high >= floor):
                sell_all(i, floor - way * 0.02, "ESL")
            elif held["armed"]:
                held["armed"], order = False, "SL"
            else:
                held["armed"] = (r.close <= level) if way > 0 else (r.close >= level)
        if held and not order and i > held["at"]:
            for part in [p for p in held["parts"] if p[1] is not None and ((r.high >= p[1]) if held["way"] > 0 else (r.low <= p[1]))]:
                if part[2] == "TP1":
                    held["first"] = i
                sell(i, part, part[1], part[2])
            held = held if held["parts"] else None
        if held and not order:
            other = r.short_ok if held["way"] > 0 else r.long_ok
            broken = r.trail_long if held["way"] > 0 else r.trail_short
            order = "Time" if i - held["at"] >= most - 1 else "Reversal" if other else "Structural" if broken else None
        way = 1 if r.long_ok else -1 if r.short_ok else 0
        if way and (held is None or order and way == -held["way"]):
            want = way
    if held:
        sell_all(len(rows) - 1, rows[-1].close, "End")
    return out


def test_spec_against_a_plain_walk(spark):
    spec = validate(FULL)
    series = R.series(walk(spark), spec, GENES).cache()
    got = R.trades(series, spec, GENES).collect()
    tags = set()
    for gene in GENES:
        rows = series.where(F.col("gene_id") == gene["gene_id"]).orderBy("bar_ts").collect()
        want = plain_run(rows, gene["atrHardStop.main.atrSL"], [(1.5, 30), (0.75, 20), (3, 30)], 12, 1.0)
        mine = [(t.position, t.signal, round(t.exit_price, 9), round(t.units, 9), round(t.pnl, 7)) for t in got if t.gene_id == gene["gene_id"]]
        assert sorted(mine) == sorted(want) and len(want) > 10
        tags |= {t[1] for t in want}
    assert {"TP1", "TP2", "Structural", "Reversal"} <= tags
    for s in R.summaries(series, spec, GENES).collect():
        mine = [t for t in got if t.gene_id == s.gene_id]
        assert s.trades == len(mine) and abs(s.net - sum(t.pnl for t in mine)) < 1e-6 and 0 < s.max_dd_pct < 1
        assert sum(r.trades for r in s.regimes) == s.trades


def test_slots_in_order(spark):
    paths = [(r.gene_id, r.block) for r in R.plan(validate(FULL), GENES[:1]).orderBy("place").collect()]
    assert paths == [(4, b) for b in ("volRegime", "emaTrend", "rsiPullback", "volumeFilter", "atrHardStop", "atrScaleOutTarget", "structuralExit", "atrRisk")]
    with pytest.raises(KeyError):
        R.resolve(FULL | {"sizing": {"block": "flat", "version": 7, "params": {}}})
    with pytest.raises(ValueError):
        R.resolve(FULL | {"exits": {"target": FULL["exits"]["hardStop"]}})


PARAMS = {b.id: {n: (k(lo + 2 * step) if (k := int if kind == "int" else float) else 0) for n, (kind, lo, hi, step) in b.params.items()} for b in REGISTRY.all()}
PARAMS["htfTrendFilter"] = PARAMS["htfTrendRegime"] = PARAMS["htfTrendRegime"] | {"htfTfMin": 240, "maLen": 10}
PARAMS["volRegime"] |= {"rankLen": 20, "highThreshold": 70.0, "lowThreshold": 30.0}


@pytest.mark.parametrize("block", [b for b in REGISTRY.all() if b.columns and b.id != "regimeGate"], ids=lambda b: b.id)
def test_no_block_looks_ahead(spark, block):
    assert looks_ahead(block, walk(spark, 220), PARAMS[block.id], (120, 150, 200)).count() == 0


def test_a_block_that_looks_ahead_is_found(spark):
    from pyspark.sql import Window as W

    cheat = Block("cheat", "entry", columns=lambda bars, p, name: bars.withColumns({f"{name}_long": F.lead("close").over(W.partitionBy("symbol").orderBy("bar_ts")) > F.col("close"), f"{name}_short": F.lit(False)}))
    assert {r.cutoff for r in looks_ahead(cheat, walk(spark, 220), {}, (120, 150, 200)).collect()} <= {120, 150, 200}
    assert looks_ahead(cheat, walk(spark, 220), {}, tuple(range(100, 130))).count() > 0


def test_bad_blocks_and_specs():
    bad = Block("", "exit", {"a": ("text", 1, 2, 1), "b": ("int", 3, 2, 1), "c": ("int", 1, 2, 0)}, version=0, direction="up", rules=(("a", "<", "z"),))
    wrong = "\n".join(problems_of(bad))
    for word in ("id:", "version:", "slot:", "direction:", "acts:", "params.a", "params.b", "params.c", "rules:"):
        assert word in wrong
    r = stubs()
    with pytest.raises(BlockError):
        r.register(Block("units", "sizing", {}, acts=Units))
    r.register(Block("units", "sizing", {}, acts=Units, version=2))
    assert r.versions("units") == [1, 2] and r.get("units").version == 2 and not r.has("units", 3)
    assert len(REGISTRY.all()) == 27 and {k: len(v) for k, v in BLOCKS.items()} == {"regime": 3, "entry": 7, "filter": 4, "exit": 3, "sizing": 10}
    assert not problems(FULL) and validate(FULL)["hash"] == validate(validate(FULL))["hash"]
    broken = FULL | {"name": "x", "entries": {"mode": "most", "blocks": []}, "sizing": {"block": "nothing"}, "constraints": [{"lhs": "a", "op": "~", "rhs": "b"}]}
    wrong = problems(broken)
    assert len(wrong) >= 5
    with pytest.raises(SpecError) as e:
        validate(broken)
    assert str(e.value).count("\n") == len(wrong) - 1
    slow = FULL | {"entries": {"blocks": [{"block": "emaTrend", "params": {"emaFast": {"value": 30}, "emaSlow": {"value": 20}}}]}}
    assert any("emaFast" in w for w in problems(slow))


def test_sizing_rules_have_bounds():
    class Seen:
        equity, initial, extra = 50_000.0, 100_000.0, {"sizing_atr": [2.0, 4.0]}
        wins, losses, streak, curve = [100.0, 300.0], [50.0], ("L", 2), [99.0, 101.0, 105.0]

    size = lambda kind, **p: X.Sizing(kind, p).units(Seen, 10.0, 1, 5.0)
    assert size("flat", amountUsd=500) == 50 and size("pctOfEquity", pct=10) == 500 and size("pctOfInitial", pct=10) == 1000
    assert size("atrRisk", riskPct=1, useInitialCapital=0) == 100 and size("atrRisk", riskPct=1, useInitialCapital=1) == 200
    assert size("martingale", basePct=1, stepMult=2, maxMult=3) == 150 and size("antiMartingale", basePct=1, stepMult=2, maxMult=3) == 50
    assert size("fixedFractional", f=0.01, minWorstLoss=100) == 5 and size("volTargetSizing", targetVolPct=1, hardCapPct=50) == 250
    assert size("equityCurveTrading", basePct=1, onPct=10, offPct=2, maLen=3, minTrades=3) == 500


@pytest.mark.parametrize("block", [b for b in REGISTRY.all() if b.sides], ids=lambda b: b.id)
def test_expressions_equal_columns(spark, block):
    from candlery.operators.dependencies import with_dependencies

    bars = walk(spark, 220)
    known = with_dependencies(bars, block.deps(PARAMS[block.id]))
    a = known.select("bar_ts", *(x.alias(n) for n, x in block.sides(PARAMS[block.id]).items()))
    b = block.columns(bars, PARAMS[block.id], "x").select("bar_ts", *(F.col(f"x_{n}").alias(n) for n in block.sides(PARAMS[block.id])))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_longer_timeframes_are_rolled_up_and_joined_once(spark):
    """Three blocks on one longer timeframe, and a fourth on another: a roll-up and a join for each timeframe."""
    from candlery.operators import blocks as B, indicators as I
    from candlery.operators.candles import roll_up_bars
    from candlery.operators.dependencies import column_of, with_dependencies

    def work(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        lines = [x for x in plan.splitlines() if "Exchange hashpartitioning(symbol" in x and "Reused" not in x]
        return sum("(floor" in x or "_groupingexpression" in x or "bar_ts" in x for x in lines), plan.count("Union")

    bars = walk(spark, 400).select("symbol", *R.BAR, "volume")
    deps = [*B.htf_deps(240, 5), *B.htf_deps(240, 5, 3), *B.htf_deps(240, 8), *B.htf_deps(480, 3), ("ema", 5)]
    together = with_dependencies(bars, deps, base=60)
    assert list(dict.fromkeys(map(column_of, deps))) == sorted(set(together.columns) - set(bars.columns), key=list(map(column_of, deps)).index)
    one, _ = work(with_dependencies(bars, B.htf_deps(240, 5)))
    both, unions = work(with_dependencies(bars, [*B.htf_deps(240, 5), *B.htf_deps(240, 5, 3), *B.htf_deps(240, 8)]))
    assert both == one and unions == 1
    # Values: of the last bar of four hours that closed by each start.
    slow = {r.bar_ts: r for r in I.with_recursive(roll_up_bars(bars, 240), {"x": ("ema", 5)}).collect()}
    starts = sorted(slow)
    for r in together.collect():
        closed = [t for t in starts if t + 240 * 60_000 <= r.bar_ts]
        want = slow[closed[-1]] if closed else None
        assert r[column_of((240, "close", 0, 0))] == (want and want.close) and r[column_of((240, "ema", 5, 0))] == (want and want.x)
        assert r[column_of((240, "ema", 5, 3))] == (slow[closed[-4]].x if len(closed) > 3 else None)
    assert with_dependencies(together, deps).columns == together.columns  # nothing is done twice
    for wrong in (90, 60, 0, -240, "240", None):
        with pytest.raises(ValueError, match="unknown timeframe"):
            with_dependencies(bars, [(wrong, "ema", 5, 0)], base=60)
    with pytest.raises(ValueError, match="unknown indicator"):
        with_dependencies(bars, [(240, "macd", 5, 0)])


def test_unknown_gene_ids_are_refused(spark):
    bars = walk(spark, 60)
    rows = R.series(bars, validate(FULL), [{"gene_id": 0}]).withColumn("gene_id", F.lit(7).cast("long"))
    with pytest.raises(Exception, match="none of the genes given"):
        R.trades(rows, validate(FULL), [{"gene_id": 0}]).collect()
