"""Scores, islands and the search."""

import random

from candlery.catalog.bars import daily, hourly
from candlery.catalog.search import SHORT
from candlery.catalog.simulation import genes
from candlery.plans import params as P, runtime as R, search as S
from candlery.plans.spec import validate


def test_score_is_less_for_drawdown(spark, sf_dir):
    bars = daily(spark, sf_dir)
    trades = R.trades(R.series(bars, S.TREND, genes(3)), S.TREND, genes(3)).collect()
    seen = 0
    for r in S.evaluate(bars, S.TREND, genes(3)).collect():
        mine = sorted((t for t in trades if (t.symbol, t.gene_id) == (r.symbol, r.gene_id)), key=lambda t: (t.exit_ts, t.position))
        assert len(mine) == r.trades
        equity = peak = 100_000.0
        fall = 0.0
        for t in mine:
            equity = max(0.0, equity + t.pnl)
            peak = max(peak, equity)
            fall = max(fall, (peak - equity) / peak)
        assert abs(equity - 100_000 - r.net) < 1e-6
        assert r.max_dd_pct >= fall - 1e-12  # open positions count at each close too
        if r.trades >= 10:
            want = r.net / 1000 * (1 - 0.3 * min(r.max_dd_pct / 0.25, 1) ** 2)
            assert abs(r.score - want) < 1e-6 * max(1, abs(want))
            seen += fall > 0
    assert seen


def test_composite_score_in_the_search(spark, sf_dir):
    spec = validate(S.TREND | {"fitness": {"gates": {"minTradesPerWindow": 5, "worstRegimePfFloor": 0.0, "wfeMin": 0.0}}})
    rows = S.evaluate(daily(spark, sf_dir), spec, genes(2)).collect()
    assert all(r.score == -1000.0 if r.positions < 5 else 0 <= r.score <= 1 for r in rows)


def test_islands():
    space = [("a", "int", 0, 10, 1), ("b", "int", 0, 10, 1)]
    island = S.Island(0, 0, 0.4, 0.12, {1: 5.0})
    assert island.hold((1.0, 2.0)) == (1.0, 5.0)
    island.genes = [(5.0, 5.0)] * 8
    score = {(5.0, 5.0): 1.0, (9.0, 1.0): 2.0, (9.0, 5.0): 0.5}
    assert island.stir(0, space, score, lambda: (9.0, 1.0)) and island.genes.count((9.0, 5.0)) == 2 and island.now() == (0.95 if 0.4 * 2.5 > 0.95 else 1.0, 0.45)
    for g in range(5):
        assert not island.stir(g, space, score, lambda: (9.0, 1.0))
        island.calm(g)
    assert not island.active and island.ended == 4 and island.now() == (0.4, 0.12)
    island.genes = [(5.0, 5.0)] * 8
    assert not island.stir(18, space, score, lambda: (9.0, 1.0)) and island.stir(19, space, score, lambda: (9.0, 1.0))
    island.genes = [(5.0, 5.0), (9.0, 5.0)]
    island.receive([(5.0, 5.0), (9.0, 1.0)], score | {(9.0, 1.0): 0.2})
    assert island.genes == [(5.0, 5.0), (5.0, 5.0)]  # the first was better than the worst, the second wasn't
    rng = random.Random(1)
    assert S.targets_of(1, "ring", rng) == {} and S.targets_of(3, "ring", rng) == {0: [1], 1: [2], 2: [0]}
    # 3 by 2, then a last row of one: who is beside whom, and over the edges.
    assert S.targets_of(6, "torus", rng) == {0: [1, 2, 4], 1: [0, 3, 5], 2: [0, 3, 4], 3: [1, 2, 5], 4: [0, 2, 5], 5: [1, 3, 4]}
    assert S.targets_of(5, "torus", rng)[4] == [0, 2] and S.targets_of(2, "torus", rng) == {0: [1], 1: [0]} and S.targets_of(1, "torus", rng) == {}
    assert all(k not in t for k, t in S.targets_of(6, "torus", rng).items()) and all(k not in t for k, t in S.targets_of(4, "random", rng).items())


def test_search_is_repeatable_and_on_the_grid(spark, sf_dir):
    small = {"planets": 2, "islands": 2, "size": 4, "generations": 2, "every": 1, "travel": 1, "fitness": 100}
    bars = hourly(spark, sf_dir).where("symbol = 'click'")
    a, b = (S.search(bars, **small, seed=3).orderBy("gene_id").collect() for _ in range(2))
    assert a == b and len(a) >= 8
    assert [r.score for r in a] == sorted((r.score for r in a), reverse=True)
    full = {r.gene_id: r for r in S.evaluate(bars, S.TREND, [{n: r[n] for n in (p[0] for p in P.derive(S.TREND)[0])} | {"gene_id": r.gene_id} for r in a]).collect()}
    for r in a:
        assert full[r.gene_id].trades == r.trades and r["emaTrend.main.emaFast"] < r["emaTrend.main.emaSlow"]
        for name, _, low, high, step in P.derive(S.TREND)[0]:
            assert low <= r[name] <= high and abs((r[name] - low) / step - round((r[name] - low) / step)) < 1e-6


def test_gene_operators(spark):
    """Random genes lie on the grid, mutation moves one to three steps, a child has each value from a parent."""
    g = {r.gene_id: r for r in P.random_genes(spark, SHORT, 300, 7).collect()}
    assert g == {r.gene_id: r for r in P.random_genes(spark, SHORT, 300, 7).collect()}
    for name, _, low, high, step in SHORT:
        values = {r[name] for r in g.values()}
        assert all(low <= v <= high and abs((v - low) / step - round((v - low) / step)) < 1e-6 for v in values) and len(values) > 5
    moved = changed = 0
    for r in P.mutate(P.random_genes(spark, SHORT, 300, 7), SHORT, 0.3, 5).collect():
        for name, _, low, high, step in SHORT:
            far = abs(r[name] - g[r.gene_id][name]) / step
            assert far < 3 + 1e-6 and low <= r[name] <= high
            moved, changed = moved + 1, changed + (far > 1e-9)
    assert 0.15 < changed / moved < 0.35
    names = [p[0] for p in SHORT]
    from pyspark.sql import functions as F

    base = P.random_genes(spark, SHORT, 300, 7)
    pairs = base.select("gene_id", F.struct(*names).alias("a")).join(base.select(((F.col("gene_id") + 1) % 300).alias("gene_id"), F.struct(*names).alias("b")), "gene_id")
    for r in P.cross(pairs, SHORT, 3).collect():
        assert all(r[n] in (g[r.gene_id][n], g[(r.gene_id - 1) % 300][n]) for n in names)


def test_walk_forward_windows_are_runs_of_their_own(spark, sf_dir):
    bars = daily(spark, sf_dir)
    length = bars.groupBy("symbol").count().agg({"count": "min"}).first()[0]
    gene, bounds = genes(1)[0], S.window_bounds(spark, length, 200, 3, 0.3)
    got = {(r.symbol, r.window, r.phase): (r.trades, round(r.net, 6)) for r in S.walk_forward(bars, S.TREND, gene, bounds).collect()}
    w = bounds.where("index = 1").first()
    series = R.series(bars, S.TREND, [gene])
    for symbol in {k[0] for k in got}:
        rows = series.where(series.symbol == symbol).orderBy("bar_ts").toPandas()
        for phase, a, b in (("is", w.is_start, w.is_end), ("oos", w.is_end, w.oos_end)):
            part = spark.createDataFrame(rows.iloc[a:b].assign(regime="x"), series.schema)
            s = R.summaries(part, S.TREND, [gene]).first()
            assert got[symbol, 1, phase] == (s.trades, round(s.net, 6))


def test_classic_strategy(spark, sf_dir):
    import pytest

    gene = {p[0]: p[2] + (p[3] - p[2]) / 2 // p[4] * p[4] for p in P.CLASSIC}
    assert S.classic_run(daily(spark, sf_dir), gene).count() == daily(spark, sf_dir).select("symbol").distinct().count()
    with pytest.raises(ValueError):
        S.classic_run(daily(spark, sf_dir).limit(50), gene)


def test_genes_are_evaluated_once_for_a_spec_and_its_bars(spark, tmp_path, monkeypatch):
    from candlery.plans import evaluated

    rows = [("S", k * 3_600_000, 1.0, 2.0, 0.5, float(100 + k % 7), 1.0) for k in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts long, open double, high double, low double, close double, volume double")
    runs = []

    def stub(bars, spec, genes, settings=None):
        runs.append(sorted(g["a"] for g in genes))
        return spark.createDataFrame([("S", g["gene_id"], float(g["a"] - 2), 3, 1.5, 0.1) for g in genes] + [("T", g["gene_id"], float(g["a"] - 2), 4, 0.5, 0.2) for g in genes], "symbol string, gene_id long, score double, trades long, net double, max_dd_pct double")

    monkeypatch.setattr(evaluated.S, "evaluate", stub)
    spec, genes = {"hash": "h"}, [{"gene_id": 10 + k, "a": a} for k, a in enumerate((1, 3, 5, 3))]
    ask = lambda b, s, g: sorted((r.gene_id, r.fitness, r.known) for r in evaluated.evaluate(b, s, g, str(tmp_path)).collect())
    assert ask(bars, spec, genes) == [(10, -1.0, False), (11, 1.0, False), (12, 3.0, False), (13, 1.0, False)]
    assert ask(bars, spec, [*genes, {"gene_id": 20, "a": 9}]) == [(10, -1.0, False), (11, 1.0, True), (12, 3.0, True), (13, 1.0, True), (20, 7.0, False)]
    assert ask(bars.repartition(7), spec, genes[1:3]) == [(11, 1.0, True), (12, 3.0, True)]  # the same bars, in any order
    assert runs == [[1, 3, 5], [1, 9]]  # what has no positive fitness isn't kept
    ask(bars, {"hash": "other"}, genes[1:2])
    ask(bars.limit(59), spec, genes[1:2])
    assert runs[2:] == [[3], [3]]
