"""Scoring and evolutionary search: genes are rows, a generation is one job, islands are a column."""

from __future__ import annotations

import random
from statistics import mean, pstdev

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import normal_dd, normal_pf, normal_return, normal_weights, number_or
from . import params as P, runtime as R
from .spec import rules_of

ELIMINATED = -1000.0


def composite(weights: dict, caps: dict, gates: dict, frequency_target: float = 0) -> dict[str, Column]:
    """score, eliminated and the three norms, over columns pf, max_dd_pct, annual_return, net_pct, positions, worst_pf, wfe."""
    norms = normal_pf(F.col("pf"), caps["pf"]), normal_dd(F.col("max_dd_pct")), normal_return(number_or(F.col("annual_return"), F.col("net_pct")), caps["ret"])
    w = normal_weights(*(F.lit(float(weights.get(k, 0))) for k in ("pf", "dd", "ret")))
    raw = sum((a * b for a, b in zip(w, norms)), F.lit(0.0))
    if frequency_target > 0:
        raw = raw * F.least(F.lit(1.0), F.col("positions") / float(frequency_target))
    out = (F.col("positions") < gates.get("minTradesPerWindow", 0)) | F.coalesce(F.col("worst_pf") < gates.get("worstRegimePfFloor", 0), F.lit(False)) | F.coalesce(F.col("wfe") < gates.get("wfeMin", 0), F.lit(False))
    return {"eliminated": out, "score": F.when(out, F.lit(ELIMINATED)).otherwise(raw), "norm_pf": norms[0], "norm_dd": norms[1], "norm_ret": norms[2]}


def classic_score(trades: Column, net_pct: Column, dd_pct: Column, least_trades: int = 30, most_dd: float = 0.25) -> Column:
    """Percent profit less up to 30 % for drawdown; few trades give a penalty that rises with their number."""
    ratio = F.least(F.greatest(dd_pct, F.lit(0.0)) / most_dd, F.lit(1.0))
    return F.when(trades < 3, -5000.0).when(trades < least_trades, -1000.0 + trades * 10).otherwise(net_pct * 100 * (1 - 0.3 * ratio * ratio))


def windows(lengths: DataFrame, warmup: int, n: int, oos_share: float, scheme: str = "anchored") -> DataFrame:
    """lengths (any columns, and length, a number of bars) with index, is_start, is_end, oos_end of each one's
    walk-forward windows; a length that is too short raises."""
    usable = F.col("length") - warmup
    region = F.floor(usable * oos_share)
    step = F.floor(region / n)
    few = F.format_string(f"%d bars after {warmup} are too few for {n} windows with {oos_share} out of sample", usable.cast("long"))
    step = F.when((usable < 2 * n) | (step < 1) | (usable - region < 1), F.raise_error(few).cast("long")).otherwise(step)
    rows = lengths.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("index"), region.alias("_r"), step.alias("_s"))
    shift = F.col("index") * F.col("_s")
    start, end = F.lit(warmup) + (shift if scheme == "rolling" else F.lit(0)), F.col("length") - F.col("_r") + shift
    bounds = {"is_start": start, "is_end": end, "oos_end": F.least(end + F.col("_s"), F.col("length"))}
    return rows.withColumns({k: v.cast("int") for k, v in bounds.items()}).drop("_r", "_s")


def window_bounds(spark: SparkSession, length: int, warmup: int, n: int, oos_share: float, scheme: str = "anchored") -> DataFrame:
    """index, is_start, is_end, oos_end of walk-forward windows over a number of bars."""
    usable = length - warmup
    region = int(usable * oos_share)
    if usable < 2 * n or region // n < 1 or usable - region < 1:
        raise ValueError(f"{usable} bars after {warmup} are too few for {n} windows with {oos_share} out of sample")
    return windows(spark.range(1).select(F.lit(length).alias("length")), warmup, n, oos_share, scheme).drop("length")


#: A strategy of trend and breakout, over which the search runs by default.
TREND = {
    "name": "20240101-001-trend-breakout",
    "entries": {"mode": "all", "blocks": [
        {"block": "emaTrend", "version": 1, "params": {"emaFast": {"min": 5, "max": 30, "step": 1}, "emaSlow": {"min": 20, "max": 100, "step": 5}}},
        {"block": "donchianBreakout", "version": 1, "params": {"period": {"min": 10, "max": 40, "step": 2}}}]},
    "exits": {
        "hardStop": {"block": "atrHardStop", "version": 1, "params": {"atrLen": {"value": 14}, "atrSL": {"min": 0.5, "max": 4.0, "step": 0.25}, "emergencySlPct": {"value": 25}}},
        "target": {"block": "atrScaleOutTarget", "version": 1, "params": {"atrLen": {"value": 14}, "tp1Mult": {"value": 1.5}, "tp1Pct": {"value": 50}, "tp2Mult": {"value": 3.0}, "tp2Pct": {"value": 50}}},
        "trail": {"block": "structuralExit", "version": 1, "params": {"stochLen": {"value": 14}, "stochSmth": {"value": 3}, "rsiLen": {"value": 14}, "maxBars": {"value": 40}}}},
    "sizing": {"block": "pctOfEquity", "version": 1, "params": {"pct": {"value": 10}}},
}


def worst_regime() -> Column:
    """The least profit factor of a regime with five trades and a loss; null if there is none."""
    return F.expr("array_min(transform(filter(regimes, r -> r.trades >= 5 and r.gross_loss > 0), r -> r.gross_profit / r.gross_loss))")


def evaluate(bars: DataFrame, spec: dict, genes: list[dict], settings: dict | None = None, least_trades: int = 10) -> DataFrame:
    """A summary and a score for each symbol and gene: composite if the spec has a fitness section, else the classic one."""
    out = R.run(bars, spec, genes, settings).withColumn("worst_pf", worst_regime())
    if fitness := spec.get("fitness"):
        pf = F.coalesce("pf", F.when(F.col("wins") > 0, float(fitness["caps"]["pf"])).otherwise(0.0))  # no loss: the cap
        score = composite(fitness["weights"], fitness["caps"], fitness["gates"], fitness.get("frequencyTarget", 0))["score"]
        return out.withColumns({"had": F.col("pf"), "pf": pf, "wfe": F.lit(None).cast("double")}).withColumn("score", score).withColumn("pf", F.col("had")).drop("had", "wfe")
    return out.withColumn("score", classic_score(F.col("trades"), F.col("net_pct"), F.col("max_dd_pct"), least_trades))


#: Fixed: hypermutation of an island whose genes have become alike.
HYPER = {"generations": 5, "cooldown": 15, "rate": 2.5, "most": 0.95, "per_gene": 0.45, "elites": 3, "share": 0.25, "threshold": 0.04}


class Island:
    """Genes (tuples of values) on one island; what the driver holds of a search is its islands."""

    def __init__(self, number: int, planet: int, rate: float, per_gene: float, frozen: dict[int, float]):
        self.number, self.planet, self.rate, self.per_gene, self.frozen = number, planet, rate, per_gene, frozen
        self.genes: list[tuple] = []
        self.active, self.ended, self.count = 0, -HYPER["cooldown"], 0

    def hold(self, gene: tuple) -> tuple:
        return tuple(self.frozen.get(k, v) for k, v in enumerate(gene))

    def diversity(self, space: list[tuple]) -> float:
        return mean(pstdev(g[k] for g in self.genes) / (p[3] - p[2]) for k, p in enumerate(space))

    def now(self) -> tuple[float, float]:
        """Chances of a child to mutate and of each of its parameters."""
        return (min(self.rate * HYPER["rate"], HYPER["most"]), HYPER["per_gene"]) if self.active else (self.rate, self.per_gene)

    def stir(self, generation: int, space: list[tuple], score: dict, draw, manual: bool = False) -> bool:
        """Hypermutation when genes are alike (or asked for), not within the cooldown: newcomers for the worst, wilder children."""
        ready = not self.active and generation - self.ended >= HYPER["cooldown"]
        if not ready or not (manual or self.diversity(space) < HYPER["threshold"]):
            return False
        self.genes.sort(key=lambda g: score[g])
        for k in range(min(int(len(self.genes) * HYPER["share"]), max(0, len(self.genes) - HYPER["elites"]))):
            self.genes[k] = self.hold(draw())
        self.active, self.count = HYPER["generations"], self.count + 1
        return True

    def calm(self, generation: int) -> None:
        if self.active:
            self.active -= 1
            self.ended = generation if not self.active else self.ended

    def receive(self, migrants: list[tuple], score: dict) -> None:
        """Migrants, best first, against the worst: each takes the place only if it is strictly better."""
        self.genes.sort(key=lambda g: score.get(g, float("-inf")))
        for k, g in enumerate(migrants[: len(self.genes)]):
            if score[g] > score.get(self.genes[k], float("-inf")):
                self.genes[k] = self.hold(g)


def targets_of(count: int, kind: str, rng: random.Random) -> dict[int, list[int]]:
    """The edges by sender."""
    out: dict[int, list[int]] = {}
    for island, target in P.edges(count, kind, rng):
        out.setdefault(island, []).append(target)
    return out


def search(bars: DataFrame, spec: dict = TREND, planets: int = 1, islands: int = 4, size: int = 20, generations: int = 80, seed: int = 7, rate: float = 0.4, migrants: int = 2, every: int = 5,
           travel: int = 2, travelers: int = 1, kind: str = "ring", knockout: bool = False, fitness: int = 0, top: int = 20) -> DataFrame:
    """The best genes found, with their metrics over all bars; the same for the same seed.

    A generation's unknown genes are evaluated in one job; known ones are not evaluated again. Islands send their best
    along their topology every few generations, planets along theirs every `travel` such times. With knockout each
    planet but the first holds one parameter at its midpoint. fitness: scores count trades from this bar on; the best
    are then evaluated again over all bars.
    """
    spark, rng = bars.sparkSession, random.Random(seed)
    space, _ = P.derive(spec)
    names = [p[0] for p in space]
    rules = [*(spec.get("constraints") or []), *rules_of(spec)]
    short = [(f"p{k}", *p[1:]) for k, p in enumerate(space)]
    as_short = {n: f"p{k}" for k, n in enumerate(names)}
    constraints = [c | {"lhs": as_short[c["lhs"]], "rhs": as_short.get(c["rhs"], c["rhs"])} for c in rules if c["lhs"] in as_short and (not isinstance(c["rhs"], str) or c["rhs"] in as_short)]
    bars = bars.persist()
    score: dict[tuple, float] = {}

    def tuples(genes: DataFrame) -> list[tuple]:
        """Rows of the population, which the driver holds."""
        return [tuple(float(x) for x in r[1:]) for r in genes.select("gene_id", *(p[0] for p in short)).orderBy("gene_id").collect()]

    def as_genes(found: list[tuple]) -> list[dict]:
        return [dict(zip(names, g)) | {"gene_id": k} for k, g in enumerate(found)]

    def learn(found: list[tuple]) -> None:
        new = sorted(set(found) - set(score))
        if new:
            got = evaluate(bars, spec, as_genes(new), {"fitness": fitness}).groupBy("gene_id").agg(F.avg("score").alias("score")).collect()
            score.update({new[r.gene_id]: r.score for r in got})

    world = []
    gradient = {r.island: r for r in P.mutation_gradient(spark, islands, rate).collect()}
    for planet in range(planets):
        held = P.sweep(short, planets)[planet] if knockout else {}
        frozen = {k: held[p[0]] for k, p in enumerate(short) if p[0] in held}
        world += [Island(planet * islands + i, planet, gradient[i].mutation_rate, gradient[i].per_gene, frozen) for i in range(islands)]
    first = tuples(P.repair(P.random_genes(spark, short, len(world) * size, seed), short, constraints))
    for island in world:
        island.genes = [island.hold(g) for g in first[island.number * size : (island.number + 1) * size]]
    spare = tuples(P.repair(P.random_genes(spark, short, 997, seed + 1), short, constraints))
    learn([g for island in world for g in island.genes])
    moves = 0
    for generation in range(generations):
        for island in world:
            island.stir(generation, space, score, lambda: rng.choice(spare))
        learn([g for island in world for g in island.genes])
        pairs, rates = [], []
        for island in world:
            ranked = sorted(island.genes, key=lambda g: (-score[g], g))
            for k in range(size - 1):  # the best stays as it is
                a, b = (min(rng.sample(range(size), min(3, size))) for _ in range(2))
                chance, per_gene = island.now()
                pairs.append((len(pairs), ranked[a], ranked[b], per_gene if rng.random() < chance else 0.0))
            island.genes = ranked[:1]
        fields = ", ".join(f"{p[0]}: double" for p in short)
        made = P.cross(rows := spark.createDataFrame(pairs, f"gene_id long, a struct<{fields}>, b struct<{fields}>, chance double"), short, seed + generation)
        children = tuples(P.repair(P.mutate(made.join(rows.select("gene_id", "chance"), "gene_id"), short, F.col("chance"), seed * 31 + generation), short, constraints))
        for k, island in enumerate(world):
            island.genes += [island.hold(g) for g in children[k * (size - 1) : (k + 1) * (size - 1)]]
            island.calm(generation)
        learn([g for island in world for g in island.genes])
        if (generation + 1) % every == 0:
            moves += 1
            best = lambda genes, n: sorted(set(genes), key=lambda g: (-score[g], g))[:n]
            sent = {(p, i): best(world[p * islands + i].genes, migrants) for p in range(planets) for i in range(islands)}
            for p in range(planets):
                for i, to in targets_of(islands, kind, rng).items():
                    for t in to:
                        world[p * islands + t].receive(sent[p, i], score)
            if planets > 1 and moves % travel == 0:
                leaving = {p: best([g for w in world if w.planet == p for g in w.genes], travelers) for p in range(planets)}
                for p, to in targets_of(planets, kind, rng).items():
                    for t in to:
                        world[t * islands + rng.randrange(islands)].receive(leaving[p], score)
            learn([g for island in world for g in island.genes])
    chosen = sorted(score, key=lambda g: (-score[g], g))[:top]
    full = evaluate(bars, spec, as_genes(chosen)).drop("score").cache()  # over all bars, whatever the scores counted
    full.count()
    bars.unpersist()
    table = spark.createDataFrame([(k, *g, float(score[g])) for k, g in enumerate(chosen)], ", ".join(["gene_id long", *(f"`{n}` double" for n in names), "score double"]))
    return table.join(full, "gene_id")


def walk_forward(bars: DataFrame, spec: dict, gene: dict, bounds: DataFrame, settings: dict | None = None) -> DataFrame:
    """The gene over each window's two phases: rows (symbol, window, phase, trades, wins, pf, net); all run in one job."""
    series = R.series(bars, spec, [gene | {"gene_id": 0}]).withColumn("i", F.row_number().over(W.partitionBy("symbol").orderBy("bar_ts")) - 1)
    phases = bounds.select(F.col("index").alias("window"), F.inline(F.array(F.struct(F.lit("is").alias("phase"), F.col("is_start").alias("a"), F.col("is_end").alias("b")), F.struct(F.lit("oos").alias("phase"), F.col("is_end").alias("a"), F.col("oos_end").alias("b")))))
    cut = series.join(F.broadcast(phases), (F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))  # two short rows a window
    cut = cut.withColumn("gene_id", F.col("window").cast("long") * 2 + (F.col("phase") == "oos").cast("long")).drop("window", "phase", "a", "b", "i")
    each = [gene | {"gene_id": k} for k in range(2 * bounds.count())]
    t = R.summaries(cut, spec, each, settings)
    return t.select("symbol", F.floor(F.col("gene_id") / 2).alias("window"), F.when(F.col("gene_id") % 2 == 1, "oos").otherwise("is").alias("phase"), "trades", "wins", "pf", "net", "regimes")


def classic_run(bars: DataFrame, gene: dict, settings: dict | None = None) -> DataFrame:
    """The original three-target strategy for one gene of params.CLASSIC, as a spec; each symbol needs 100 bars."""
    if bars.groupBy("symbol").count().where("count < 100").limit(1).count():
        raise ValueError("100 bars at least")
    v = lambda **p: {k: {"value": x} for k, x in p.items()}
    g = gene
    spec = {
        "entries": {"mode": "score", "threshold": g["minEntry"], "blocks": [
            {"block": "stochCross", "params": v(stochLen=g["stochLen"], stochSmth=g["stochSmth"], longLevel=30, shortLevel=70)}, {"block": "emaTrend", "params": v(emaFast=g["emaFast"], emaSlow=g["emaSlow"])},
            {"block": "bbSqueezeBreakout", "params": v(bbLen=g["bbLen"], bbMult=g["bbMult"], squeezePctile=25, lookbackBars=5)}]},
        "exits": {"hardStop": {"block": "atrHardStop", "params": v(atrLen=g["atrLen"], atrSL=g["atrSL"], emergencySlPct=g["emergencySlPct"])},
                  "target": {"block": "atrScaleOutTarget", "params": v(atrLen=g["atrLen"], **{f"tp{k}Mult": g[f"tp{k}Mult"] for k in (1, 2, 3)}, tp1Pct=g["tp1Pct"], tp2Pct=g["tp2Pct"], tp3Pct=100 - g["tp1Pct"] - g["tp2Pct"])},
                  "trail": {"block": "structuralExit", "params": v(stochLen=g["stochLen"], stochSmth=g["stochSmth"], rsiLen=g["rsiLen"], maxBars=g["maxBars"])}},
        "sizing": {"block": "atrRisk", "params": v(riskPct=g["riskPct"], useInitialCapital=0)},
    }
    return R.run(bars, spec, [{}], settings)
