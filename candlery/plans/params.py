"""The parameter space of a spec: a small table, genes as rows, and their rules as columns."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import snap
from .spec import BLOCKS, qualified, references

PARAM = "id string, type string, min double, max double, step double"
#: Fixed: the parameters of the original three-target strategy.
CLASSIC = [
    ("minEntry", "int", 1, 3, 1), ("stochLen", "int", 5, 40, 1), ("stochSmth", "int", 1, 8, 1), ("rsiLen", "int", 5, 25, 1), ("emaFast", "int", 8, 40, 1), ("emaSlow", "int", 30, 150, 5),
    ("bbLen", "int", 10, 40, 1), ("bbMult", "float", 1.0, 3.5, 0.5), ("atrLen", "int", 5, 30, 1), ("atrSL", "float", 0.5, 4.0, 0.25), ("tp1Mult", "float", 1.5, 3.0, 0.25), ("tp2Mult", "float", 1.5, 6.0, 0.25),
    ("tp3Mult", "float", 3.0, 12.0, 0.5), ("tp1Pct", "int", 10, 50, 5), ("tp2Pct", "int", 10, 50, 5), ("riskPct", "float", 0.5, 5.0, 0.5), ("maxBars", "int", 5, 40, 5), ("emergencySlPct", "int", 5, 25, 1),
]


def derive(spec: dict) -> tuple[list[tuple], dict[str, float]]:
    """(id, type, min, max, step) of what may vary, and what is pinned; vote thresholds count as parameters."""
    free, pinned = [], {}
    for _, kind, ref in references(spec):
        for p, v in (ref.get("params") or {}).items():
            q = qualified(ref, p)
            if not isinstance(v, dict):
                pinned[q] = v
            elif "value" in v or v["min"] == v["max"]:
                pinned[q] = v.get("value", v.get("min"))
            else:
                free.append((q, BLOCKS[kind][ref["block"]][p][0], float(v["min"]), float(v["max"]), float(v["step"])))
    for slot in ("entries", "filters"):
        t = (spec.get(slot) or {}).get("threshold")
        if isinstance(t, dict) and "min" in t and t["min"] < t["max"]:
            free.append((f"_meta.{slot}.threshold", "int", float(t["min"]), float(t["max"]), float(t.get("step", 1))))
        elif t is not None:
            pinned[f"_meta.{slot}.threshold"] = t.get("value", t.get("min")) if isinstance(t, dict) else t
    return free, pinned


def table_of(spark: SparkSession, params: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, float(a), float(b), float(s)) for i, t, a, b, s in params], PARAM)


def on_grid(x: Column, p: tuple) -> Column:
    return F.round(snap(x, F.lit(float(p[2])), F.lit(float(p[3])), F.lit(float(p[4]))), 6)


def random_genes(spark: SparkSession, params: list[tuple], n: int, seed: int) -> DataFrame:
    """n genes (gene_id and a column for each parameter) on the grid; the same for the same seed."""
    return genes_for(spark.range(n).withColumnRenamed("id", "gene_id"), params, seed)


def genes_for(ids: DataFrame, params: list[tuple], seed: int) -> DataFrame:
    """A gene for each gene_id."""

    def draw(k: int, p: tuple) -> Column:
        steps = round((p[3] - p[2]) / p[4])
        u = F.pmod(F.xxhash64("gene_id", F.lit(seed), F.lit(k)), F.lit(steps + 1))
        return F.round(p[2] + u * float(p[4]), 6).alias(p[0])

    return ids.select("gene_id", *(draw(k, p) for k, p in enumerate(params)))


def _chance(seed: int, *salt) -> Column:
    return F.pmod(F.xxhash64("gene_id", F.lit(seed), *(F.lit(s) for s in salt)), F.lit(1 << 20)) / float(1 << 20)


def mutate(genes: DataFrame, params: list[tuple], rate: float | Column, seed: int) -> DataFrame:
    """Each parameter moves one to three steps with the given chance."""

    def moved(k: int, p: tuple) -> Column:
        sign = F.when(_chance(seed, k, "d") < 0.5, -1).otherwise(1)
        size = 1 + F.floor(_chance(seed, k, "m") * 3)
        x = F.col(f"`{p[0]}`")
        return F.when(_chance(seed, k, "p") < rate, on_grid(x + sign * size * float(p[4]), p)).otherwise(x).alias(p[0])

    return genes.select("gene_id", *(moved(k, p) for k, p in enumerate(params)))


def cross(pairs: DataFrame, params: list[tuple], seed: int) -> DataFrame:
    """Children of (gene_id, a, b), a and b structs of genes: each parameter from either parent."""
    return pairs.select("gene_id", *(F.when(_chance(seed, k, "x") < 0.5, F.col("a")[p[0]]).otherwise(F.col("b")[p[0]]).alias(p[0]) for k, p in enumerate(params)))


def repair(genes: DataFrame, params: list[tuple], constraints: list[dict]) -> DataFrame:
    """Each constraint in turn: where it fails one side moves just beyond the other, onto its grid."""
    known = {p[0]: p for p in params}
    for c in constraints:
        lhs = F.col(f"`{c['lhs']}`")
        literal = not isinstance(c["rhs"], str)
        rhs = F.lit(float(c["rhs"])) if literal else F.col(f"`{c['rhs']}`")
        holds = {"<": lhs < rhs, "<=": lhs <= rhs, ">": lhs > rhs, ">=": lhs >= rhs, "!=": lhs != rhs}[c["op"]]
        right = c.get("repair") == "clamp-rhs" and not literal
        name = c["rhs"] if right else c["lhs"]
        mine, fixed = (rhs, lhs) if right else (lhs, rhs)
        step = float(known[name][4])
        apart = step if c["op"] in ("<", ">") else 0.0
        up = (c["op"][0] == "<") == right
        target = mine + step if c["op"] == "!=" else F.greatest(fixed + apart, mine) if up else F.least(fixed - apart, mine)
        genes = genes.withColumn(name, F.when(holds, F.col(f"`{name}`")).otherwise(on_grid(target, known[name])))
    return genes


def repair_classic(genes: DataFrame) -> DataFrame:
    """The original strategy's rules: slow beyond fast, targets apart, shares of 90 at most."""
    p, c = {x[0]: x for x in CLASSIC}, F.col
    for name, bad, to in (
        ("emaSlow", c("emaFast") >= c("emaSlow"), c("emaFast") + 10), ("tp2Mult", c("tp1Mult") >= c("tp2Mult"), c("tp1Mult") + 0.5),
        ("tp3Mult", c("tp2Mult") >= c("tp3Mult"), c("tp2Mult") + 1.0), ("tp2Pct", c("tp1Pct") + c("tp2Pct") > 90, 90 - c("tp1Pct")),
    ):
        genes = genes.withColumn(name, F.when(bad, on_grid(to, p[name])).otherwise(c(name)))
    return genes


def freeze(genes: DataFrame, frozen: dict[str, float]) -> DataFrame:
    """Knock-outs: named parameters held at a value."""
    return reduce(lambda g, kv: g.withColumn(kv[0], F.lit(float(kv[1]))) if kv[0] in g.columns else g, frozen.items(), genes)


def midpoint(p: tuple) -> float:
    return round(p[2] + int((p[3] - p[2]) / 2 / p[4] + 0.5) * p[4], 6)


def sweep(params: list[tuple], planets: int) -> list[dict[str, float]]:
    """Planet 0 is the control; each other one holds one parameter at its midpoint, in turn."""
    return [{} if k == 0 else {params[(k - 1) % len(params)][0]: midpoint(params[(k - 1) % len(params)])} for k in range(planets)]


def mutation_gradient(spark: SparkSession, islands: int, rate: float) -> DataFrame:
    """From cautious to bold islands: mutation rate and the chance for each parameter."""
    t = F.lit(0.5) if islands == 1 else F.col("island") / float(islands - 1)
    island = spark.range(islands).withColumnRenamed("id", "island")
    return island.select("island", F.least(F.lit(rate) * (1.0 if islands == 1 else 0.5 + t), F.lit(0.9)).alias("mutation_rate"), (0.12 + t * 0.18).alias("per_gene"))


def _around(a: int, b: int, size: int) -> int:
    """Steps from a to b on a circle."""
    straight = abs(a - b)
    return min(straight, size - straight)


def edges(count: int, kind: str, rng: random.Random) -> list[tuple[int, int]]:
    """Where each of `count` islands (or planets) sends to: the next one of a ring, a random other one, or those a step
    away on a torus, a nearly square grid filled row by row whose ends meet."""
    if kind == "ring":
        return [(k, (k + 1) % count) for k in range(count)] if count > 1 else []
    if kind == "random":
        return [(k, rng.choice([t for t in range(count) if t != k])) for k in range(count)] if count > 1 else []
    if kind != "torus":
        raise ValueError(f"unknown topology {kind!r}; known: ring, torus, random")
    wide = max(2, round(math.sqrt(count)))
    tall = math.ceil(count / wide)
    steps = lambda a, b: _around(a // wide, b // wide, tall) + _around(a % wide, b % wide, wide)
    return [(a, b) for a in range(count) for b in range(count) if steps(a, b) == 1]


def topology(spark: SparkSession, islands: int, kind: str, seed: int = 0) -> DataFrame:
    """The edges as a table (island, target)."""
    return spark.createDataFrame(edges(islands, kind, random.Random(seed)), "island long, target long")


def lookback(spec: dict) -> dict[int, int]:
    """Bars of history that the most demanding choice of parameters needs, by timeframe in minutes (0: the base)."""
    need: dict[int, int] = {0: 200}
    most = lambda v: v.get("value", v.get("max", 0)) if isinstance(v, dict) else 0
    for _, _, ref in references(spec):
        params = ref.get("params") or {}
        longest = sum(most(v) for p, v in params.items() if p.endswith(("Len", "Slow", "period", "Lookback")))
        tf = most(params["htfTfMin"]) if "htfTfMin" in params else 0
        need[int(tf)] = max(need.get(int(tf), 0), int(longest) + 1)
    return need
