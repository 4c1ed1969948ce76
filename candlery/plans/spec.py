"""Strategy specs: the catalogue of blocks, and what a spec has to satisfy."""

from __future__ import annotations

import copy
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import canonical_json

KINDS = ["regime", "entry", "filter", "exit", "sizing"]
TRANCHES = {f"tp{k}{part}": bounds for k in range(1, 7) for part, bounds in (("Mult", ("float", 0.5, 20, 0.25)), ("Pct", ("int", 0, 100, 5)))}
#: Fixed: blocks by kind, and their parameters as (type, least, most, step).
BLOCKS: dict[str, dict[str, dict[str, tuple]]] = {
    "entry": {
        "stochCross": {"stochLen": ("int", 5, 40, 1), "stochSmth": ("int", 1, 8, 1), "longLevel": ("float", 10, 50, 1), "shortLevel": ("float", 50, 90, 1)},
        "emaTrend": {"emaFast": ("int", 5, 100, 1), "emaSlow": ("int", 10, 400, 1)},
        "bbSqueezeBreakout": {"bbLen": ("int", 5, 100, 1), "bbMult": ("float", 1.0, 4.0, 0.1), "squeezePctile": ("float", 5, 50, 1), "lookbackBars": ("int", 1, 10, 1)},
        "rsiPullback": {"rsiLen": ("int", 5, 40, 1), "longLevel": ("float", 10, 45, 1), "shortLevel": ("float", 55, 90, 1)},
        "maPullback": {"emaFast": ("int", 5, 60, 1), "emaSlow": ("int", 20, 200, 1)},
        "donchianBreakout": {"period": ("int", 10, 100, 1)},
        "volumeSurge": {"volLen": ("int", 5, 50, 1), "multiplier": ("float", 1.2, 4.0, 0.1)},
    },
    "filter": {
        "htfTrendFilter": {"htfTfMin": ("int", 60, 10080, 60), "maLen": ("int", 10, 200, 1)},
        "volatilityFloor": {"atrLen": ("int", 5, 40, 1), "minAtrPct": ("float", 0.05, 3.0, 0.05)},
        "volumeFilter": {"volLen": ("int", 5, 100, 1), "minMultiplier": ("float", 0.3, 3.0, 0.1)},
        "regimeGate": {},
    },
    "regime": {
        "htfTrendRegime": {"htfTfMin": ("int", 60, 10080, 60), "maLen": ("int", 10, 200, 1), "slopeLookback": ("int", 3, 60, 1), "slopeThreshold": ("float", 0.001, 0.05, 0.001)},
        "volRegime": {"atrLen": ("int", 5, 40, 1), "rankLen": ("int", 20, 500, 10), "highThreshold": ("float", 50, 95, 1), "lowThreshold": ("float", 5, 50, 1)},
        "rangeRegime": {"adxLen": ("int", 7, 40, 1), "adxThreshold": ("float", 15, 50, 1)},
    },
    "exit": {
        "atrHardStop": {"atrLen": ("int", 5, 50, 1), "atrSL": ("float", 0.5, 6.0, 0.05), "emergencySlPct": ("float", 5, 50, 1)},
        "atrScaleOutTarget": {"atrLen": ("int", 5, 50, 1), **TRANCHES},
        "structuralExit": {"stochLen": ("int", 5, 40, 1), "stochSmth": ("int", 1, 8, 1), "rsiLen": ("int", 5, 40, 1), "maxBars": ("int", 5, 200, 1)},
    },
    "sizing": {
        "flat": {"amountUsd": ("float", 100, 1_000_000, 100)}, "pctOfEquity": {"pct": ("float", 1, 100, 1)}, "pctOfInitial": {"pct": ("float", 1, 100, 1)},
        "atrRisk": {"riskPct": ("float", 0.1, 10, 0.1), "useInitialCapital": ("int", 0, 1, 1)},
        "martingale": {"basePct": ("float", 0.1, 10, 0.1), "stepMult": ("float", 1.1, 3.0, 0.1), "maxMult": ("float", 2, 16, 1)},
        "antiMartingale": {"basePct": ("float", 0.1, 10, 0.1), "stepMult": ("float", 1.1, 3.0, 0.1), "maxMult": ("float", 2, 16, 1)},
        "kelly": {"fraction": ("float", 0.1, 1.0, 0.05), "maxFraction": ("float", 0.05, 0.5, 0.05), "minTrades": ("int", 5, 50, 1), "warmupPct": ("float", 0.5, 10, 0.5)},
        "fixedFractional": {"f": ("float", 0.01, 0.5, 0.01), "minWorstLoss": ("float", 100, 10_000, 100)},
        "equityCurveTrading": {"basePct": ("float", 1, 100, 1), "onPct": ("float", 1, 100, 1), "offPct": ("float", 0, 100, 1), "maLen": ("int", 5, 50, 1), "minTrades": ("int", 5, 50, 1)},
        "volTargetSizing": {"targetVolPct": ("float", 0.2, 5.0, 0.1), "atrLen": ("int", 5, 50, 1), "hardCapPct": ("float", 10, 100, 5)},
    },
}
NEEDS_STOP = {"atrRisk"}
NAME = re.compile(r"[0-9]{8}-[0-9]+-[a-z0-9-]+")
OPERATORS, REPAIRS, MODES = ["<", "<=", ">", ">=", "!="], ["clamp-lhs", "clamp-rhs"], ["score", "all", "any"]
DEFAULTS = {
    "fitness": {"weights": {"pf": 0.5, "dd": 0.3, "ret": 0.2}, "caps": {"pf": 4.0, "ret": 1.0}, "gates": {"minTradesPerWindow": 30, "worstRegimePfFloor": 1.0, "wfeMin": 0.5}, "frequencyTarget": 0},
    "walkForward": {"nWindows": 5, "scheme": "anchored"},
}


class SpecError(ValueError):
    """All that is wrong with a spec, one line each."""


def catalogue(spark: SparkSession) -> DataFrame:
    """Block, kind, parameters: a row for each block."""
    rows = [(KINDS.index(kind), kind, name, 1, json.dumps(params)) for kind, blocks in BLOCKS.items() for name, params in blocks.items()]
    return spark.createDataFrame(rows, "kind_order int, kind string, id string, version int, params string")


def references(spec: dict):
    """(path, kind, block reference) of each filled slot, in the order in which they act."""
    if spec.get("regime"):
        yield "regime", "regime", spec["regime"]
    for slot, kind in (("entries", "entry"), ("filters", "filter")):
        for k, ref in enumerate((spec.get(slot) or {}).get("blocks") or []):
            yield f"{slot}.blocks[{k}]", kind, ref
    for slot in ("hardStop", "target", "trail"):
        if ref := (spec.get("exits") or {}).get(slot):
            yield f"exits.{slot}", "exit", ref
    if spec.get("sizing"):
        yield "sizing", "sizing", spec["sizing"]


def qualified(ref: dict, param: str) -> str:
    return f"{ref['block']}.{ref.get('instanceId', 'main')}.{param}"


def _check_value(path: str, value, bounds: tuple) -> list[str]:
    kind, low, high, step = bounds
    if not isinstance(value, dict):
        return [f"{path}: has to be {{value}} or {{min, max, step}}"]
    given = {k: value[k] for k in ("value", "min", "max", "step") if k in value}
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in given.values()):
        return [f"{path}: numbers only"]
    out = []
    if "value" in given:
        if not low <= given["value"] <= high:
            out.append(f"{path}: {given['value']} is outside {low} to {high}")
        if kind == "int" and given["value"] != int(given["value"]):
            out.append(f"{path}: has to be a whole number")
    elif {"min", "max", "step"} <= given.keys():
        if given["min"] > given["max"] or given["min"] < low or given["max"] > high:
            out.append(f"{path}: {given['min']} to {given['max']} is outside {low} to {high}")
        r = given["step"] / step
        if given["step"] <= 0 or abs(r - round(r)) > 1e-9:
            out.append(f"{path}: step {given['step']} is no multiple of {step}")
    else:
        out.append(f"{path}: needs value, or min, max and step")
    return out


#: Rules over a block's own parameters.
RULES = {"emaTrend": ("emaFast", "<", "emaSlow"), "maPullback": ("emaFast", "<", "emaSlow"), "volRegime": ("lowThreshold", "<", "highThreshold")}


def rules_of(spec: dict) -> list[dict]:
    """The blocks' own rules as constraints over qualified parameters, a pinned right side as its number."""
    out = []
    for _, _, ref in references(spec):
        if ref.get("block") in RULES:
            lhs, op, rhs = RULES[ref["block"]]
            params = ref.get("params") or {}
            if lhs in params and rhs in params:
                free = [isinstance(params[x], dict) and "min" in params[x] and "value" not in params[x] for x in (lhs, rhs)]
                if any(free):
                    fixed = params[rhs].get("value") if isinstance(params[rhs], dict) else params[rhs]
                    out.append({"lhs": qualified(ref, lhs), "op": op, "rhs": qualified(ref, rhs) if free[1] else fixed, "repair": "clamp-lhs" if free[0] else "clamp-rhs"})
    return out


def _broken_rules(spec: dict) -> list[str]:
    """Rules that pinned parameters, or the ends of ranges, cannot keep."""
    out = []
    for path, _, ref in references(spec):
        lhs, op, rhs = RULES.get(ref.get("block"), (None, None, None))
        params = ref.get("params") or {}
        if lhs in params and rhs in params and all(isinstance(params[x], dict) for x in (lhs, rhs)):
            least, most = params[lhs].get("value", params[lhs].get("min")), params[rhs].get("value", params[rhs].get("max"))
            if isinstance(least, (int, float)) and isinstance(most, (int, float)) and least >= most:
                out.append(f"{path}: {lhs} has to be less than {rhs}")
    return out


def problems(spec: dict) -> list[str]:
    """Everything that is wrong with a spec."""
    out = []
    if not isinstance(spec.get("name"), str) or not NAME.fullmatch(spec["name"]):
        out.append(f"name: {spec.get('name')!r} isn't YYYYMMDD-<id>-<name>")
    ids = set()
    for path, kind, ref in references(spec):
        if ref.get("block") not in BLOCKS[kind]:
            out.append(f"{path}: no {kind} block {ref.get('block')!r}")
            continue
        known, params = BLOCKS[kind][ref["block"]], ref.get("params") or {}
        free = ref["block"] == "regimeGate"  # takes lists of labels
        out += [f"{path}.params.{p}: unknown" for p in params if p not in known and not free]
        out += [f"{path}.params.{p}: missing" for p in known if p not in params and p not in TRANCHES]
        for p, value in params.items():
            if p in known:
                out += _check_value(f"{path}.params.{p}", value, known[p])
                ids.add(qualified(ref, p))
    out += _broken_rules(spec)
    entries, exits = spec.get("entries") or {}, spec.get("exits") or {}
    if not entries.get("blocks"):
        out.append("entries.blocks: at least one is needed")
    if entries.get("mode", "score") not in MODES or (spec.get("filters") or {}).get("mode", "all") not in MODES:
        out.append("mode: one of " + ", ".join(MODES))
    if not spec.get("sizing"):
        out.append("sizing: needed")
    elif spec["sizing"].get("block") in NEEDS_STOP and not exits.get("hardStop"):
        out.append(f"sizing: {spec['sizing']['block']} needs a hardStop")
    if not any(exits.get(s) for s in ("hardStop", "target", "trail")):
        out.append("exits: at least one is needed")
    for k, c in enumerate(spec.get("constraints") or []):
        if c.get("lhs") not in ids or (isinstance(c.get("rhs"), str) and c["rhs"] not in ids) or not isinstance(c.get("rhs"), (str, int, float)):
            out.append(f"constraints[{k}]: unknown parameter")
        if c.get("op") not in OPERATORS or c.get("repair", "clamp-lhs") not in REPAIRS:
            out.append(f"constraints[{k}]: unknown operator or repair")
    fitness, walk = spec.get("fitness") or {}, spec.get("walkForward") or {}
    weights = fitness.get("weights") or {}
    if any(w < 0 for w in weights.values()) or (sum(weights.values()) > 0 and abs(sum(weights.values()) - 1) > 0.01):
        out.append("fitness.weights: not negative, and 1 together")
    if any(c <= 0 for c in (fitness.get("caps") or {}).values()):
        out.append("fitness.caps: positive")
    if not 0 <= (fitness.get("gates") or {}).get("wfeMin", 0) <= 1:
        out.append("fitness.gates.wfeMin: 0 to 1")
    if walk.get("nWindows", 2) < 2 or walk.get("scheme", "anchored") not in ("anchored", "rolling"):
        out.append("walkForward: 2 windows at least, anchored or rolling")
    return out


def completed(spec: dict) -> dict:
    """The spec with defaults filled in, sharing its parts with the one given; raises SpecError with all problems."""
    if wrong := problems(spec):
        raise SpecError("\n".join(wrong))
    out = {k: v for k, v in spec.items() if k != "hash"}
    for section, default in DEFAULTS.items():
        mine = out.get(section) or {}
        out[section] = {k: v | (mine.get(k) or {}) if isinstance(v, dict) else mine.get(k, v) for k, v in default.items()} | {k: v for k, v in mine.items() if k not in default}
    return {"filters": {"mode": "all", "blocks": []}, "regime": None, "constraints": []} | {k: v for k, v in out.items() if v is not None}


def validate(spec: dict) -> dict:
    """The spec with defaults filled in and its hash, a copy throughout; raises SpecError with all problems."""
    out = copy.deepcopy(completed(spec))
    return out | {"hash": spec_hash(out)}


def spec_hash(spec: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in spec.items() if k != "hash"}).encode()).hexdigest()
