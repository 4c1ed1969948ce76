"""Running a spec: its blocks become columns, once for each distinct choice of parameters, and its exits and sizing an account.

Many genes run in one job: what their blocks need is computed side by side over the bars, then each bar becomes a row
for each gene, and each (symbol, gene) series is walked by a task of its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import blocks as B
from ..operators.dependencies import with_dependencies
from . import exits as X
from .contract import SLOTS, Block, Registry
from .library import REGISTRY
from .spec import qualified, references

TRADE = "symbol string, gene_id long, position long, direction string, entry_ts long, exit_ts long, signal string, entry_price double, exit_price double, units double, risk double, pnl double, equity double, regime string"
SUMMARY = "symbol string, gene_id long, trades long, positions long, wins long, pf double, net double, net_pct double, annual_return double, max_dd double, max_dd_pct double, sharpe double, equity double, regimes array<struct<regime: string, trades: long, wins: long, gross_profit: double, gross_loss: double>>"
SETTINGS = {"initial": 100_000.0, "slippage": 0.02, "commission": 0.0006, "leverage": 1.0, "start": 0, "fitness": 0, "years": 0.0}
BAR = ["bar_ts", "open", "high", "low", "close"]


@dataclass(frozen=True)
class Slot:
    """A filled slot of a spec: where, which block, and its parameters for one gene."""

    path: str
    block: Block
    params: tuple[tuple[str, object], ...]

    @property
    def p(self) -> dict:
        return dict(self.params)


def hydrate(ref: dict, block: Block, gene: dict) -> tuple[tuple[str, object], ...]:
    """A reference's parameters: the gene's, else the pinned ones; whole where the block says so."""
    out = {}
    for name, given in (ref.get("params") or {}).items():
        value = gene.get(qualified(ref, name))
        if value is None:
            value = given.get("value", given.get("min")) if isinstance(given, dict) else given
        kind = block.params.get(name, ("",))[0]
        out[name] = int(round(value)) if kind == "int" else float(value) if kind == "float" else value
    return tuple(sorted(out.items()))


def resolve(spec: dict, gene: dict | None = None, registry: Registry = REGISTRY) -> list[Slot]:
    """The spec's slots in the order in which they act: regime, entries, filters, hardStop, target, trail, sizing."""
    out = []
    for path, kind, ref in references(spec):
        block = registry.get(ref["block"], ref.get("version"))
        if block.kind != kind or kind == "exit" and block.slot != path.removeprefix("exits."):
            raise ValueError(f"{path}: {block.id} is no {kind} block of this slot")
        out.append(Slot(path, block, hydrate(ref, block, gene or {})))
    return out


def threshold(spec: dict, slot: str, gene: dict) -> float:
    """How many votes a slot in score mode needs; 1 if nothing is said."""
    given = (spec.get(slot) or {}).get("threshold")
    value = gene.get(f"_meta.{slot}.threshold")
    if value is None:
        value = given.get("value", given.get("min")) if isinstance(given, dict) else given
    return 1 if value is None else value


def plan(spec: dict, genes: list[dict], registry: Registry = REGISTRY) -> DataFrame:
    """(gene_id, place, path, block, version, params as JSON) of the slots that a run would use."""
    rows = [(int(g.get("gene_id", k)), i, s.path, s.block.id, s.block.version, json.dumps(s.p, sort_keys=True)) for k, g in enumerate(genes) for i, s in enumerate(resolve(spec, g, registry))]
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(rows, "gene_id long, place int, path string, block string, version int, params string")


def series(bars: DataFrame, spec: dict, genes: list[dict], registry: Registry = REGISTRY) -> DataFrame:
    """What the account reads, for each gene (gene_id, else its place in the list): bars, long_ok, short_ok, regime and
    {slot}_{key} of the exits' and the sizing's columns."""
    plans = [resolve(spec, g, registry) for g in genes]
    deps = dict.fromkeys(d for slots in plans for s in slots for d in s.block.deps(s.p))
    bars = with_dependencies(bars, deps)
    names: dict[tuple, str] = {}
    plain: dict[str, object] = {}  # columns that are expressions over the bars, all added in one step

    def name_of(slot: Slot, regime: str | None) -> str:
        """The columns of a block with these parameters; a gate's also depend on the regime it reads."""
        nonlocal bars
        gate = slot.block.kind == "filter" and slot.block.id == "regimeGate"
        key = slot.block.id, slot.block.version, slot.params, regime if gate else None
        if key not in names:
            names[key] = f"b{len(names)}"
            if gate:
                label = F.col(regime) if regime else F.lit(None).cast("string")
                bars = slot.block.columns(bars.withColumn("regime", label), slot.p, names[key]).drop("regime")
            elif slot.block.sides:
                plain.update({f"{names[key]}_{ending}": x for ending, x in slot.block.sides(slot.p).items()})
            elif slot.block.columns:
                bars = slot.block.columns(bars, slot.p, names[key])
        return names[key]

    rows = []
    for k, (gene, slots) in enumerate(zip(genes, plans)):
        regime = next((name_of(s, None) for s in slots if s.block.kind == "regime"), None)
        votes = {kind: [(name_of(s, regime), s.block.direction) for s in slots if s.block.kind == kind] for kind in ("entry", "filter")}

        def side(kind: str, slot: str, way: str, mode: str):
            eligible = [n for n, d in votes[kind] if d in ("both", way)]
            if kind == "filter" and (not votes[kind] or mode == "all" and not eligible):
                return F.lit(True)
            return B.entry_ok(eligible, way, mode, threshold(spec, slot, gene))

        modes = (spec.get("entries") or {}).get("mode", "score"), (spec.get("filters") or {}).get("mode", "all")
        ok = {way: side("entry", "entries", way, modes[0]) & side("filter", "filters", way, modes[1]) for way in ("long", "short")}
        extra = []
        for s in slots:
            if s.block.kind in ("exit", "sizing"):
                base = name_of(s, regime)
                extra += [(f"{s.path.removeprefix('exits.')}_{key}", f"{base}_{key}") for key in s.block.keys]
        rows.append((int(gene.get("gene_id", k)), ok, regime, extra))
    structs = [
        F.struct(F.lit(g).cast("long").alias("gene_id"), ok["long"].alias("long_ok"), ok["short"].alias("short_ok"), (F.col(regime) if regime else F.lit(None).cast("string")).alias("regime"), *(F.col(c).alias(n) for n, c in extra))
        for g, ok, regime, extra in rows
    ]
    return bars.withColumns(plain).select("symbol", *BAR, F.inline(F.array(*structs)))


def _accounts(spec: dict, genes: list[dict], registry: Registry) -> dict[int, tuple[dict, object]]:
    out = {}
    for k, g in enumerate(genes):
        slots = {s.path.removeprefix("exits."): s for s in resolve(spec, g, registry)}
        out[int(g.get("gene_id", k))] = {n: slots[n].block.acts(slots[n].p) for n in SLOTS if n in slots}, slots["sizing"].block.acts(slots["sizing"].p)
    return out


def _walk(rows: DataFrame, spec: dict, genes: list[dict], settings: dict | None, registry: Registry, schema: str, told) -> DataFrame:
    settings, accounts = SETTINGS | (settings or {}), _accounts(spec, genes, registry)
    columns = [c for c in rows.columns if c not in ("symbol", "gene_id")]
    names = [c.split()[0] for c in schema.split("array<")[0].rstrip().split(", ")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar_ts")
        if int(key[1]) not in accounts:
            raise ValueError(f"gene_id {key[1]} is none of the genes given")
        exits, sizing = accounts[int(key[1])]
        bars = {c: [None if x is None or x != x else x for x in group[c].tolist()] if c == "regime" else group[c].tolist() for c in columns}
        account = X.Account(bars, exits, sizing, settings).run()
        return pd.DataFrame([(key[0], int(key[1]), *row) for row in told(account, settings)], columns=names)

    return rows.groupBy("symbol", "gene_id").applyInPandas(run, schema)


def trades(rows: DataFrame, spec: dict, genes: list[dict], settings: dict | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """One row for each closed slice of each (symbol, gene) of series()."""
    return _walk(rows, spec, genes, settings, registry, TRADE, lambda account, s: account.trades)


def summaries(rows: DataFrame, spec: dict, genes: list[dict], settings: dict | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """One row for each (symbol, gene), with drawdown marked to market and trades from the fitness bar on."""
    return _walk(rows, spec, genes, settings, registry, SUMMARY, lambda account, s: [account.summary(s["years"])])


def snapshots(rows: DataFrame, spec: dict, genes: list[dict], settings: dict | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """Equity at each bar, with the open position at the close."""
    return _walk(rows, spec, genes, settings, registry, "symbol string, gene_id long, bar_ts long, equity double", lambda account, s: account.marks)


def run(bars: DataFrame, spec: dict, genes: list[dict], settings: dict | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """The entry point: a validated spec over bars, a summary for each symbol and gene."""
    return summaries(series(bars, spec, genes, registry), spec, genes, settings, registry)

