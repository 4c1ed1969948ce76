"""What a block is, the registry of blocks, and checks of a block before it is used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.candles import indexed

KINDS = ["regime", "entry", "filter", "exit", "sizing"]
SLOTS = ["hardStop", "target", "trail"]
DIRECTIONS = ["long", "short", "both"]


@dataclass(frozen=True)
class Block:
    """A pluggable part of a strategy.

    columns(bars, params, name) adds the block's columns: {name}_long and {name}_short (entry, filter), {name} (regime)
    or {name}_{key} for each of keys (exit, sizing). sides(params), where a block has it, gives the same columns by their
    endings as plain expressions over the bars and the indicators of deps, so that many blocks go into one step. acts(params) makes what the account asks: an exit with open() and
    bar(), or a sizing with units(). deps(params) names what columns needs beyond the bars (see operators.dependencies).
    rules: (lhs, op, rhs) over the block's own parameters.
    """

    id: str
    kind: str
    params: dict[str, tuple] = field(default_factory=dict)
    columns: Callable | None = None
    acts: Callable | None = None
    sides: Callable | None = None
    version: int = 1
    slot: str | None = None
    direction: str = "both"
    keys: tuple[str, ...] = ()
    deps: Callable = lambda params: []
    rules: tuple[tuple[str, str, str], ...] = ()
    needs_stop: bool = False
    optional: frozenset = frozenset()
    description: str = ""


class BlockError(ValueError):
    """All that is wrong with a block, one line each."""


def problems_of(block: Block) -> list[str]:
    out = []
    if not isinstance(block.id, str) or not block.id:
        out.append("id: a text is needed")
    if isinstance(block.version, bool) or not isinstance(block.version, int) or block.version < 1:
        out.append("version: a whole number from 1 on")
    if block.kind not in KINDS:
        out.append("kind: one of " + ", ".join(KINDS))
    if not isinstance(block.description, str):
        out.append("description: has to be a text")
    if block.kind == "exit" and block.slot not in SLOTS:
        out.append("slot: one of " + ", ".join(SLOTS))
    if block.kind in ("entry", "filter", "exit") and block.direction not in DIRECTIONS:
        out.append("direction: one of " + ", ".join(DIRECTIONS))
    if not callable(block.deps):
        out.append("deps: has to be callable")
    if block.kind in ("regime", "entry", "filter") and not callable(block.columns):
        out.append("columns: has to be callable")
    if block.kind in ("exit", "sizing") and not callable(block.acts):
        out.append("acts: has to be callable")
    if block.keys and not callable(block.columns):
        out.append("keys: need columns")
    for name, bounds in block.params.items():
        if not isinstance(name, str) or not name:
            out.append("params: names have to be texts")
        elif len(bounds) != 4 or bounds[0] not in ("int", "float") or any(isinstance(b, bool) or not isinstance(b, (int, float)) for b in bounds[1:]):
            out.append(f"params.{name}: (int or float, least, most, step)")
        elif not bounds[1] < bounds[2]:
            out.append(f"params.{name}: {bounds[1]} isn't less than {bounds[2]}")
        elif bounds[3] <= 0:
            out.append(f"params.{name}: the step has to be positive")
    for lhs, op, rhs in block.rules:
        if lhs not in block.params or rhs not in block.params or op not in ("<", "<=", ">", ">=", "!="):
            out.append(f"rules: {lhs} {op} {rhs} isn't over its parameters")
    return out


class Registry:
    """Blocks by id and version."""

    def __init__(self):
        self._blocks: dict[str, dict[int, Block]] = {}

    def register(self, block: Block) -> Block:
        wrong = problems_of(block)
        if not wrong and block.version in self._blocks.get(block.id, {}):
            wrong = ["is registered already"]
        if wrong:
            raise BlockError("\n".join(f"{block.id or '(no id)'} v{block.version}: {w}" for w in wrong))
        self._blocks.setdefault(block.id, {})[block.version] = block
        return block

    def versions(self, name: str) -> list[int]:
        return sorted(self._blocks.get(name, {}))

    def has(self, name: str, version: int | None = None) -> bool:
        return bool(self.versions(name)) if version is None else version in self._blocks.get(name, {})

    def get(self, name: str, version: int | None = None) -> Block:
        if not self.has(name, version):
            raise KeyError(f"no block {name!r}" + ("" if version is None else f" v{version}"))
        return self._blocks[name][self.versions(name)[-1] if version is None else version]

    def all(self, kind: str | None = None) -> list[Block]:
        found = [b for versions in self._blocks.values() for b in versions.values() if kind in (None, b.kind)]
        return sorted(found, key=lambda b: (KINDS.index(b.kind), b.id, b.version))


def looks_ahead(block: Block, bars: DataFrame, params: dict, cutoffs: tuple[int, ...] = (150, 200, 250)) -> DataFrame:
    """(cutoff, bar_ts, symbol) of rows whose columns change when all bars from the cutoff on are left out; empty if none.

    Each cutoff's bars are a series of their own, so all run in one pass of the block.
    """
    at = indexed(bars)
    parts = at.withColumn("cutoff", F.explode(F.array(*(F.lit(c) for c in (*cutoffs, None))))).where("cutoff is null or i < cutoff")
    marked = parts.withColumn("symbol", F.concat_ws("\x01", "symbol", F.coalesce(F.col("cutoff").cast("string"), F.lit("all")))).drop("i", "cutoff")
    out = block.columns(marked, params, "x")
    new = [c for c in out.columns if c not in marked.columns]
    out = out.select(F.split("symbol", "\x01")[0].alias("symbol"), F.split("symbol", "\x01")[1].alias("part"), "bar_ts", F.to_json(F.struct(*new), {"ignoreNullFields": "false"}).alias("seen"))
    full = out.where("part = 'all'").select("symbol", "bar_ts", F.col("seen").alias("whole"))
    return out.where("part <> 'all'").join(full, ["symbol", "bar_ts"]).where("not seen <=> whole").select(F.col("part").cast("int").alias("cutoff"), "symbol", "bar_ts")
