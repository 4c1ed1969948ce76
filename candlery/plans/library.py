"""The library's blocks: rules of operators.blocks, exits and sizings of plans.exits, under their parameters' bounds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import blocks as B, indicators as I
from . import exits as X
from .contract import Block, Registry
from .spec import BLOCKS, RULES, TRANCHES

REGISTRY = Registry()
#: Fixed: levels at which a broken structure ends a position, and how many bars back the RSI is looked at.
STOCH_OUT, RSI_LONG, RSI_SHORT, RSI_BACK = (60, 40), (40, 55), (60, 45), 3


def _signals(f, *names):
    """A rule whose arguments are the parameters in this order."""
    return lambda bars, p, name: f(bars, *(int(p[n]) if kind == "int" else p[n] for n, kind in names), name=name)


def _add(kind: str, name: str, **more) -> None:
    REGISTRY.register(Block(name, kind, BLOCKS[kind][name], rules=(RULES[name],) if name in RULES else (), sides=SIDES.get(name), **more))


def _length(p: dict, key: str) -> int:
    return int(p[key])


def _atr(bars: DataFrame, p: dict, name: str, key: str = "atrLen") -> DataFrame:
    return I.with_recursive(bars, {f"{name}_atr": ("atr", _length(p, key))})


def structure(bars: DataFrame, p: dict, name: str) -> DataFrame:
    """{name}_long and {name}_short: the stochastic turned beyond its level, or the RSI fell from one side to the other."""
    before = bars.columns
    bars = I.with_recursive(bars, {f"{name}_r": ("rsi", _length(p, "rsiLen"))}).withColumn(f"{name}_s", I.stoch(B.C(), B.H(), B.L(), _length(p, "stochLen")))
    bars = bars.withColumn(f"{name}_k", I.sma(F.col(f"{name}_s"), _length(p, "stochSmth"))).withColumn(f"{name}_d", I.sma(F.col(f"{name}_k"), _length(p, "stochSmth")))
    k, d, r, back = F.col(f"{name}_k"), F.col(f"{name}_d"), F.col(f"{name}_r"), F.lag(f"{name}_r", RSI_BACK).over(I.series())

    def either(a: Column, b: Column) -> Column:
        return B.no(a) | B.no(b)

    long = either(I.cross_under(k, d) & (k > STOCH_OUT[0]), (r < RSI_LONG[0]) & (back > RSI_LONG[1]))
    short = either(I.cross_over(k, d) & (k < STOCH_OUT[1]), (r > RSI_SHORT[0]) & (back < RSI_SHORT[1]))
    out = bars.withColumns({f"{name}_long": long, f"{name}_short": short})
    return out.select(*before, f"{name}_long", f"{name}_short")


def _known(kind: str, p: dict, key: str) -> Column:
    return F.col(I.known_as(kind, _length(p, key)))


def _both(sides) -> dict[str, Column]:
    return {"long": B.no(sides[0]), "short": B.no(sides[1])}


def _atr_of(p: dict) -> dict[str, Column]:
    return {"atr": _known("atr", p, "atrLen")}


#: Rules as expressions over known indicators.
SIDES = {
    "emaTrend": lambda p: _both(B.trend_sides(_known("ema", p, "emaFast"), _known("ema", p, "emaSlow"))),
    "rsiPullback": lambda p: _both(B.rsi_sides(_known("rsi", p, "rsiLen"), p["longLevel"], p["shortLevel"])),
    "maPullback": lambda p: _both(B.pullback_sides(_known("ema", p, "emaFast"), _known("ema", p, "emaSlow"))),
    "donchianBreakout": lambda p: _both(B.donchian_sides(_length(p, "period"))),
    "volumeSurge": lambda p: _both(B.surge_sides(_length(p, "volLen"), p["multiplier"])),
    "htfTrendFilter": lambda p: _both(B.htf_sides(_length(p, "htfTfMin"), _length(p, "maLen"))),
    "volatilityFloor": lambda p: _both(B.floor_sides(_known("atr", p, "atrLen"), p["minAtrPct"])),
    "atrHardStop": _atr_of, "atrScaleOutTarget": _atr_of, "volTargetSizing": _atr_of,
}
N, X_ = "int", "float"
_add("entry", "stochCross", columns=_signals(B.stoch_cross, ("stochLen", N), ("stochSmth", N), ("longLevel", X_), ("shortLevel", X_)))
_add("entry", "emaTrend", columns=_signals(B.ema_trend, ("emaFast", N), ("emaSlow", N)), deps=lambda p: [("ema", _length(p, "emaFast")), ("ema", _length(p, "emaSlow"))])
_add("entry", "bbSqueezeBreakout", columns=_signals(B.squeeze_breakout, ("bbLen", N), ("bbMult", X_), ("squeezePctile", X_), ("lookbackBars", N)))
_add("entry", "rsiPullback", columns=_signals(B.rsi_pullback, ("rsiLen", N), ("longLevel", X_), ("shortLevel", X_)), deps=lambda p: [("rsi", _length(p, "rsiLen"))])
_add("entry", "maPullback", columns=_signals(B.ma_pullback, ("emaFast", N), ("emaSlow", N)), deps=lambda p: [("ema", _length(p, "emaFast")), ("ema", _length(p, "emaSlow"))])
_add("entry", "donchianBreakout", columns=_signals(B.donchian, ("period", N)))
_add("entry", "volumeSurge", columns=_signals(B.volume_surge, ("volLen", N), ("multiplier", X_)))
_add("filter", "htfTrendFilter", columns=_signals(B.htf_trend_filter, ("htfTfMin", N), ("maLen", N)), deps=lambda p: B.htf_deps(_length(p, "htfTfMin"), _length(p, "maLen")))
_add("filter", "volatilityFloor", columns=_signals(B.volatility_floor, ("atrLen", N), ("minAtrPct", X_)), deps=lambda p: [("atr", _length(p, "atrLen"))])
_add("filter", "volumeFilter", columns=_signals(B.volume_filter, ("volLen", N), ("minMultiplier", X_)))
_add("filter", "regimeGate", columns=lambda bars, p, name: B.regime_gate(bars, str(p.get("allowedLong") or "*"), str(p.get("allowedShort") or "*"), name=name))
_add("regime", "htfTrendRegime", columns=_signals(B.htf_trend_regime, ("htfTfMin", N), ("maLen", N), ("slopeLookback", N), ("slopeThreshold", X_)), deps=lambda p: B.htf_deps(_length(p, "htfTfMin"), _length(p, "maLen"), _length(p, "slopeLookback")))
_add("regime", "volRegime", columns=_signals(B.vol_regime, ("atrLen", N), ("rankLen", N), ("highThreshold", X_), ("lowThreshold", X_)), deps=lambda p: [("atr", _length(p, "atrLen"))])
_add("regime", "rangeRegime", columns=_signals(B.range_regime, ("adxLen", N), ("adxThreshold", X_)), deps=lambda p: [("adx", _length(p, "adxLen"))])
_add("exit", "atrHardStop", slot="hardStop", columns=_atr, keys=("atr",), acts=X.HardStop, deps=lambda p: [("atr", _length(p, "atrLen"))])
_add("exit", "atrScaleOutTarget", slot="target", columns=_atr, keys=("atr",), acts=X.ScaleOut, deps=lambda p: [("atr", _length(p, "atrLen"))], optional=frozenset(TRANCHES))
_add("exit", "structuralExit", slot="trail", columns=structure, keys=("long", "short"), acts=X.Structural, deps=lambda p: [("rsi", _length(p, "rsiLen"))])
for _name in BLOCKS["sizing"]:
    _more = {"columns": _atr, "keys": ("atr",), "deps": lambda p: [("atr", _length(p, "atrLen"))]} if "atrLen" in BLOCKS["sizing"][_name] else {}
    _add("sizing", _name, acts=partial(X.Sizing, _name), needs_stop=_name == "atrRisk", **_more)
