"""Entry, filter and regime rules as pairs of boolean columns, and how votes become a direction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import indicators as I
from .candles import indexed
from .dependencies import column_of, with_dependencies

C, H, L, O, V = (lambda x=x: F.col(x) for x in ("close", "high", "low", "open", "volume"))  # columns need a session, so made when called


def no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def put(bars: DataFrame, name: str, long: Column, short: Column) -> DataFrame:
    """Adds {name}_long and {name}_short, false where not known."""
    return bars.withColumns({f"{name}_long": no(long), f"{name}_short": no(short)})


def stoch_cross(bars: DataFrame, length=14, smooth=3, long_level=30, short_level=70, name="stoch") -> DataFrame:
    bars = bars.withColumn("_s", I.stoch(C(), H(), L(), length))
    bars = bars.withColumn("_k", I.sma(F.col("_s"), smooth)).withColumn("_d", I.sma(F.col("_k"), smooth))
    k, d = F.col("_k"), F.col("_d")
    return put(bars, name, I.cross_over(k, d) & (k < long_level), I.cross_under(k, d) & (k > short_level)).drop("_s", "_k", "_d")


def trend_sides(f: Column, w: Column) -> tuple[Column, Column]:
    return f > w, f < w


def ema_trend(bars: DataFrame, fast=10, slow=30, name="trend") -> DataFrame:
    bars = I.with_recursive(bars, {"_f": ("ema", fast), "_w": ("ema", slow)})
    return put(bars, name, *trend_sides(F.col("_f"), F.col("_w"))).drop("_f", "_w")


def squeeze_breakout(bars: DataFrame, length=20, mult=2.0, pct=25, lookback=5, window=100, name="squeeze") -> DataFrame:
    bars = indexed(bars).withColumns({"_b": I.sma(C(), length), "_sd": I.stdev(C(), length)})
    bars = bars.withColumn("_w", F.when(F.col("_b") > 0, 2 * mult * F.col("_sd") / F.col("_b") * 100))
    bars = bars.withColumn("_r", I.rank_with_current(F.col("_w"), window, F.col("i")))
    bars = bars.withColumn("_q", I.any_recent(F.col("_r") < pct, lookback))
    return put(bars, name, F.col("_q") & (C() > F.col("_b")), F.col("_q") & (C() < F.col("_b"))).drop("_b", "_sd", "_w", "_r", "_q", "i")


def rsi_sides(r: Column, long_level: float, short_level: float) -> tuple[Column, Column]:
    before = F.lag(r).over(I.series())
    return (before <= long_level) & (r > long_level), (before >= short_level) & (r < short_level)


def rsi_pullback(bars: DataFrame, length=14, long_level=40, short_level=60, name="rsi") -> DataFrame:
    bars = I.with_recursive(bars, {"_r": ("rsi", length)})
    return put(bars, name, *rsi_sides(F.col("_r"), long_level, short_level)).drop("_r")


def pullback_sides(f: Column, w: Column) -> tuple[Column, Column]:
    return (f > w) & (L() <= f) & (C() > f), (f < w) & (H() >= f) & (C() < f)


def ma_pullback(bars: DataFrame, fast=10, slow=30, name="pullback") -> DataFrame:
    bars = I.with_recursive(bars, {"_f": ("ema", fast), "_w": ("ema", slow)})
    return put(bars, name, *pullback_sides(F.col("_f"), F.col("_w"))).drop("_f", "_w")


def donchian_sides(length: int) -> tuple[Column, Column]:
    w = I.series().rowsBetween(-length, -1)
    full = F.count(F.lit(1)).over(w) == length
    return full & (C() > F.max(H()).over(w)), full & (C() < F.min(L()).over(w))


def donchian(bars: DataFrame, length=20, name="donchian") -> DataFrame:
    return put(bars, name, *donchian_sides(length))


def surge_sides(length: int, mult: float) -> tuple[Column, Column]:
    big = V() >= mult * I.sma(V(), length)
    return big & (C() > O()), big & (C() < O())


def volume_surge(bars: DataFrame, length=20, mult=1.5, name="surge") -> DataFrame:
    return put(bars, name, *surge_sides(length, mult))


def _with(bars: DataFrame, deps: list[tuple]) -> tuple[DataFrame, list[str]]:
    """bars with dependencies, and the columns that it did not have before."""
    return with_dependencies(bars, deps), [c for c in map(column_of, deps) if c not in bars.columns]


def htf_deps(minutes: int, length: int, back: int = 0) -> list[tuple]:
    """Close and average of a longer timeframe, or the average now and `back` of its bars before."""
    now = (minutes, "ema", length, 0)
    return [now, (minutes, "ema", length, back)] if back else [(minutes, "close", 0, 0), now]


def htf_sides(minutes: int, length: int) -> tuple[Column, Column]:
    close, ma = (F.col(column_of(d)) for d in htf_deps(minutes, length))
    return ma.isNull() | (close > ma), ma.isNull() | (close < ma)


def htf_trend_filter(bars: DataFrame, minutes=240, length=10, name="htf") -> DataFrame:
    """Both sides pass while the longer timeframe has no bar or no average yet."""
    out, new = _with(bars, htf_deps(minutes, length))
    return put(out, name, *htf_sides(minutes, length)).drop(*new)


def floor_sides(atr: Column, least: float) -> tuple[Column, Column]:
    ok = atr / F.nullif(C(), F.lit(0.0)) * 100 >= least
    return ok, ok


def volatility_floor(bars: DataFrame, length=14, least=0.5, name="floor") -> DataFrame:
    bars = I.with_recursive(bars, {"_a": ("atr", length)})
    return put(bars, name, *floor_sides(F.col("_a"), least)).drop("_a")


def volume_filter(bars: DataFrame, length=20, least=0.8, name="volume") -> DataFrame:
    bars = bars.withColumn("_m", I.sma(V(), length))
    ok = (F.col("_m") > 0) & (V() >= least * F.col("_m"))
    return put(bars, name, ok, ok).drop("_m")


def regime_gate(bars: DataFrame, allowed_long="*", allowed_short="*", label="regime", name="gate") -> DataFrame:
    """Sides pass where their list (comma-separated; empty or * for all) holds the label; an unknown label fails a list."""

    def side(allowed: str) -> Column:
        names = [x.strip() for x in allowed.split(",") if x.strip()]
        return F.lit(True) if not names or "*" in names else F.col(label).isin(names)

    return put(bars, name, side(allowed_long), side(allowed_short))


def htf_trend_regime(bars: DataFrame, minutes=240, length=10, back=3, threshold=0.01, name="regime") -> DataFrame:
    deps = htf_deps(minutes, length, back)
    out, new = _with(bars, deps)
    now, past = (F.col(column_of(d)) for d in deps)
    s = (now - past) / F.nullif(now, F.lit(0.0))
    return out.withColumn(name, F.when(s > threshold, "bull").when(s < -threshold, "bear").when(s.isNotNull(), "chop")).drop(*new)


def vol_regime(bars: DataFrame, length=14, rank=50, high=70, low=30, name="regime") -> DataFrame:
    bars = indexed(I.with_recursive(bars, {"_a": ("atr", length)}))
    r = I.rank_null_tolerant(F.col("_a"), rank, F.col("i"))
    return bars.withColumn("_r", r).withColumn(name, F.when(F.col("_r") > high, "high").when(F.col("_r") < low, "low").when(F.col("_r").isNotNull(), "normal")).drop("_a", "_r", "i")


def range_regime(bars: DataFrame, length=14, threshold=25, name="regime") -> DataFrame:
    bars = I.with_recursive(bars, {"_x": ("adx", length)})
    return bars.withColumn(name, F.when(F.col("_x") > threshold, "trending").when(F.col("_x").isNotNull(), "ranging")).drop("_x")


def votes(names: list[str], side: str) -> Column:
    return reduce(lambda a, b: a + b, (F.col(f"{n}_{side}").cast("int") for n in names))


def entry_ok(names: list[str], side: str, mode="score", threshold=1) -> Column:
    """score: enough votes; all: every one, of at least one; any: one at least."""
    if not names:
        return F.lit(False)
    n = votes(names, side)
    return {"score": n >= threshold, "all": n == len(names), "any": n > 0}[mode]


def filter_ok(names: list[str], side: str, mode="all", threshold=1) -> Column:
    """Without filters everything passes."""
    return entry_ok(names, side, mode, threshold) if names else F.lit(True)


def direction(entries: list[str], filters: list[str], mode="score", threshold=1, filter_mode="all") -> Column:
    """1 long, -1 short, 0 none; long wins where both pass."""
    ok = {s: entry_ok(entries, s, mode, threshold) & filter_ok(filters, s, filter_mode) for s in ("long", "short")}
    return F.when(ok["long"], 1).when(ok["short"], -1).otherwise(0)
