"""Position sizes in units as columns; 0 where a size isn't defined. Each takes equity and fill price first."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _units(equity: Column, price: Column, share: Column) -> Column:
    return F.when((price > 0) & (equity > 0), equity * share / F.nullif(price, F.lit(0.0))).otherwise(0.0)


def flat(equity: Column, price: Column, amount: float) -> Column:
    return F.when(price > 0, F.lit(amount) / F.nullif(price, F.lit(0.0))).otherwise(0.0)


def pct_of_equity(equity: Column, price: Column, pct: float) -> Column:
    return _units(equity, price, F.lit(pct / 100))


def pct_of_initial(initial: Column, price: Column, pct: float) -> Column:
    return _units(initial, price, F.lit(pct / 100))


def atr_risk(base: Column, stop_distance: Column, pct: float) -> Column:
    """base: equity or the initial capital."""
    return F.when((stop_distance > 0) & (base > 0), base * (pct / 100) / F.nullif(stop_distance, F.lit(0.0))).otherwise(0.0)


def streak_scaled(equity: Column, price: Column, kind: Column, length: Column, on: str, base_pct: float, step: float, most: float) -> Column:
    """A step more for each trade of the streak: on "L" doubles down on losses, on "W" lets winners grow."""
    n = F.when(kind == on, length).otherwise(0)
    return _units(equity, price, F.lit(base_pct / 100) * F.least(F.pow(F.lit(step), n), F.lit(most)))


def kelly(equity: Column, price: Column, n: Column, win_rate: Column, avg_win: Column, avg_loss: Column, fraction: float, most: float, least_trades: int, warmup_pct: float) -> Column:
    b = avg_win / F.nullif(avg_loss, F.lit(0.0))
    f = (b * win_rate - (1 - win_rate)) / F.nullif(b, F.lit(0.0))
    learnt = F.when(f > 0, _units(equity, price, F.least(f * fraction, F.lit(most)))).otherwise(0.0)
    return F.when((n < least_trades) | (avg_loss <= 0), _units(equity, price, F.lit(warmup_pct / 100))).otherwise(learnt)


def fixed_fractional(equity: Column, price: Column, biggest_loss: Column, f: float, least_loss: float) -> Column:
    return F.when((price > 0) & (equity > 0), equity * f / F.greatest(biggest_loss, F.lit(least_loss))).otherwise(0.0)


def equity_curve(equity: Column, price: Column, n: Column, last: Column, mean: Column, base_pct: float, on_pct: float, off_pct: float, least_trades: int) -> Column:
    """mean: of the last equities, null while there are too few."""
    pct = F.when((n < least_trades) | mean.isNull(), base_pct).when(last > mean, on_pct).otherwise(off_pct)
    return _units(equity, price, pct / 100)


def vol_target(equity: Column, price: Column, atr: Column, target_pct: float, cap_pct: float) -> Column:
    ok = (atr > 0) & (equity > 0) & (price > 0)
    return F.when(ok, F.least(equity * (target_pct / 100) / F.nullif(atr, F.lit(0.0)), equity * (cap_pct / 100) / F.nullif(price, F.lit(0.0)))).otherwise(0.0)
