"""Scalar rules as columns: grids, normalisations, labels, keys, hashes."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, functions as F

#: Fixed: names of timeframes in minutes.
TIMEFRAMES = {"hourly": 60, "4h": 240, "daily": 1440, "weekly": 10080, "monthly": 43200}
PERIODS = {"3M": 0.25, "6M": 0.5, "1y": 1.0, "2y": 2.0, "3y": 3.0, "4y": 4.0, "5y": 5.0}


def floor_div(x: Column, step: int) -> Column:
    return F.floor(x / step) * step


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def snap(x: Column, low: Column, high: Column, step: Column) -> Column:
    """x on the grid low, low + step, ... within the bounds."""
    return clamp(low + half_up((x - low) / step) * step, low, high)


def places(step: float) -> int:
    return max(0, math.ceil(-math.log10(step))) if step < 1 else 0


def aligned(x: Column, step: Column) -> Column:
    r = x / step
    return F.abs(r - half_up(r)) < 1e-9


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def number_or(x: Column, other: Column) -> Column:
    return F.when(finite(x), x).otherwise(other)


def normal_pf(pf: Column, cap: float) -> Column:
    return F.when(pf.isNull() | F.isnan(pf) | (pf <= 0), 0.0).otherwise(F.least(pf / cap, F.lit(1.0)))


def normal_dd(dd: Column) -> Column:
    return F.when(~finite(dd), 1.0).otherwise(clamp(1 - dd, F.lit(0.0), F.lit(1.0)))


def normal_return(r: Column, cap: float) -> Column:
    return F.when(~finite(r) | (r <= 0), 0.0).otherwise(F.least(r / cap, F.lit(1.0)))


def normal_weights(*weights: Column) -> list[Column]:
    """Weights over their sum, negative ones as 0; equal parts if nothing is left."""
    good = [F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)) for w in weights]
    total = sum(good[1:], good[0])
    return [F.when(total > 0, g / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0 / len(good))) for g in good]


def timeframe_minutes(x: Column) -> Column:
    known = F.coalesce(*(F.when(F.lower(x) == k, F.lit(v)) for k, v in TIMEFRAMES.items()))
    return F.coalesce(known, F.when(x.rlike(r"^[0-9]{1,9}$"), x.try_cast("int")))


#: Fixed: names of the intervals that have one.
LABELS = {1: "1m", 5: "5m", 15: "15m", 30: "30m", 60: "1H", 120: "2H", 240: "4H", 360: "6H", 720: "12H", 1440: "1D"}


def interval_label(minutes: Column) -> Column:
    return F.coalesce(*(F.when(minutes == k, F.lit(v)) for k, v in LABELS.items()), F.concat(minutes.cast("string"), F.lit("m")))


def hours_label(minutes: Column) -> Column:
    hours = F.regexp_replace((minutes / 60).cast("string"), r"\.0$", "")
    return F.when(minutes >= 60, F.concat(hours, F.lit("H"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def period_years(x: Column) -> Column:
    return F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in PERIODS.items()))


def duration(seconds: Column) -> Column:
    """The parts that aren't 0 of days, hours, minutes and seconds; 0s if none."""
    units = (("d", 86400, None), ("h", 3600, 24), ("m", 60, 60), ("s", 1, 60))
    amount = lambda n, m: F.floor(seconds / n) if m is None else F.floor(seconds / n) % m
    text = F.concat_ws(" ", *(F.when(amount(n, m) > 0, F.concat(amount(n, m).cast("string"), F.lit(u))) for u, n, m in units))
    return F.when(text == "", "0s").otherwise(text)


def dataset_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 32)


def canonical_json(value) -> str:
    """Sorted keys, no white space, whole numbers without a fraction."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def gene_key(*values: Column) -> Column:
    return F.concat_ws(",", *(v.cast("string") for v in values))


def dedup_key(bar: Column, action: Column, direction: Column) -> Column:
    return F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in (bar, action, direction)))


def name_set(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda s: s != "")


def allows(names: Column, label: Column) -> Column:
    return (F.size(names) == 0) | F.array_contains(names, "*") | F.coalesce(F.array_contains(names, label), F.lit(False))


def redacted(secret: Column) -> Column:
    return F.concat(F.substring(secret, 1, 4), F.lit("…"))


def shortened(text: Column, n: int = 280) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)
