"""Indicators as window expressions over (symbol, bar_ts), and the recursive ones as linear steps over stretches of bars.

A value is null until its window is full. A series is bounded by its time span over its timeframe (five years of minutes
are 2.6 million rows) however many ticks there are, so a task can sort a symbol's bars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def series() -> W:
    return W.partitionBy("symbol").orderBy("bar_ts")


def rows(n: int, last: int = 0) -> W:
    return series().rowsBetween(-(n - 1), last)


def _full(x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(rows(n)) == n, value)


def sma(x: Column, n: int) -> Column:
    return _full(x, n, F.avg(x).over(rows(n)))


def stdev(x: Column, n: int) -> Column:
    return _full(x, n, F.stddev_pop(x).over(rows(n)))


def highest(x: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(rows(n)) == n, F.max(x).over(rows(n)))


def lowest(x: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(rows(n)) == n, F.min(x).over(rows(n)))


def stoch(c: Column, h: Column, l: Column, n: int) -> Column:  # noqa: E741
    top, low = highest(h, n), lowest(l, n)
    return F.when(top == low, F.lit(50.0)).otherwise((c - low) / F.nullif(top - low, F.lit(0.0)) * 100)


def true_range(h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    before = F.lag(c).over(series())
    return F.when(before.isNull(), h - l).otherwise(F.greatest(h - l, F.abs(h - before), F.abs(l - before)))


def percent_rank(x: Column, n: int) -> Column:
    """Share in percent of the n values before that are less."""
    w = series().rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) == n, F.size(F.filter(F.collect_list(x).over(w), lambda v: v < x)) / F.lit(float(n)) * 100)


def rank_with_current(x: Column, n: int, index: Column) -> Column:
    """Share in percent of the last n values (this one too, nulls left out) that are less; from index n on."""
    values = F.collect_list(x).over(rows(n))
    return F.when((index >= n) & x.isNotNull(), F.size(F.filter(values, lambda v: v < x)) / F.nullif(F.size(values), F.lit(0)).cast("double") * 100)


def rank_null_tolerant(x: Column, n: int, index: Column) -> Column:
    """As percent_rank, with nulls counted as not less and n always the divisor."""
    w = series().rowsBetween(-n, -1)
    return F.when((index >= n) & x.isNotNull(), F.size(F.filter(F.collect_list(x).over(w), lambda v: v < x)) / F.lit(float(n)) * 100)


def cross_over(a: Column, b: Column) -> Column:
    w = series()
    return F.coalesce((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


def cross_under(a: Column, b: Column) -> Column:
    w = series()
    return F.coalesce((a < b) & (F.lag(a).over(w) >= F.lag(b).over(w)), F.lit(False))


def vwap(h: Column, l: Column, c: Column, v: Column, n: int) -> Column:  # noqa: E741
    price, total = (h + l + c) / 3, F.sum(v).over(rows(n))
    return F.when((F.count(v).over(rows(n)) == n) & (total > 0), F.sum(price * v).over(rows(n)) / F.nullif(total, F.lit(0.0)))


def any_recent(flag: Column, k: int) -> Column:
    return F.max(F.coalesce(flag, F.lit(False))).over(rows(k))


#: Bars of a stretch at most, and the power of ten that weights within one may reach.
STRETCH, WEIGHTS = 4096, 120


def recur(bars: DataFrame, wanted: dict[str, tuple[float, Column]]) -> DataFrame:
    """bars (with _i, their number by symbol) and columns {name: (keep, add)}: keep * the value before + add.

    A bar without an add holds the value; before the first add it is null. Steps of a stretch of bars are one linear
    step: within a stretch values come from a running sum of weighted adds, and only what each stretch hands on is
    carried from one to the next, so no task goes through a series bar by bar.
    """
    least = min((keep for keep, _ in wanted.values() if keep > 0), default=1.0)
    length = STRETCH if least == 1 else max(1, min(STRETCH, int(WEIGHTS * math.log(10) / -math.log(least))))
    c, chained = F.col, {name: (k, keep) for k, (name, (keep, _)) in enumerate(wanted.items()) if keep > 0}
    bars = bars.withColumns({"_st": F.floor(c("_i") / length).cast("int")} | {f"_x{k}": add for k, (_, add) in enumerate(wanted.values())})
    within = W.partitionBy("symbol", "_st").orderBy("bar_ts").rowsBetween(W.unboundedPreceding, 0)
    if chained:
        bars = bars.withColumns({f"_e{k}": F.count(c(f"_x{k}")).over(within) for k, _ in chained.values()})
        bars = bars.withColumns({f"_s{k}": F.coalesce(F.sum(c(f"_x{k}") * F.pow(F.lit(keep), -c(f"_e{k}"))).over(within), F.lit(0.0)) for k, keep in chained.values()})
        ends = bars.groupBy("symbol", "_st").agg(*(F.max(f"_e{k}").alias(f"_e{k}") for k, _ in chained.values()), *(F.max_by(f"_s{k}", "bar_ts").alias(f"_s{k}") for k, _ in chained.values()))
        steps = (x for k, keep in chained.values() for x in (c(f"_e{k}").alias(f"n{k}"), F.pow(F.lit(keep), c(f"_e{k}")).alias(f"a{k}"), (F.pow(F.lit(keep), c(f"_e{k}")) * c(f"_s{k}")).alias(f"b{k}")))
        # Some thousand stretches a symbol at most: what each begins with.
        steps = ends.groupBy(c("symbol").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_st", *steps))).alias("steps"))
        begin = "aggregate(steps, array(cast(null as double)), (v, x) -> concat(v, array(if(x.n{0} > 0, coalesce(element_at(v, -1), 0D) * x.a{0} + x.b{0}, element_at(v, -1))))) as _c{0}"
        bars = bars.join(steps.selectExpr("_of", *(begin.format(k) for k, _ in chained.values())), c("symbol").eqNullSafe(c("_of")), "left")
    out = {}
    for k, (name, (keep, _)) in enumerate(wanted.items()):
        before = F.element_at(f"_c{k}", c("_st") + 1) if keep > 0 else None
        last = F.last(f"_x{k}", ignorenulls=True).over(series().rowsBetween(W.unboundedPreceding, 0))
        out[name] = last if keep == 0 else F.when((c(f"_e{k}") > 0) | before.isNotNull(), F.pow(F.lit(keep), c(f"_e{k}")) * (F.coalesce(before, F.lit(0.0)) + c(f"_s{k}")))
    return bars.withColumns(out).drop("_st", "_of", *(f"{p}{k}" for p in ("_x", "_e", "_s", "_c") for k in range(len(wanted))))


def _mean(x: Column, n: int, first: int) -> tuple[float, Column]:
    """Wilder's mean, seeded at bar `first` by the n values up to it."""
    return (n - 1) / n, F.when(F.col("_i") == first, F.avg(x).over(rows(n))).when(F.col("_i") > first, x / n)


def _ema(n: int) -> dict:
    """Seeded by the mean of the first n values that aren't missing."""
    k, known = 2 / (n + 1), F.count(F.col("close")).over(series().rowsBetween(W.unboundedPreceding, 0))
    return {"": (1 - k if n > 1 else 0.0, F.when(known == n, F.avg("close").over(rows(n))).when(known > n, F.col("close") * k))}


def _rsi(n: int) -> dict:
    change = F.col("close") - F.lag("close").over(series())
    return {"_up": _mean(F.when(change > 0, change).otherwise(0.0), n, n), "_down": _mean(F.when(change < 0, -change).otherwise(0.0), n, n)}


def _atr(n: int) -> dict:
    return {"": _mean(true_range(F.col("high"), F.col("low"), F.col("close")), n, n - 1)}


def _adx(n: int) -> dict:
    """Sums of the moves and of the range, seeded by those of bars 1 to n."""
    rise, fall = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    moves = {"_plus": F.when((rise > fall) & (rise > 0), rise).otherwise(0.0), "_minus": F.when((fall > rise) & (fall > 0), fall).otherwise(0.0), "_span": true_range(F.col("high"), F.col("low"), F.col("close"))}
    return {name: ((n - 1) / n, F.when(F.col("_i") == n, F.sum(x).over(rows(n))).when(F.col("_i") > n, x)) for name, x in moves.items()}


#: Recursive indicators by name: what they carry from bar to bar, for a length.
RECURSIVE = {"ema": _ema, "rsi": _rsi, "atr": _atr, "adx": _adx}


def _strength(bars: DataFrame, columns: dict[str, int]) -> DataFrame:
    """ADX from the sums beside it: Wilder's mean of the directional index, held where that is not known."""
    index, seed = {}, {}
    for name, n in columns.items():
        plus, minus = (100 * F.col(name + x) / F.nullif(F.col(name + "_span"), F.lit(0.0)) for x in ("_plus", "_minus"))
        index[name + "_dx"] = 100 * F.abs(plus - minus) / F.nullif(plus + minus, F.lit(0.0))
    bars = bars.withColumns(index)
    for name, n in columns.items():
        seed[name + "_seed"] = F.when(F.col("_i") == 2 * n - 1, F.avg(name + "_dx").over(rows(n)))
    bars = bars.withColumns(seed)
    add = {}
    for name, n in columns.items():
        seeded = F.max(name + "_seed").over(series().rowsBetween(W.unboundedPreceding, 0)).isNotNull()
        add[name] = (n - 1) / n, F.when(F.col("_i") == 2 * n - 1, F.col(name + "_seed")).when((F.col("_i") >= 2 * n) & seeded, F.col(name + "_dx") / n)
    return recur(bars, add).drop(*index, *seed)


def known_as(kind: str, n: int) -> str:
    """The column under which a recursive indicator that several rules need is kept."""
    return f"known_{kind}_{n}"


def with_recursive(bars: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """bars with columns {name: (indicator, length)}: all side by side, each distinct (indicator, length) once.

    Those that bars has already under known_as() are taken from there.
    """
    there = {name: known_as(*key) for name, key in wanted.items() if known_as(*key) in bars.columns}
    bars = bars.withColumns({name: F.col(column) for name, column in there.items() if name != column}) if there else bars
    wanted = {name: key for name, key in wanted.items() if name not in there}
    distinct = list(dict.fromkeys(wanted.values()))
    for kind, _ in distinct:
        if kind not in RECURSIVE:
            raise ValueError(f"unknown indicator {kind!r}; known: {', '.join(RECURSIVE)}")
    if not wanted:
        return bars

    held = {key: f"_h{k}" for k, key in enumerate(distinct)}
    parts = {held[key] + part: step for key in distinct for part, step in RECURSIVE[key[0]](key[1]).items()}
    out = bars.withColumn("_i", F.row_number().over(series()) - 1)
    out = recur(out, parts)
    strong = {held[key]: key[1] for key in distinct if key[0] == "adx"}
    if strong:
        out = _strength(out, strong)
    values = {}
    for (kind, n), name in held.items():
        up, down = F.col(name + "_up"), F.col(name + "_down")
        values[kind, n] = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))) if kind == "rsi" else F.col(name)
    return out.withColumns({name: values[key] for name, key in wanted.items()}).drop("_i", *parts, *held.values())
