"""Blocks as a table function of SQL: rules that read a symbol's bars in order and remember only what they need.

    register(spark)
    spark.sql("select * from block(table(bars), 'donchianBreakout', '{\\"period\\": 20}')")

The function deals its table out by symbol and sorts it by bar_ts itself; the columns it returns depend on the block.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NEEDED = ["symbol", "bar_ts", "open", "high", "low", "close", "volume"]


class Last:
    """The last n values, null ones too."""

    def __init__(self, n: int):
        self.n, self.values = n, deque(maxlen=n)

    def push(self, x):
        self.values.append(x)
        return self

    def known(self) -> list:
        """The values if there are n and none is null, else nothing."""
        return list(self.values) if len(self.values) == self.n and None not in self.values else []


def mean(values: list) -> float | None:
    return sum(values) / len(values) if values else None


class Average(Last):
    def step(self, x):
        return mean(self.push(x).known())


class Ema:
    """Seeded by the mean of the first n values."""

    def __init__(self, n: int):
        self.k, self.first, self.value = 2 / (n + 1), Last(n), None

    def step(self, x):
        if x is not None:
            self.value = mean(self.first.push(x).known()) if self.value is None else x * self.k + self.value * (1 - self.k)
        return self.value


class Wilder:
    def __init__(self, n: int):
        self.n, self.first, self.value = n, Last(n), None

    def step(self, x):
        self.value = mean(self.first.push(x).known()) if self.value is None else (self.value * (self.n - 1) + x) / self.n
        return self.value


class Rsi:
    def __init__(self, n: int):
        self.up, self.down, self.before = Wilder(n), Wilder(n), None

    def step(self, close):
        before, self.before = self.before, close
        if before is None:
            return None
        up, down = self.up.step(max(close - before, 0.0)), self.down.step(max(before - close, 0.0))
        return None if up is None else 100.0 if down == 0 else 100 - 100 / (1 + up / down)


class Adx:
    """Wilder's sums of the moves and the range, seeded by bars 1 to n, and the mean of the index that they give."""

    def __init__(self, n: int):
        self.n, self.i, self.before, self.sums, self.seeds, self.value = n, -1, None, [0.0, 0.0, 0.0], [], None

    def step(self, bar):
        before, self.before, n = self.before, bar, self.n
        self.i += 1
        if before is None:
            return None
        rise, fall = bar.high - before.high, before.low - bar.low
        span = max(bar.high - bar.low, abs(bar.high - before.close), abs(bar.low - before.close))
        moves = rise if rise > fall and rise > 0 else 0.0, fall if fall > rise and fall > 0 else 0.0, span
        self.sums = [s + m if self.i <= n else s - s / n + m for s, m in zip(self.sums, moves)]
        if self.i < n:
            return None
        plus, minus = (100 * s / self.sums[2] if self.sums[2] else 0.0 for s in self.sums[:2])
        dx = 100 * abs(plus - minus) / (plus + minus) if plus + minus else None
        if self.i < 2 * n:
            self.seeds.append(dx)
            if self.i == 2 * n - 1:
                self.value = mean([x for x in self.seeds if x is not None])
        elif dx is not None and self.value is not None:
            self.value = (self.value * (n - 1) + dx) / n
        return self.value


class Stoch:
    def __init__(self, n: int):
        self.high, self.low = Last(n), Last(n)

    def step(self, bar):
        high, low = self.high.push(bar.high).known(), self.low.push(bar.low).known()
        if not high:
            return None
        top, bottom = max(high), min(low)
        return 50.0 if top == bottom else (bar.close - bottom) / (top - bottom) * 100


def above(a, b) -> bool:
    return a is not None and b is not None and a > b


def ema_trend(p):
    fast, slow = Ema(p["emaFast"]), Ema(p["emaSlow"])
    while True:
        bar = yield
        f, w = fast.step(bar.close), slow.step(bar.close)
        yield above(f, w), above(w, f)


def ma_pullback(p):
    fast, slow = Ema(p["emaFast"]), Ema(p["emaSlow"])
    while True:
        bar = yield
        f, w = fast.step(bar.close), slow.step(bar.close)
        yield above(f, w) and bar.low <= f < bar.close, above(w, f) and bar.high >= f > bar.close


def rsi_pullback(p):
    rsi, before = Rsi(p["rsiLen"]), None
    while True:
        bar = yield
        r = rsi.step(bar.close)
        known = before is not None
        yield known and before <= p["longLevel"] < r, known and before >= p["shortLevel"] > r
        before = r


def donchian(p):
    high, low = Last(p["period"]), Last(p["period"])
    while True:
        bar = yield
        top, bottom = high.known(), low.known()
        yield bool(top) and bar.close > max(top), bool(bottom) and bar.close < min(bottom)
        high.push(bar.high)
        low.push(bar.low)


def volume_surge(p):
    average = Average(p["volLen"])
    while True:
        bar = yield
        m = average.step(bar.volume)
        big = m is not None and bar.volume >= p["multiplier"] * m
        yield big and bar.close > bar.open, big and bar.close < bar.open


def volume_filter(p):
    average = Average(p["volLen"])
    while True:
        bar = yield
        m = average.step(bar.volume)
        ok = m is not None and m > 0 and bar.volume >= p["minMultiplier"] * m
        yield ok, ok


def stoch_cross(p):
    stoch, smooth, signal, before = Stoch(p["stochLen"]), Average(p["stochSmth"]), Average(p["stochSmth"]), (None, None)
    while True:
        bar = yield
        k = smooth.step(stoch.step(bar))
        d = signal.step(k)
        known = None not in (*before, k, d)
        yield known and k > d and before[0] <= before[1] and k < p["longLevel"], known and k < d and before[0] >= before[1] and k > p["shortLevel"]
        before = k, d


def range_regime(p):
    adx = Adx(p["adxLen"])
    while True:
        bar = yield
        x = adx.step(bar)
        yield (None if x is None else "trending" if x > p["adxThreshold"] else "ranging",)


#: Blocks by id, as generators that take a bar and give a row; what they give by kind.
RULES = {"emaTrend": ema_trend, "maPullback": ma_pullback, "rsiPullback": rsi_pullback, "donchianBreakout": donchian, "volumeSurge": volume_surge, "volumeFilter": volume_filter, "stochCross": stoch_cross}
REGIMES = {"rangeRegime": range_regime}


def _params(name: str, text: str) -> dict:
    """A block's parameters from JSON, all of them and within their bounds."""
    from .library import REGISTRY

    known = REGISTRY.get(name).params
    given = json.loads(text)
    if not isinstance(given, dict) or set(given) != set(known):
        raise ValueError(f"{name} needs the parameters {', '.join(sorted(known))}")
    out = {}
    for key, (kind, least, most, _) in known.items():
        value = given[key]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not least <= value <= most or kind == "int" and value != int(value):
            raise ValueError(f"{name}: {key} has to be {'a whole number' if kind == 'int' else 'a number'} from {least} to {most}")
        out[key] = int(value) if kind == "int" else float(value)
    return out


class BlockFunction:
    """block(table, name, params): symbol, bar_ts and the block's columns, a row for each bar."""

    @staticmethod
    def analyze(bars: AnalyzeArgument, name: AnalyzeArgument, params: AnalyzeArgument) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError("block: the first argument has to be a table")
        missing = [c for c in NEEDED if c not in bars.dataType.fieldNames()]
        if missing:
            raise ValueError(f"block: the table lacks {', '.join(missing)}")
        if not (name.isConstantExpression and params.isConstantExpression) or name.value not in RULES | REGIMES:
            raise ValueError(f"block: the name has to be one of {', '.join([*RULES, *REGIMES])}")
        _params(name.value, params.value)
        schema = StructType().add("symbol", StringType()).add("bar_ts", LongType())
        schema = schema.add("regime", StringType()) if name.value in REGIMES else schema.add("long", BooleanType()).add("short", BooleanType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("bar_ts")])

    def __init__(self):
        self.rule = None

    def eval(self, bar, name: str, params: str) -> Iterator[tuple]:
        if self.rule is None:
            self.rule = (RULES | REGIMES)[name](_params(name, params))
        if None in (bar["open"], bar["high"], bar["low"], bar["close"]):  # not a bar: nothing is known of it, and the rule passes it over
            yield (bar["symbol"], bar["bar_ts"], *((None,) if name in REGIMES else (False, False)))
            return
        next(self.rule)
        yield (bar["symbol"], bar["bar_ts"], *self.rule.send(bar))


def register(spark: SparkSession, name: str = "block") -> None:
    """Makes the function known to SQL; rows come and go as Arrow batches."""
    spark.udtf.register(name, udtf(BlockFunction, useArrow=True))
