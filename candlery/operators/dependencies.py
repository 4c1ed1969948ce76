"""What blocks need of bars, resolved together: each indicator once, and each longer timeframe rolled up and joined once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import indicators as I
from .candles import roll_up_bars
from .joins import asof_closed


def column_of(dep: tuple) -> str:
    """The column of a dependency: (kind, length) of the bars, or (minutes, kind, length, back) of a longer timeframe.

    back: the value that many of its bars before. Kind close has length 0.
    """
    if len(dep) == 2:
        return I.known_as(*dep)
    minutes, kind, n, back = dep
    return f"known_{minutes}_{kind}_{n}_{back}"


def _checked(minutes, base: int | None) -> int:
    if isinstance(minutes, bool) or not isinstance(minutes, int) or minutes <= 0 or base and (minutes % base or minutes == base):
        raise ValueError(f"unknown timeframe {minutes!r}" + (f": no whole multiple of {base} minutes" if base else ": whole minutes"))
    return minutes


def with_dependencies(bars: DataFrame, deps: Iterable[tuple], base: int | None = None) -> DataFrame:
    """bars with column_of() each dependency, those that it has already left as they are.

    A bar has the values of a longer timeframe's last bar that closed by its start. base: minutes of the bars, against
    which longer timeframes are checked.
    """
    wanted = [d for d in dict.fromkeys(deps) if column_of(d) not in bars.columns]
    longer = defaultdict(list)
    for d in wanted:
        if len(d) == 4:
            longer[_checked(d[0], base)].append(d)
    bars = I.with_recursive(bars, {column_of(d): d for d in wanted if len(d) == 2})
    for minutes, own in sorted(longer.items()):
        there = bars.select("symbol", "bar_ts", "open", "high", "low", "close", "volume")
        kinds = dict.fromkeys((kind, n) for _, kind, n, _ in own)
        slow = I.with_recursive(roll_up_bars(there, minutes), {f"_{kind}_{n}": (kind, n) for kind, n in kinds if kind != "close"})
        value = {(kind, n): F.col("close" if kind == "close" else f"_{kind}_{n}") for kind, n in kinds}
        slow = slow.select("symbol", "bar_ts", *((F.lag(value[d[1], d[2]], d[3]).over(I.series()) if d[3] else value[d[1], d[2]]).alias(column_of(d)) for d in own))
        bars = asof_closed(bars, slow, minutes, [column_of(d) for d in own])
    return bars
