"""The account that walks a series bar by bar: fills, exits in slot order, sizes from what it has seen.

Signals and indicators come as arrays that Spark has computed; what stays here is the order of events.
"""

from __future__ import annotations

import math

SLOTS = ["hardStop", "target", "trail"]


class Position:
    """One open position with its slices: [units, limit or None, signal]."""

    def __init__(self, number: int, way: int, price: float, bar: int, units: float, risk: float | None, regime):
        self.number, self.way, self.price, self.bar, self.units, self.risk, self.regime = number, way, price, bar, units, risk, regime
        self.slices: list[list] = [[units, None, ""]]
        self.first_target: int | None = None
        self.state: dict = {}


class HardStop:
    """An emergency stop within a bar; else a close beyond the stop arms, the next bar orders, the open after fills."""

    def __init__(self, params: dict):
        self.mult, self.emergency = params["atrSL"], params["emergencySlPct"] / 100

    def plan(self, a: "Account", i: int) -> float | None:
        """The distance to the stop that a position opened at i would have."""
        atr = a.extra["hardStop_atr"][i - 1] if i else math.nan
        return atr * self.mult if atr > 0 else None

    def open(self, a: "Account", p: Position, i: int) -> None:
        p.state["atr"] = a.extra["hardStop_atr"][i - 1] if i else math.nan

    def bar(self, a: "Account", p: Position, i: int):
        atr = p.state["atr"]
        if not atr > 0:
            return None
        emergency = p.price * (1 - p.way * self.emergency)
        if (a.low[i] <= emergency) if p.way > 0 else (a.high[i] >= emergency):
            return "close", emergency - p.way * a.slippage, "ESL"
        if p.state.pop("armed", False):
            return "next", "SL"
        even = p.first_target is not None and i > p.first_target
        stop = p.price * (1 + p.way * 0.003) if even else p.price - p.way * atr * self.mult
        if (a.close[i] - stop) * p.way <= 0:
            p.state["armed"] = True
        return None


class ScaleOut:
    """Slices with limits by distance: shares normalised, the nearest first, the last takes what is left."""

    def __init__(self, params: dict):
        live = [(params.get(f"tp{k}Mult", 0), params.get(f"tp{k}Pct", 0)) for k in range(1, 7)]
        self.targets = sorted(((m, s) for m, s in live if m > 0 and s > 0), key=lambda t: t[0])

    def open(self, a: "Account", p: Position, i: int) -> None:
        atr = a.extra["target_atr"][i - 1] if i else math.nan
        if not atr > 0 or not self.targets:
            return
        total, left, p.slices = sum(s for _, s in self.targets), p.units, []
        for k, (m, s) in enumerate(self.targets):
            part = left if k == len(self.targets) - 1 else p.units * (s / total)
            left -= part
            p.slices.append([part, p.price + p.way * atr * m, f"TP{k + 1}"])

    def bar(self, a: "Account", p: Position, i: int):
        if i <= p.bar:
            return None
        hit = [s for s in p.slices if s[1] is not None and ((a.high[i] >= s[1]) if p.way > 0 else (a.low[i] <= s[1]))]
        if any(s[2] == "TP1" for s in hit):
            p.first_target = i
        return ("slices", [(s, s[1], s[2]) for s in hit]) if hit else None


class Structural:
    """Out at the next open: held long enough, an entry signal the other way, or a broken structure, in this order."""

    def __init__(self, params: dict):
        self.most = params["maxBars"]

    def open(self, a: "Account", p: Position, i: int) -> None:
        pass

    def bar(self, a: "Account", p: Position, i: int):
        if i - p.bar >= self.most - 1:
            return "next", "Time"
        if a.go[-p.way][i]:
            return "next", "Reversal"
        return ("next", "Structural") if a.extra["trail_long" if p.way > 0 else "trail_short"][i] else None


class Sizing:
    """Units by rule; the columns in operators.sizing are the same rules over a trade table."""

    def __init__(self, kind: str, params: dict):
        self.kind, self.p = kind, params

    def units(self, a: "Account", price: float, i: int, distance: float | None) -> float:
        p, e, n, kind = self.p, a.equity, len(a.curve), self.kind
        mean = lambda x: sum(x) / len(x) if x else 0.0
        if kind == "flat":
            return p["amountUsd"] / price
        if kind == "atrRisk":
            base = a.initial if p.get("useInitialCapital") else e
            return base * p["riskPct"] / 100 / distance if distance else 0
        if kind == "volTargetSizing":
            atr = a.extra["sizing_atr"][i - 1] if i else math.nan
            return min(e * p["targetVolPct"] / 100 / atr, e * p["hardCapPct"] / 100 / price) if atr > 0 else 0
        if kind == "fixedFractional":
            return e * p["f"] / max([p["minWorstLoss"], *a.losses])
        if kind == "kelly":
            if n < p["minTrades"] or not a.losses:
                return e * p["warmupPct"] / 100 / price
            b, won = mean(a.wins) / mean(a.losses), len(a.wins) / n
            f = (b * won - (1 - won)) / b if b else 0
            return e * min(f * p["fraction"], p["maxFraction"]) / price if f > 0 else 0
        if kind == "equityCurveTrading":
            known = n >= max(p["minTrades"], p["maLen"])
            pct = p["basePct"] if not known else p["onPct"] if a.curve[-1] > mean(a.curve[-int(p["maLen"]) :]) else p["offPct"]
            return e * pct / 100 / price
        if kind in ("martingale", "antiMartingale"):
            run = a.streak[1] if a.streak[0] == ("L" if kind == "martingale" else "W") else 0
            return e * p["basePct"] / 100 * min(p["stepMult"] ** run, p["maxMult"]) / price
        return (a.initial if kind == "pctOfInitial" else e) * p["pct"] / 100 / price


class Account:
    """Equity and one position at most. Orders decided on a bar's close fill at the next bar's open, with slippage.

    From bar `fitness` on trades count, and drawdown is from the equity there; before that only equity moves.
    """

    def __init__(self, bars: dict[str, list], exits: dict, sizing, settings: dict):
        self.ts, self.open, self.high, self.low, self.close = (bars[c] for c in ("bar_ts", "open", "high", "low", "close"))
        self.go, self.regime, self.extra = {1: bars["long_ok"], -1: bars["short_ok"]}, bars["regime"], bars
        self.exits, self.sizing = [exits[s] for s in SLOTS if exits.get(s)], sizing
        self.stop = exits.get("hardStop")
        self.initial, self.slippage, self.commission, self.leverage = (settings[k] for k in ("initial", "slippage", "commission", "leverage"))
        self.start, self.fitness = settings["start"], settings["fitness"]
        self.equity, self.position, self.opened = self.initial, None, 0
        self.trades, self.wins, self.losses, self.streak, self.curve, self.counted = [], [], [], ("", 0), [], []
        self.base, self.positions, self.peak, self.fall, self.fall_pct, self.marks = None, 0, self.initial, 0.0, 0.0, []

    def run(self) -> "Account":
        leaving, entering, last = None, 0, len(self.ts) - 1
        for i in range(self.start, last + 1):
            if self.base is None and i >= self.fitness:
                self.base = self.peak = self.equity
                self.fall = self.fall_pct = 0.0
            if leaving and self.position:
                self.close_all(i, self.open[i] - self.position.way * self.slippage, leaving)
            leaving = None
            if entering and self.position is None and self.equity > 0:
                self.enter(i, entering)
            entering = 0
            if self.position:
                leaving = self.ask_exits(i)
            p = self.position
            if (p is None or leaving) and self.equity > 0:
                way = 1 if self.go[1][i] else -1 if self.go[-1][i] else 0
                if way and (p is None or way == -p.way):
                    entering = way
            self.mark(i)
        if self.position:
            self.close_all(last, self.close[last], "End")
        return self

    def enter(self, i: int, way: int) -> None:
        price = self.open[i] + way * self.slippage
        if not price > 0:
            return
        distance = self.stop.plan(self, i) if hasattr(self.stop, "plan") else None
        units = min(self.sizing.units(self, price, i, distance), self.equity * self.leverage / price)
        if units > 0:
            self.position = p = Position(self.opened, way, price, i, units, None if distance is None else units * distance, self.regime[i])
            self.opened += 1
            self.positions += i >= self.fitness
            for x in sorted(self.exits, key=lambda x: not isinstance(x, ScaleOut)):  # targets split the position first
                x.open(self, p, i)

    def ask_exits(self, i: int) -> str | None:
        """Closes what a price of this bar closes; returns the signal of an order for the next open."""
        for x in self.exits:
            does = x.bar(self, self.position, i)
            if does is None:
                continue
            if does[0] == "next":
                return does[1]
            if does[0] == "close":
                self.close_all(i, does[1], does[2])
                return None
            for part, price, signal in does[1]:
                self.close_slice(i, part, price, signal)
            if not self.position.slices:
                self.position = None
                return None
        return None

    def close_all(self, i: int, price: float, signal: str) -> None:
        for part in list(self.position.slices):
            self.close_slice(i, part, price, signal)
        self.position = None

    def close_slice(self, i: int, part: list, price: float, signal: str) -> None:
        p, units = self.position, part[0]
        pnl = units * (price - p.price) * p.way - units * p.price * self.commission - units * price * self.commission
        self.equity = max(0.0, self.equity + pnl)
        p.slices.remove(part)
        if pnl:
            (self.wins if pnl > 0 else self.losses).append(abs(pnl))
            kind = "W" if pnl > 0 else "L"
            self.streak = (kind, self.streak[1] + 1 if self.streak[0] == kind else 1)
        self.curve.append(self.equity)
        risk = None if p.risk is None else p.risk * units / p.units
        self.trades.append((p.number, "Long" if p.way > 0 else "Short", self.ts[p.bar], self.ts[i], signal, p.price, price, units, risk, pnl, self.equity, p.regime))
        if i >= self.fitness:
            self.counted.append((pnl, p.regime))
        self.down(self.equity)

    def down(self, worth: float) -> None:
        self.peak = max(self.peak, worth)
        self.fall = max(self.fall, self.peak - worth)
        if self.peak > 0:
            self.fall_pct = max(self.fall_pct, (self.peak - worth) / self.peak)

    def mark(self, i: int) -> None:
        """Equity with the open position at this bar's close."""
        p = self.position
        worth = self.equity + (sum(s[0] for s in p.slices) * (self.close[i] - p.price) * p.way if p else 0.0)
        self.down(worth)
        self.marks.append((self.ts[i], worth))

    def summary(self, years: float = 0.0) -> tuple:
        """Of the fitness region: trades, positions, wins, pf (null: no loss but profit), net, net_pct, annual_return, max_dd, max_dd_pct, sharpe, equity, regimes."""
        pnls = [x for x, _ in self.counted]
        won, lost, base = sum(x for x in pnls if x > 0), -sum(x for x in pnls if x <= 0), self.initial if self.base is None else self.base
        net = (self.equity - base) / base if base > 0 else 0.0
        share, sharpe = [x / self.initial for x in pnls], 0.0
        if len(share) > 1:
            mean = sum(share) / len(share)
            spread = math.sqrt(sum((x - mean) ** 2 for x in share) / (len(share) - 1))
            sharpe = mean / spread * math.sqrt(len(share)) if spread > 0 else 0.0
        regimes: dict = {}
        for x, label in self.counted:
            r = regimes.setdefault(label or "_unknown", [0, 0, 0.0, 0.0])
            r[0], r[1], r[2], r[3] = r[0] + 1, r[1] + (x > 0), r[2] + max(x, 0.0), r[3] + max(-x, 0.0)
        annual = (1 + net) ** (1 / years) - 1 if years > 0 and net > -1 else net
        pf = won / lost if lost > 0 else None if won > 0 else 0.0
        rows = [{"regime": k, "trades": r[0], "wins": r[1], "gross_profit": r[2], "gross_loss": r[3]} for k, r in sorted(regimes.items())]
        return len(pnls), self.positions, sum(x > 0 for x in pnls), pf, self.equity - base, net, annual, self.fall, self.fall_pct, sharpe, self.equity, rows
