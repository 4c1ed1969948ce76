"""Recursive indicators against plain loops, over series of many stretches and awkward values."""

import math
import random

import pytest

from candlery.operators import indicators as I


def ema(x, n):
    first = next((i for i, v in enumerate(x) if v is not None), len(x)) + n - 1
    out, k = [None] * len(x), 2 / (n + 1)
    if first < len(x):
        out[first] = sum(x[first - n + 1 : first + 1]) / n
        for i in range(first + 1, len(x)):
            out[i] = x[i] * k + out[i - 1] * (1 - k)
    return out


def wilder(x, n, first):
    out = [None] * len(x)
    if first < len(x):
        out[first] = sum(x[first - n + 1 : first + 1]) / n
        for i in range(first + 1, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def rsi(c, n):
    up, down = ([0.0] + [max(s * (b - a), 0.0) for a, b in zip(c, c[1:])] for s in (1, -1))
    return [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(wilder(up, n, n), wilder(down, n, n))]


def ranges(h, l, c):  # noqa: E741
    return [h[0] - l[0]] + [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(h))]


def adx(h, l, c, n):  # noqa: E741
    size = len(h)
    if size < 2 * n:
        return [None] * size
    rise, fall = ([0.0] + [s * (x[i] - x[i - 1]) for i in range(1, size)] for s, x in ((1, h), (-1, l)))
    sums = []
    for m in ([r if r > f and r > 0 else 0.0 for r, f in zip(rise, fall)], [f if f > r and f > 0 else 0.0 for r, f in zip(rise, fall)], ranges(h, l, c)):
        s = [None] * size
        s[n] = sum(m[1 : n + 1])
        for i in range(n + 1, size):
            s[i] = s[i - 1] - s[i - 1] / n + m[i]
        sums.append(s)
    dx = [None if t in (None, 0) or p + q == 0 else 100 * abs(p - q) / (p + q) for p, q, t in zip(*sums)]
    seeds, out = [v for v in dx[n : 2 * n] if v is not None], [None] * size
    if seeds:
        out[2 * n - 1] = sum(seeds) / len(seeds)
        for i in range(2 * n, size):
            out[i] = out[i - 1] if dx[i] is None else (out[i - 1] * (n - 1) + dx[i]) / n
    return out


def walk(rng, size, still=()):
    rows, p = [], 100.0
    for i in range(size):
        flat = any(a <= i < b for a, b in still)
        o, p = p, p if flat else max(1.0, p + rng.gauss(0, 1))
        rows.append((o, max(o, p) + (0 if flat else rng.random()), min(o, p) - (0 if flat else rng.random()), p, rng.random()))
    return rows


@pytest.mark.parametrize("stretch", [4096, 7])
def test_against_loops(spark, monkeypatch, stretch):
    monkeypatch.setattr(I, "STRETCH", stretch)
    rng = random.Random(4)
    series = {"long": walk(rng, 3000, [(500, 900)]), "short": walk(rng, 9), "one": walk(rng, 1), "still": walk(rng, 300, [(0, 300)]), "late": walk(rng, 60, [(0, 30)]), None: walk(rng, 50)}
    rows = [(s, i * 60_000, *r) for s, own in series.items() for i, r in enumerate(own)]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts long, open double, high double, low double, close double, volume double").repartition(5)
    wanted = {f"{kind}_{n}": (kind, n) for kind in I.RECURSIVE for n in (1, 2, 5, 14)} | {"again": ("ema", 5)}
    got = {(r.symbol, r.bar_ts // 60_000): r for r in I.with_recursive(bars, wanted).collect()}
    assert len(got) == len(rows)
    for s, own in series.items():
        _, h, l, c, _ = (list(x) for x in zip(*own))  # noqa: E741
        for name, (kind, n) in wanted.items():
            want = {"ema": lambda: ema(c, n), "rsi": lambda: rsi(c, n), "atr": lambda: wilder(ranges(h, l, c), n, n - 1), "adx": lambda: adx(h, l, c, n)}[kind]()
            for i, w in enumerate(want):
                v = got[s, i][name]
                assert (v is None) == (w is None) and (w is None or math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9)), (s, name, i, v, w)


def test_leading_gaps_and_no_python(spark):
    rows = [("a", i, None if i < 3 else float(i)) for i in range(9)]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts long, close double")
    out = I.with_recursive(bars, {"x": ("ema", 2)})
    assert [r.x for r in out.orderBy("bar_ts").collect()] == [None if w is None else pytest.approx(w) for w in ema([r[2] for r in rows], 2)]
    assert out.columns == ["symbol", "bar_ts", "close", "x"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
