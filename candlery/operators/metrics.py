"""What a list of trades or an equity curve amounts to.

Totals are plain aggregates with a partial step before the shuffle. What goes in exit order is a window over a stretch
of a strategy's time (in_stretches), with what came before the stretch carried on: a strategy with a third of all trades
is so spread over many tasks. Nothing is gathered on the driver but the ends of the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

COMMISSION = 0.0006  # of the traded value, on each leg
INFINITY = float("inf")
PNL = lambda: F.col("pnl")  # noqa: E731  columns need a session, so made when called


def profit_factor(gain: Column, loss: Column) -> Column:
    """Gain over loss; infinite without losses, 0 without both."""
    return F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).when(gain > 0, F.lit(INFINITY)).otherwise(F.lit(0.0))


def totals() -> list[Column]:
    return [
        F.count("*").alias("trades"), F.count_if(PNL() > 0).alias("wins"), F.coalesce(F.sum(F.when(PNL() > 0, PNL())), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(PNL() <= 0, F.abs(PNL()))), F.lit(0.0)).alias("gross_loss"),
    ]


def trade_totals(trades: DataFrame, *key: str) -> DataFrame:
    return trades.groupBy(*key).agg(*totals())


def with_ratios(t: DataFrame) -> DataFrame:
    """Adds win_rate (percent), pf and net to totals."""
    return t.withColumns({"win_rate": F.col("wins") / F.nullif(F.col("trades"), F.lit(0)) * 100, "pf": profit_factor(F.col("gross_profit"), F.col("gross_loss")), "net": F.col("gross_profit") - F.col("gross_loss")})


def by_regime(trades: DataFrame, *key: str) -> DataFrame:
    """Totals by the regime at entry; an unknown one is _unknown."""
    return with_ratios(trades.groupBy(*key, F.coalesce("regime", F.lit("_unknown")).alias("regime")).agg(*totals()))


def sharpe(initial: float) -> Column:
    """Mean over sample deviation of returns on the initial capital, times the root of their number; 0 if undefined."""
    r = PNL() / initial
    return F.coalesce(F.when((F.count(r) > 1) & (F.stddev_samp(r) > 0), F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.count(r))), F.lit(0.0))


#: Rows that a stretch is to hold, and the equal cells of the values, least and most, from which stretches are made up.
STRETCH_ROWS, CELLS, MOST_CELLS = 50_000, 4096, 1 << 16


def in_stretches(rows: DataFrame, by: str) -> DataFrame:
    """rows with _b: which stretch of column `by` (a number) a row is of; -1 for null.

    Stretches are runs of cells that hold about STRETCH_ROWS together, so that a busy time is cut finer than a quiet
    one. What comes to the driver is a row a cell. Rows with one value stay together.
    """
    low, high, n = rows.agg(F.min(by), F.max(by), F.count(by)).first()
    if low is None or low == high or n <= STRETCH_ROWS:
        return rows.withColumn("_b", F.when(F.col(by).isNull(), -1).otherwise(0))
    cells = max(CELLS, min(MOST_CELLS, 4 * n // STRETCH_ROWS))
    cell = F.least(F.floor((F.col(by) - F.lit(low)) / float(high - low) * cells), F.lit(cells - 1)).cast("int")
    counts = {r[0]: r[1] for r in rows.where(F.col(by).isNotNull()).groupBy(cell.alias("cell")).count().collect()}
    stretch, held, out = 0, 0, []
    for c in range(cells):
        if held and held + counts.get(c, 0) > STRETCH_ROWS:
            stretch, held = stretch + 1, 0
        held += counts.get(c, 0)
        out.append(stretch)
    of = F.split(F.lit(",".join(map(str, out))), ",").cast("array<int>")  # a constant, folded once
    return rows.withColumn("_b", F.coalesce(F.element_at(of, cell + 1), F.lit(-1)))


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows with the key as _k, a struct: never null, and equal where both keys are null. Joins by _k and _b and windows
    over them so ask for one distribution, and rows are sent once for all of them."""
    return rows.select(*(F.struct(c).alias("_k") if c == key else F.col(f"`{c}`") for c in rows.columns))


def _plain(rows: DataFrame, key: str, *without: str) -> DataFrame:
    """rows with the key itself in place of _k, and without some columns."""
    return rows.select(*(F.col("_k")[key].alias(key) if c == "_k" else F.col(f"`{c}`") for c in rows.columns if c not in without))


def _within(order: list[str]):
    return W.partitionBy("_k", "_b").orderBy(*order)


def carried(rows: DataFrame, **values: tuple[Column, str]) -> DataFrame:
    """rows (_keyed, in stretches) with, for each name, the sum, max or last of an aggregate over a key's earlier stretches; null at the first."""
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row a stretch
    per = rows.groupBy("_k", "_b").agg(*(x.alias(n) for n, (x, _) in values.items()))
    over = {"sum": lambda n: F.sum(n), "max": lambda n: F.max(n), "last": lambda n: F.last(n, ignorenulls=True)}
    return rows.join(per.select("_k", "_b", *(over[how](n).over(before).alias(n) for n, (_, how) in values.items())), ["_k", "_b"])


def drawdown(curve: DataFrame, key: str, order: list[str], equity: str = "equity") -> DataFrame:
    """Largest fall from the running peak, in money and as a share."""
    x = curve if "_b" in curve.columns else in_stretches(curve, order[0])
    x = carried(_keyed(x.select(key, "_b", *order, F.col(equity).alias("e")), key), _p=(F.max("e"), "max"))
    x = x.withColumn("p", F.greatest(F.max("e").over(_within(order).rowsBetween(W.unboundedPreceding, 0)), F.col("_p")))
    out = x.groupBy("_k").agg(F.max(F.col("p") - F.col("e")).alias("max_dd"), F.max((F.col("p") - F.col("e")) / F.nullif(F.col("p"), F.lit(0.0))).alias("max_dd_pct"))
    return _plain(out, key)


def _with_equity(trades: DataFrame, key: str, order: list[str], initial: float) -> DataFrame:
    """trades, _keyed and in stretches, with equity after each, and _n: how many there are in earlier stretches."""
    x = carried(_keyed(in_stretches(trades, order[0]), key), _s=(F.sum("pnl"), "sum"), _n=(F.count("*"), "sum"))
    own = F.sum("pnl").over(_within(order).rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("equity", F.lit(initial) + F.coalesce("_s", F.lit(0.0)) + own).drop("_s")


def equity_curve(trades: DataFrame, key: str, order: list[str], initial: float, keep_stretches: bool = False) -> DataFrame:
    """trades with equity after each; keep_stretches leaves the column _b of in_stretches for what comes next."""
    return _plain(_with_equity(trades, key, order, initial), key, "_n", *([] if keep_stretches else ["_b"])).select(*trades.columns, *(["_b"] if keep_stretches else []), "equity")


def recent_equity(trades: DataFrame, key: str, order: list[str], initial: float, last: int = 10) -> DataFrame:
    """trades with equity after each, n_before, last_equity, and mean_equity of the `last` trades before, null while
    there are fewer.

    A stretch starts with the last equities of those before it; each holds one at least, so `last` of them will do.
    """
    curve, at = _with_equity(trades, key, order, initial), _within(order)
    back = W.partitionBy("_k", "_b").orderBy(*(F.desc(c) for c in order))
    tails = curve.select("_k", "_b", *order, "equity", F.row_number().over(back).alias("_r")).where(F.col("_r") <= last)
    tails = tails.groupBy("_k", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "equity"))), lambda x: x.equity).alias("_tail"))
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(-last, -1)  # a row a stretch
    ends = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - last + 1), F.lit(last))
    x = curve.join(tails.select("_k", "_b", ends(F.flatten(F.collect_list("_tail").over(before))).alias("_tail")), ["_k", "_b"])
    x = x.withColumn("_seen", ends(F.concat("_tail", F.collect_list("equity").over(at.rowsBetween(-last, -1)))))
    mean = F.aggregate("_seen", F.lit(0.0), lambda s, e: s + e) / last
    new = {"n_before": F.coalesce("_n", F.lit(0)) + F.row_number().over(at) - 1, "last_equity": F.try_element_at("_seen", F.lit(-1)), "mean_equity": F.when(F.size("_seen") == last, mean)}
    return _plain(x.withColumns(new), key, "_n", "_tail", "_seen", "_b")


def cagr(total_return: Column, years: Column) -> Column:
    """Yearly rate of a total return (0.5: half more); the return itself where there is no yearly rate."""
    return F.when((years > 0) & (total_return > -1), F.pow(1 + total_return, 1 / F.nullif(years, F.lit(0.0))) - 1).otherwise(total_return)


def pooled(rows: DataFrame, *key: str) -> DataFrame:
    """Breakdown rows (trades, wins, pf, gross_profit, gross_loss) pooled: sums first, then the ratio.

    Where a row lacks its gross sums the profit factors are averaged by trades.
    """
    t = rows.groupBy(*key).agg(
        F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.sum("gross_profit").alias("gp"), F.sum("gross_loss").alias("gl"),
        F.count_if(F.col("gross_profit").isNull() | F.col("gross_loss").isNull()).alias("lacking"), F.sum(F.col("trades") * F.col("pf")).alias("weighted"))
    pf = F.when(F.col("lacking") > 0, F.col("weighted") / F.nullif(F.col("trades"), F.lit(0))).otherwise(profit_factor(F.col("gp"), F.col("gl")))
    return t.select(*key, "trades", "wins", pf.alias("pf"))


def worst_regime(breakdown: DataFrame, *key: str, least: int = 5) -> DataFrame:
    """Least finite profit factor of regimes with enough trades."""
    ok = (F.col("trades") >= least) & F.col("pf").isNotNull() & ~F.isnan("pf") & (F.abs("pf") < INFINITY)
    return breakdown.where(ok).groupBy(*key).agg(F.min("pf").alias("worst_pf"))


def walk_forward_means(windows: DataFrame, *key: str) -> DataFrame:
    """Means over windows with trades and a positive in-sample factor, and their ratio (efficiency)."""
    valid = (F.col("is_trades") > 0) & (F.col("is_pf") > 0)
    t = windows.groupBy(*key).agg(F.avg(F.when(valid, F.col("is_pf"))).alias("mean_is"), F.avg(F.when(valid, F.col("oos_pf"))).alias("mean_oos"), F.count_if(valid).alias("valid"))
    return t.withColumn("wfe", F.col("mean_oos") / F.nullif(F.col("mean_is"), F.lit(0.0)))


def monthly(curve: DataFrame, key: str, ts: str, order: list[str], initial: float) -> DataFrame:
    """Last equity of each month, the month before's as its start, and percent change."""
    at = F.timestamp_millis(F.col(ts))
    m = curve.groupBy(key, F.year(at).alias("year"), F.month(at).alias("month")).agg(F.max_by("equity", F.struct(*order)).alias("end"))
    start = F.lag("end", 1).over(W.partitionBy(key).orderBy("year", "month"))
    m = m.withColumn("start", F.coalesce(start, F.lit(initial)))
    return m.withColumn("pct", (F.col("end") - F.col("start")) / F.nullif(F.col("start"), F.lit(0.0)) * 100)


def yearly(months: DataFrame, key: str) -> DataFrame:
    y = months.groupBy(key, "year").agg(F.min_by("start", "month").alias("start"), F.max_by("end", "month").alias("end"))
    return y.withColumn("pct", (F.col("end") - F.col("start")) / F.nullif(F.col("start"), F.lit(0.0)) * 100)


def month_grid(months: DataFrame, key: str) -> DataFrame:
    return months.groupBy(key, "year").pivot("month", list(range(1, 13))).agg(F.first("pct")).withColumnsRenamed({str(m): f"m{m:02d}" for m in range(1, 13)})


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Percent from the first open to the last close of each symbol and year (UTC)."""
    year = F.year(F.timestamp_millis(F.col("bar_ts")))
    out = bars.groupBy("symbol", year.alias("year")).agg(F.min_by("open", F.col("bar_ts")).alias("o"), F.max_by("close", F.col("bar_ts")).alias("c"))
    return out.select("symbol", "year", ((F.col("c") - F.col("o")) / F.nullif(F.col("o"), F.lit(0.0)) * 100).alias("hold_pct"))


def signal_counts(trades: DataFrame, signal: str, alias: dict[str, str]) -> DataFrame:
    """Trades by exit signal, with some signals counted under another's name."""
    name = F.coalesce(*(F.when(F.col(signal) == k, F.lit(v)) for k, v in alias.items()), F.col(signal))
    return trades.groupBy(name.alias("signal")).count().withColumnRenamed("count", "n")


def distribution(df: DataFrame, key: str, x: str) -> DataFrame:
    """Mean, least, most, and values at floor(n * p) of the sorted ones.

    Counts by stretch of values tell in which stretch a rank lies, and only rows of those stretches are ranked.
    """
    shares = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    rows = _keyed(in_stretches(df.select(key, x).where(F.col(x).isNotNull()), x), key)
    per = rows.groupBy("_k", "_b").agg(F.count("*").alias("_m"))
    w = W.partitionBy("_k")  # a row a stretch
    per = per.withColumns({"_n": F.sum("_m").over(w), "_before": F.coalesce(F.sum("_m").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    at = {n: F.floor(F.col("_n") * p) - F.col("_before") for n, p in shares.items()}
    per = per.select("_k", "_b", *(F.when((i >= 0) & (i < F.col("_m")), i).alias(f"_{n}") for n, i in at.items()))
    wanted = per.where(" or ".join(f"_{n} is not null" for n in shares))
    ranked = rows.join(wanted, ["_k", "_b"]).withColumn("_i", F.row_number().over(_within([x])) - 1)
    found = ranked.groupBy("_k").agg(*(F.max(F.when(F.col("_i") == F.col(f"_{n}"), F.col(x))).alias(n) for n in shares))
    ends = df.groupBy(key).agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    return ends.join(found, ends[key].eqNullSafe(found["_k"][key]), "left").select(key, "mean", "median", "p10", "p90", "least", "most")


def diversity(genes: DataFrame, key: str) -> DataFrame:
    """Mean over parameters of the deviation as a share of the parameter's range; genes: key, param, value, low, high."""
    p = genes.groupBy(key, "param").agg((F.stddev_pop("value") / F.nullif(F.max("high") - F.min("low"), F.lit(0.0))).alias("spread"))
    return p.groupBy(key).agg(F.avg("spread").alias("diversity"))


def streaks(trades: DataFrame, key: str, order: list[str]) -> DataFrame:
    """After each trade the kind (W, L) and length of the current streak; trades at 0 change nothing.

    Each stretch tells its last sign, and how many trades have it in a row at its end; from that follows the streak with
    which the next one starts. Trades are sent once as they are, and once with order and sign only.
    """
    x = _keyed(in_stretches(trades, order[0]), key).withColumn("_s", F.when(PNL() > 0, 1).when(PNL() < 0, -1))
    at = _within(order)
    up_to, prior = at.rowsBetween(W.unboundedPreceding, 0), at.rowsBetween(W.unboundedPreceding, -1)
    last, turned = lambda w: F.last("_s", ignorenulls=True).over(w), lambda before: F.col("_s").isNotNull() & ~F.col("_s").eqNullSafe(before)
    mine = x.select("_k", "_b", "_s", F.count("_s").over(up_to).alias("_c"), last(prior).alias("_last"))
    turn = turned(F.col("_last"))
    per = mine.groupBy("_k", "_b").agg(F.max("_c").alias("_all"), F.max(F.when(turn, F.col("_c") - 1)).alias("_from"), F.max_by("_s", F.when(turn, F.col("_c"))).alias("_s"))
    w = W.partitionBy("_k").orderBy("_b")  # a row a stretch
    so_far, earlier = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"_run": F.col("_all") - F.coalesce("_from", F.lit(0)), "_before": last(earlier)})
    per = per.withColumn("_sum", F.sum("_run").over(so_far))
    starts = turned(F.col("_before")) | (F.col("_run") < F.col("_all"))  # its last run begins in the stretch
    per = per.withColumn("_length", F.col("_sum") - F.max(F.when(starts, F.col("_sum") - F.col("_run"))).over(so_far))
    per = per.select("_k", "_b", "_before", F.coalesce(F.lag("_length").over(w), F.lit(0)).alias("_length"))
    x = x.join(per, ["_k", "_b"]).withColumns({"_c": F.count("_s").over(up_to), "_last": F.coalesce(last(prior), F.col("_before")), "_now": F.coalesce(last(up_to), F.col("_before"))})
    start = F.max(F.when(turned(F.col("_last")), F.col("_c") - 1)).over(up_to)
    x = x.withColumns({"streak": F.coalesce(F.col("_c") - start, F.col("_c") + F.col("_length")), "kind": F.when(F.col("_now") > 0, "W").when(F.col("_now") < 0, "L")})
    return _plain(x, key, "_b", "_s", "_before", "_length", "_c", "_last", "_now")


def running_stats(trades: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What was known before each trade: number, win rate, mean win and loss, largest win and loss, last pnl."""
    win, loss, at = F.when(PNL() > 0, PNL()), F.when(PNL() < 0, -PNL()), F.struct(*order)
    parts = {"n": F.count("*"), "won": F.count(win), "lost": F.count(loss), "wins": F.sum(win), "losses": F.sum(loss)}
    x = carried(_keyed(in_stretches(trades, order[0]), key), **{f"_{n}": (v, "sum") for n, v in parts.items()}, _top=(F.max(win), "max"), _low=(F.max(loss), "max"), _end=(F.max_by("pnl", at), "last"))
    w = _within(order)
    b = w.rowsBetween(W.unboundedPreceding, -1)
    have = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.coalesce(v.over(b), F.lit(0)) for n, v in parts.items()}
    mean = lambda total, n: F.coalesce(have[total] / F.nullif(have[n], F.lit(0)), F.lit(0.0))
    out = x.withColumns({
        "n_before": have["n"], "win_rate": mean("won", "n"), "avg_win": mean("wins", "won"), "avg_loss": mean("losses", "lost"),
        "biggest_win": F.coalesce(F.greatest(F.max(win).over(b), F.col("_top")), F.lit(0.0)), "biggest_loss": F.coalesce(F.greatest(F.max(loss).over(b), F.col("_low")), F.lit(0.0)),
        "last_pnl": F.coalesce(F.lag("pnl").over(w), F.col("_end")),
    })
    return _plain(out, key, "_b", *(f"_{n}" for n in parts), "_top", "_low", "_end")


def sub_pnl(units: Column, entry: Column, exit_: Column, long: Column) -> Column:
    """Profit of a slice after commission on both legs."""
    move = F.when(long, exit_ - entry).otherwise(entry - exit_)
    return units * move - units * (entry + exit_) * COMMISSION


def leverage_cap(units: Column, equity: Column, leverage: Column, price: Column) -> Column:
    return F.least(units, equity * leverage / F.nullif(price, F.lit(0.0)))


def risk_share(risk: Column, units: Column, position: list[str]) -> Column:
    """A slice's part of its position's risk, by units."""
    return risk * units / F.nullif(F.sum(units).over(W.partitionBy(*position)), F.lit(0.0))
