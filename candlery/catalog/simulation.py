"""Specs over the tables, beside the same walk as a recursive SQL query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import evaluated, runtime as R, search as S
from ..plans.spec import validate
from ..sources import files
from . import DAILY, query
from .bars import daily, rounded
from .indicators import RSI, TR, ema_cte, frame, numbered, rma_cte

COST, SLIP = 0.0006, 0.02
GENE = {"gene_id": 1, "emaTrend.main.emaFast": 8, "emaTrend.main.emaSlow": 30, "donchianBreakout.main.period": 14, "atrHardStop.main.atrSL": 2.0}
OUT = "struct(position bigint, way integer, entry_ts bigint, exit_ts bigint, signal varchar, entry_price double, exit_price double, units double, pnl double, equity double, regime varchar)[]"


def signals(fast: int = 8, slow: int = 30, period: int = 14) -> str:
    """ser: a symbol's bars by number, with what the account reads."""
    before = f"over (partition by symbol order by bar_ts rows between {period} preceding and 1 preceding)"
    high, low = f"max(high) {frame(14)}", f"min(low) {frame(14)}"
    k = f"case when count(s) {frame(3)} = 3 then avg(s) {frame(3)} end"
    d = f"case when count(k) {frame(3)} = 3 then avg(k) {frame(3)} end"
    lag = lambda x, n=1: f"lag({x}, {n}) over (partition by symbol order by bar_ts)"
    return f"""{DAILY}, {numbered("daily")}, {ema_cte("f", fast)}, {ema_cte("w", slow)}, {rma_cte("atr", 14, f"({TR})", 13)}, {RSI},
j as (select n.*, f.v as fast, w.v as slow, atr.v as a, rsi.v as r, count(*) {before} = {period} as full_, max(high) {before} as top, min(low) {before} as low_,
 case when count(*) {frame(14)} = 14 then case when {high} = {low} then 50.0 else (close - {low})/nullif({high} - {low}, 0)*100 end end as s
 from n left join f using (symbol, i) left join w using (symbol, i) left join atr using (symbol, i) left join rsi using (symbol, i)),
jk as (select *, {k} as k from j), jd as (select *, {d} as d from jk), je as (select *, {lag("k")} as k1, {lag("d")} as d1, {lag("r", 3)} as r3, {lag("a")} as a1 from jd),
ser as (select symbol, i, bar_ts, open, high, low, close, a1, coalesce(fast > slow, false) and full_ and close > top as lo, coalesce(fast < slow, false) and full_ and close < low_ as so,
 coalesce(k < d and k1 >= d1 and k > 60, false) or coalesce(r < 40 and r3 > 55, false) as xl, coalesce(k > d and k1 <= d1 and k < 40, false) or coalesce(r > 60 and r3 < 45, false) as xs from je)"""


def walk(rel: str = "ser", stop: float = 2.0, pct: float = 10.0, most: int = 40, emergency: float = 25.0, targets=((1.5, 50.0), (3.0, 50.0))) -> str:
    """walk: each bar's state of the account, and the trades that the bar closed; last: those at the end."""
    share = targets[0][1] / (targets[0][1] + targets[1][1])

    def closing(sql: str, k: int, price: str, tag: str, when: str) -> str:
        g = f"case when {when} and s{k} > 0 then s{k}*(({price})-ep)*way - s{k}*ep*{COST} - s{k}*({price})*{COST} end"
        row = f"{{'position': n - 1, 'way': way, 'entry_ts': ets, 'exit_ts': bar_ts, 'signal': {tag}, 'entry_price': ep, 'exit_price': {price}, 'units': s{k}, 'pnl': g, 'equity': greatest(0.0, eq + g), 'regime': null}}"
        return f"select * exclude (g) replace (case when g is null then eq else greatest(0.0, eq + g) end as eq, case when g is null then s{k} else 0.0 end as s{k}, case when g is null then outs else list_append(outs, {row}) end as outs) from (select *, {g} as g from ({sql}))"

    def both(sql: str, price: str, tag: str, when: str) -> str:
        sql = closing(closing(f"select *, {when} as do_ from ({sql})", 1, price, tag, "do_"), 2, price, tag, "do_")
        return f"select * exclude (do_) replace (case when do_ then 0 else way end as way) from ({sql})"

    state = "symbol, i, eq, n, way, ep, eb, ets, a, armed, ft, s1, p1, s2, p2, lv, en"
    q = f"select w.symbol, s.i, {', '.join('w.' + c for c in state.split(', ')[2:])}, cast([] as {OUT}) as outs, s.* exclude (symbol, i) from walk w join {rel} s on s.symbol = w.symbol and s.i = w.i + 1"
    q = both(q, f"open - way*{SLIP}", "lv", "lv is not null and way <> 0")
    q = f"select *, en <> 0 and way = 0 and eq > 0 as in_, open + en*{SLIP} as pr from (select * replace (cast(null as varchar) as lv) from ({q}))"
    q = f"select * exclude (in_, pr, u) replace (case when in_ then en else way end as way, case when in_ then pr else ep end as ep, case when in_ then i else eb end as eb, case when in_ then bar_ts else ets end as ets, case when in_ then a1 else a end as a, case when in_ then false else armed end as armed, case when in_ then cast(null as bigint) else ft end as ft, case when in_ then n + 1 else n end as n, case when not in_ then s1 when a1 > 0 then u*{share!r} else u end as s1, case when not in_ then p1 when a1 > 0 then pr + en*a1*{targets[0][0]} end as p1, case when not in_ then s2 when a1 > 0 then u - u*{share!r} else 0.0 end as s2, case when not in_ then p2 when a1 > 0 then pr + en*a1*{targets[1][0]} end as p2) from (select *, least(eq*{pct}/100/pr, eq/pr) as u from ({q}))"
    q = f"select *, ep*(1 - way*{emergency}/100) as fl, case when ft is not null and i > ft then ep*(1 + way*0.003) else ep - way*a*{stop} end as st from ({q})"
    q = both(q, f"fl - way*{SLIP}", "'ESL'", "way <> 0 and coalesce(a > 0, false) and (case when way > 0 then low <= fl else high >= fl end)")
    q = f"select * exclude (fl, st) replace (case when way <> 0 and a > 0 and armed then 'SL' end as lv, way <> 0 and coalesce(a > 0, false) and not armed and (close - st)*way <= 0 as armed) from ({q})"
    for k in (1, 2):
        hit = f"way <> 0 and lv is null and i > eb and p{k} is not null and (case when way > 0 then high >= p{k} else low <= p{k} end)"
        q = closing(f"select *, {hit} as do_ from ({q})", k, f"p{k}", f"'TP{k}'", "do_")
        q = f"select * exclude (do_) replace ({'case when do_ and ft is null then i else ft end as ft' if k == 1 else 'case when way <> 0 and s1 = 0 and s2 = 0 then 0 else way end as way'}) from ({q})"
    q = f"select * replace (case when lv is not null or way = 0 then lv when i - eb >= {most - 1} then 'Time' when case when way > 0 then so else lo end then 'Reversal' when case when way > 0 then xl else xs end then 'Structural' end as lv) from ({q})"
    q = f"select *, case when lo then 1 when so then -1 else 0 end as go from ({q})"
    q = f"select {state.removesuffix(', en')}, case when go <> 0 and eq > 0 and (way = 0 or lv is not null and go = -way) then go else 0 end as en, outs, bar_ts, close, eq + case when way <> 0 then (s1 + s2)*(close - ep)*way else 0 end as worth from ({q})"
    start = f"select symbol, cast(-1 as bigint) as i, 100000.0::double as eq, cast(0 as bigint) as n, 0 as way, 0.0::double as ep, cast(0 as bigint) as eb, cast(0 as bigint) as ets, 0.0::double as a, false as armed, cast(null as bigint) as ft, 0.0::double as s1, 0.0::double as p1, 0.0::double as s2, 0.0::double as p2, cast(null as varchar) as lv, 0 as en, cast([] as {OUT}) as outs, cast(0 as bigint) as bar_ts, 0.0::double as close, 100000.0::double as worth from {rel} group by symbol"
    end = both("select * from walk where (symbol, i) in (select (symbol, max(i)) from walk group by symbol)", "close", "'End'", "way <> 0")
    end = end.replace("select * from walk where", f"select * replace (cast([] as {OUT}) as outs) from walk where")
    return f"""walk as ({start} union all {q}), last as ({end}),
trades as (select symbol, unnest(outs, recursive := true) from (select symbol, outs from walk union all select symbol, outs from last))"""


#: For each series of the walk: trades, positions, wins, pf, net, max_dd and max_dd_pct, as a summary has them.
SUMS = """closes as (select symbol, i, outs from walk union all select symbol, i + 1, outs from last),
marks as (select symbol, i, unnest(range(1, len(outs) + 1)) as k, unnest(list_transform(outs, lambda o: o.equity)) as worth from closes union all select symbol, i, 9, worth from walk),
peaks as (select symbol, worth, max(worth) over (partition by symbol order by i, k rows between unbounded preceding and current row) as peak from marks),
falls as (select symbol, max(peak - worth) as max_dd, max((peak - worth)/nullif(peak, 0)) as max_dd_pct from peaks group by 1),
ends as (select symbol, arg_max(worth, i*10 + k) as equity from marks where k < 9 group by 1),
totals as (select symbol, count(*) as trades, count(distinct position) as positions, count(*) filter (where pnl > 0) as wins, coalesce(sum(pnl) filter (where pnl > 0), 0) as won, -coalesce(sum(pnl) filter (where pnl <= 0), 0) as lost from trades group by 1),
sums as (select symbol, coalesce(trades, 0) as trades, coalesce(positions, 0) as positions, coalesce(wins, 0) as wins, case when lost > 0 then won/lost when won > 0 then null else 0.0 end as pf, coalesce(equity, 100000.0) - 100000.0 as net, max_dd, max_dd_pct from falls left join ends using (symbol) left join totals using (symbol))"""
SIM = f"with recursive {signals()}, {walk()}"


def series(spark, d):
    return R.series(daily(spark, d), S.TREND, [GENE])


def trades(spark, d):
    return R.trades(series(spark, d), S.TREND, [GENE])


@query("st_01_backtest", f"{SIM} select symbol, position, case when way > 0 then 'Long' else 'Short' end as direction, entry_ts, exit_ts, signal, round(entry_price, 6) as entry_price, round(exit_price, 6) as exit_price, round(units, 6) as units, round(pnl, 4) as pnl, round(equity, 4) as equity from trades")
def _(spark, d):
    t = rounded(rounded(trades(spark, d), "entry_price", "exit_price", "units"), "pnl", "equity", places=4)
    return t.select("symbol", "position", "direction", "entry_ts", "exit_ts", "signal", "entry_price", "exit_price", "units", "pnl", "equity")


@query("st_01_backtest_metrics", f"{SIM}, {SUMS} select symbol, trades, positions, wins, round(pf, 6) as pf, round(net, 4) as net, round(max_dd, 4) as max_dd, round(max_dd_pct, 6) as max_dd_pct from sums")
def _(spark, d):
    s = R.summaries(series(spark, d), S.TREND, [GENE])
    return s.select("symbol", "trades", "positions", "wins", F.round("pf", 6).alias("pf"), F.round("net", 4).alias("net"), F.round("max_dd", 4).alias("max_dd"), F.round("max_dd_pct", 6).alias("max_dd_pct"))


@query("st_12_equity_snapshots", f"{SIM} select symbol, bar_ts, round(worth, 4) as equity from walk where i >= 0")
def _(spark, d):
    return rounded(R.snapshots(series(spark, d), S.TREND, [GENE]), "equity", places=4).select("symbol", "bar_ts", "equity")


def by_signal(name: str, signals_: tuple[str, ...]) -> None:
    """Exits of one block, among all the others' that decide what it sees."""
    listed = ", ".join(f"'{s}'" for s in signals_)

    @query(name, f"{SIM} select symbol, position, exit_ts, signal, round(exit_price, 6) as exit_price, round(units, 6) as units from trades where signal in ({listed})")
    def _(spark, d):
        t = trades(spark, d).where(F.col("signal").isin(*signals_))
        return rounded(t.select("symbol", "position", "exit_ts", "signal", "exit_price", "units"), "exit_price", "units")


by_signal("ex_01_hard_stop", ("ESL", "SL"))
by_signal("ex_02_scale_out", ("TP1", "TP2"))
by_signal("ex_03_structural", ("Time", "Reversal", "Structural"))


WINDOWS = """spans as (select min(c) as n from (select count(*) as c from daily group by symbol)), wins as (select n, cast(floor((n - 200)*0.3) as bigint) as region, unnest(range(4)) as win from spans),
bounds as (select win, 200 as is_start, n - region + win*(region//4) as is_end, least(n - region + (win + 1)*(region//4), n) as oos_end from wins),
phases as (select win, 'is' as phase, is_start as a, is_end as z from bounds union all select win, 'oos', is_end, oos_end from bounds),
parts as (select ser.* replace (symbol || '/' || win || '/' || phase as symbol, i - a as i) from ser join phases on i >= a and i < z)"""


@query("ga_15_walk_forward", f"with recursive {signals()}, {WINDOWS}, {walk('parts')}, {SUMS} select split_part(symbol, '/', 1) as symbol, cast(split_part(symbol, '/', 2) as bigint) as \"window\", split_part(symbol, '/', 3) as phase, trades, wins, round(pf, 6) as pf, round(net, 4) as net from sums")
def _(spark, d):
    bars = daily(spark, d)
    length = bars.groupBy("symbol").count().agg(F.min("count")).first()[0]  # of the shortest series
    out = S.walk_forward(bars, S.TREND, GENE, S.window_bounds(spark, length, 200, 4, 0.3))
    return out.select("symbol", "window", "phase", "trades", "wins", F.round("pf", 6).alias("pf"), F.round("net", 4).alias("net"))


def genes(n: int) -> list[dict]:
    return [GENE | {"gene_id": k, "emaTrend.main.emaFast": 5 + k % 20, "emaTrend.main.emaSlow": 30 + 5 * (k % 13), "donchianBreakout.main.period": 10 + 2 * (k % 11)} for k in range(n)]


#: The series of 24 genes: an average of each length, and highs and lows of each period, once.
GENES = """g as (select k, 5 + k % 20 as fast, 30 + 5*(k % 13) as slow, 10 + 2*(k % 11) as period from range(24) t(k)), ns as (select fast as nn from g union select slow from g),
em as (select symbol, nn, cast(nn - 1 as bigint) as i, avg(close) as v from n join ns on i < nn group by symbol, nn having count(*) = nn
 union all select em.symbol, em.nn, em.i + 1, x.close*(2.0::double/(nn + 1)) + em.v*(1 - 2.0::double/(nn + 1)) from em join n x on x.symbol = em.symbol and x.i = em.i + 1),
don as (select a.symbol, a.i, p.period, max(b.high) as top, min(b.low) as low_, count(*) as c from n a join (select distinct period from g) p on true join n b on b.symbol = a.symbol and b.i >= a.i - p.period and b.i < a.i group by 1, 2, 3),
each as (select s.* replace (s.symbol || '/' || g.k as symbol, coalesce(f.v > w.v, false) and coalesce(don.c = g.period and s.close > don.top, false) as lo, coalesce(f.v < w.v, false) and coalesce(don.c = g.period and s.close < don.low_, false) as so)
 from ser s cross join g left join em f on f.symbol = s.symbol and f.i = s.i and f.nn = g.fast left join em w on w.symbol = s.symbol and w.i = s.i and w.nn = g.slow left join don on don.symbol = s.symbol and don.i = s.i and don.period = g.period)"""
SCORE = "case when trades < 3 then -5000.0 when trades < 10 then -1000.0 + trades*10 else net/1000*(1 - 0.3*pow(least(max_dd_pct/0.25, 1), 2)) end"


@query("ga_07_evaluate", f"with recursive {signals()}, {GENES}, {walk('each')}, {SUMS} select split_part(symbol, '/', 1) as symbol, cast(split_part(symbol, '/', 2) as bigint) as gene_id, trades, positions, wins, round(pf, 6) as pf, round(net, 4) as net, round(max_dd_pct, 6) as max_dd_pct, round({SCORE}, 4) as score from sums")
def _(spark, d):
    out = S.evaluate(daily(spark, d), S.TREND, genes(24))
    return out.select("symbol", "gene_id", "trades", "positions", "wins", F.round("pf", 6).alias("pf"), F.round("net", 4).alias("net"), F.round("max_dd_pct", 6).alias("max_dd_pct"), F.round("score", 4).alias("score"))


@query("ga_07_cached", f"with recursive {signals()}, {GENES}, {walk('each')}, {SUMS} select cast(split_part(symbol, '/', 2) as bigint) as gene_id, round(avg({SCORE}), 4) as fitness, sum(trades) as trades, cast(split_part(symbol, '/', 2) as bigint) < 9 and avg({SCORE}) > 0 as known from sums group by 1")
def _(spark, d):
    """Nine genes, then all: the second run takes from the cache what the first has found and kept."""
    folder, bars, spec = files.scratch(spark), daily(spark, d), S.TREND | {"hash": validate(S.TREND)["hash"]}
    evaluated.evaluate(bars, spec, genes(9), folder)
    out = evaluated.evaluate(bars, spec, genes(24), folder)
    return out.select("gene_id", F.round("fitness", 4).alias("fitness"), F.get_json_object("metrics", "$.trades").cast("long").alias("trades"), "known")
