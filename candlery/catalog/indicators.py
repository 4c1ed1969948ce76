"""Indicators, and the entry, filter and regime rules made of them."""

from __future__ import annotations

import json

from pyspark.sql import Window as W, functions as F

from ..operators import blocks as B, indicators as I
from ..operators.blocks import C, H, L, V
from ..operators.candles import indexed
from . import DAILY, HOURLY, ORACLES, query
from .bars import ASOF, daily, hourly, rounded

P = "partition by symbol order by bar_ts"


def frame(n: int, last: str = "current row") -> str:
    return f"over ({P} rows between {n - 1} preceding and {last})"


def full(n: int, x: str, col: str = "close") -> str:
    return f"case when count({col}) {frame(n)} = {n} then {x} end"


SMA = lambda n, col="close": full(n, f"avg({col}) {frame(n)}", col)
SD = lambda n, col="close": full(n, f"stddev_pop({col}) {frame(n)}", col)


def simple(name, sql, build, base=None):
    """A query of one value by bar: build() is the column, sql the same in SQL over hourly bars."""

    @query(name, f"with {HOURLY} select symbol, bar_ts, round({sql}, 6) as v from hourly")
    def _(spark, d):
        bars = indexed(hourly(spark, d)) if base else hourly(spark, d)
        return bars.select("symbol", "bar_ts", F.round(build(), 6).alias("v"))


simple("ind_01_sma", SMA(20), lambda: I.sma(C(), 20))
simple("ind_07_stdev", SD(20), lambda: I.stdev(C(), 20))
simple("ind_11_highest", f"case when count(*) {frame(20)} = 20 then max(high) {frame(20)} end", lambda: I.highest(H(), 20))
simple("ind_12_lowest", f"case when count(*) {frame(20)} = 20 then min(low) {frame(20)} end", lambda: I.lowest(L(), 20))
simple("ind_14_vwap", f"case when count(volume) {frame(20)} = 20 and sum(volume) {frame(20)} > 0 then sum((high+low+close)/3*volume) {frame(20)} / nullif(sum(volume) {frame(20)}, 0) end", lambda: I.vwap(H(), L(), C(), V(), 20))
simple("ind_19_lag", f"close - lag(close, 3) over ({P})", lambda: C() - F.lag(C(), 3).over(I.series()))
simple("ind_23_running_peak", f"max(close) over ({P}) - close", lambda: F.max(C()).over(I.series().rowsBetween(W.unboundedPreceding, 0)) - C())
simple("ind_05_true_range", f"case when lag(close) over ({P}) is null then high - low else greatest(high - low, abs(high - lag(close) over ({P})), abs(low - lag(close) over ({P}))) end", lambda: I.true_range(H(), L(), C()))
STOCH = f"""case when count(*) {frame(14)} = 14 then case when max(high) {frame(14)} = min(low) {frame(14)} then 50.0 else (close - min(low) {frame(14)})/(max(high) {frame(14)} - min(low) {frame(14)})*100 end end"""
simple("ind_04_stoch", STOCH, lambda: I.stoch(C(), H(), L(), 14))
simple("ind_08_percentrank", f"case when count(close) over ({P} rows between 20 preceding and 1 preceding) = 20 then len(list_filter(array_agg(close) over ({P} rows between 20 preceding and 1 preceding), lambda x: x < close))/20.0*100 end", lambda: I.percent_rank(C(), 20))


@query("ind_09_crossover", f"with {HOURLY}, m as (select *, {SMA(5)} as a, {SMA(20)} as b from hourly) select symbol, bar_ts, coalesce(a > b and lag(a) over ({P}) <= lag(b) over ({P}), false) as up from m")
def _(spark, d):
    m = hourly(spark, d).withColumns({"a": I.sma(C(), 5), "b": I.sma(C(), 20)})
    return m.select("symbol", "bar_ts", I.cross_over(F.col("a"), F.col("b")).alias("up"))


@query("ind_10_crossunder", f"with {HOURLY}, m as (select *, {SMA(5)} as a, {SMA(20)} as b from hourly) select symbol, bar_ts, coalesce(a < b and lag(a) over ({P}) >= lag(b) over ({P}), false) as down from m")
def _(spark, d):
    m = hourly(spark, d).withColumns({"a": I.sma(C(), 5), "b": I.sma(C(), 20)})
    return m.select("symbol", "bar_ts", I.cross_under(F.col("a"), F.col("b")).alias("down"))


@query("ind_15_bollinger", f"with {HOURLY}, m as (select *, {SMA(20)} as b, {SD(20)} as sd from hourly) select symbol, bar_ts, round(b, 6) as basis, round(b + 2*sd, 6) as upper, round(b - 2*sd, 6) as lower, round(4*sd/nullif(b, 0)*100, 6) as width from m")
def _(spark, d):
    m = hourly(spark, d).withColumns({"b": I.sma(C(), 20), "sd": I.stdev(C(), 20)})
    b, sd = F.col("b"), F.col("sd")
    return m.select("symbol", "bar_ts", *(F.round(x, 6).alias(n) for n, x in (("basis", b), ("upper", b + 2 * sd), ("lower", b - 2 * sd), ("width", 4 * sd / F.nullif(b, F.lit(0.0)) * 100))))


@query("ind_16_rank_with_current", f"""with {HOURLY}, m as (select *, row_number() over ({P}) - 1 as i, {full(20, f"round(stddev_pop(close) {frame(20)}, 9)")} as w from hourly)
select symbol, bar_ts, round(case when i >= 100 and w is not null then len(list_filter(array_agg(w) filter (where w is not null) over ({P} rows between 99 preceding and current row), lambda x: x < w))*100.0/nullif(count(w) over ({P} rows between 99 preceding and current row), 0) end, 6) as v from m""")
def _(spark, d):
    m = indexed(hourly(spark, d)).withColumn("w", F.round(I.stdev(C(), 20), 9))
    return m.select("symbol", "bar_ts", F.round(I.rank_with_current(F.col("w"), 100, F.col("i")), 6).alias("v"))


@query("ind_17_rank_null_tolerant", f"""with {HOURLY}, m as (select *, row_number() over ({P}) - 1 as i, {full(30, "high - low")} as w from hourly)
select symbol, bar_ts, round(case when i >= 50 and w is not null then len(list_filter(coalesce(array_agg(w) filter (where w is not null) over ({P} rows between 50 preceding and 1 preceding), []), lambda x: x < w))/50.0*100 end, 6) as v from m""")
def _(spark, d):
    m = indexed(hourly(spark, d)).withColumn("w", F.when(F.count(C()).over(I.rows(30)) == 30, H() - L()))
    return m.select("symbol", "bar_ts", F.round(I.rank_null_tolerant(F.col("w"), 50, F.col("i")), 6).alias("v"))


@query("ind_18_smoothed_stoch", f"with {HOURLY}, s as (select *, {STOCH} as s from hourly), k as (select *, {SMA(3, 's')} as k from s) select symbol, bar_ts, round(k, 6) as k, round({SMA(3, 'k')}, 6) as d from k")
def _(spark, d):
    m = hourly(spark, d).withColumn("s", I.stoch(C(), H(), L(), 14))
    m = m.withColumn("k", I.sma(F.col("s"), 3)).withColumn("d", I.sma(F.col("k"), 3))
    return rounded(m.select("symbol", "bar_ts", "k", "d"), "k", "d")


@query("ind_20_any_recent", f"with {HOURLY} select symbol, bar_ts, max(close > open) {frame(5)} as v from hourly")
def _(spark, d):
    return hourly(spark, d).select("symbol", "bar_ts", I.any_recent(C() > F.col("open"), 5).alias("v"))


@query("ind_21_bar_index", f"with {HOURLY} select symbol, bar_ts, row_number() over ({P}) - 1 as i from hourly")
def _(spark, d):
    return indexed(hourly(spark, d)).select("symbol", "bar_ts", "i")


@query("ind_22_slope", f"with {DAILY} select symbol, bar_ts, round((close - lag(close, 5) over ({P}))/nullif(close, 0), 6) as slope from daily")
def _(spark, d):
    from ..operators.joins import slope

    return daily(spark, d).select("symbol", "bar_ts", F.round(slope(C(), 5), 6).alias("slope"))


def numbered(rel="hourly"):
    return f"n as (select *, row_number() over ({P}) - 1 as i, lag(close) over ({P}) as pc, lag(high) over ({P}) as ph, lag(low) over ({P}) as pl from {rel})"


def ema_cte(name: str, n: int, source: str = "n", col: str = "close") -> str:
    k = 2 / (n + 1)
    return f"""{name} as (select symbol, cast({n - 1} as bigint) as i, avg({col}) as v from {source} where i < {n} group by symbol having count(*) = {n}
 union all select r.symbol, r.i + 1, x.{col}*{k!r} + r.v*(1-{k!r}) from {name} r join {source} x on x.symbol = r.symbol and x.i = r.i + 1)"""


TR = "case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end"


def rma_cte(name: str, n: int, x: str, first: int) -> str:
    return f"""{name} as (select symbol, cast({first} as bigint) as i, avg({x}) as v from n where i > {first - n} and i <= {first} group by symbol having count(*) = {n}
 union all select r.symbol, r.i + 1, (r.v*{n - 1} + ({x}))/{n} from {name} r join n on n.symbol = r.symbol and n.i = r.i + 1)"""


UP, DOWN = "(case when close > pc then close - pc else 0 end)", "(case when close < pc then pc - close else 0 end)"
RSI = f"{rma_cte('ru', 14, UP, 14)}, {rma_cte('rd', 14, DOWN, 14)}, rsi as (select ru.symbol, ru.i, case when rd.v = 0 then 100.0 else 100 - 100/(1 + ru.v/rd.v) end as v from ru join rd on ru.symbol = rd.symbol and ru.i = rd.i)"
ADX = """m as (select symbol, bar_ts, i, case when i = 0 then 0.0 when high - ph > pl - low and high - ph > 0 then high - ph else 0 end as p, case when i = 0 then 0.0 when pl - low > high - ph and pl - low > 0 then pl - low else 0 end as q,
 case when i = 0 then 0.0 else greatest(high - low, abs(high - pc), abs(low - pc)) end as t from n),
s as (select symbol, cast(14 as bigint) as i, sum(p) as p, sum(q) as q, sum(t) as t from m where i between 1 and 14 group by symbol having count(*) = 14
 union all select s.symbol, s.i + 1, s.p - s.p/14 + m.p, s.q - s.q/14 + m.q, s.t - s.t/14 + m.t from s join m on m.symbol = s.symbol and m.i = s.i + 1),
x as (select symbol, i, case when t <> 0 and p/t + q/t <> 0 then 100*abs(p/t - q/t)/(p/t + q/t) end as dx from s),
adx as (select symbol, cast(27 as bigint) as i, avg(dx) as v from x where i between 14 and 27 group by symbol having count(*) = 14
 union all select a.symbol, a.i + 1, case when x.dx is null then a.v else (a.v*13 + x.dx)/14 end from adx a join x on x.symbol = a.symbol and x.i = a.i + 1)"""


def recursive(name, kind, n, ctes):
    @query(name, f"with recursive {HOURLY}, {numbered()}, {ctes} select n.symbol, n.bar_ts, round(r.v, 6) as v from n left join {kind} r on r.symbol = n.symbol and r.i = n.i")
    def _(spark, d):
        return I.with_recursive(hourly(spark, d), {"v": (kind, n)}).select("symbol", "bar_ts", F.round("v", 6).alias("v"))


recursive("ind_02_ema", "ema", 10, ema_cte("ema", 10))
recursive("ind_03_rsi", "rsi", 14, RSI)
recursive("ind_06_atr", "atr", 14, rma_cte("atr", 14, f"({TR})", 13))
recursive("ind_13_adx", "adx", 14, ADX)


def rule(name, build, sql):
    """A rule's two sides by bar."""

    @query(name, sql)
    def _(spark, d):
        return build(hourly(spark, d)).select("symbol", "bar_ts", F.col("x_long").alias("long"), F.col("x_short").alias("short"))


def sides(long, short, source):
    return f"select symbol, bar_ts, coalesce({long}, false) as long, coalesce({short}, false) as short from {source}"


rule("en_01_stoch_cross", lambda b: B.stoch_cross(b, name="x"), f"""with {HOURLY}, s as (select *, {STOCH} as s from hourly), k as (select *, {SMA(3, 's')} as k from s), e as (select *, {SMA(3, 'k')} as d from k),
f as (select *, lag(k) over ({P}) as k1, lag(d) over ({P}) as d1 from e) {sides('k > d and k1 <= d1 and k < 30', 'k < d and k1 >= d1 and k > 70', 'f')}""")
TWO_EMAS = f"with recursive {HOURLY}, {numbered()}, {ema_cte('f', 10)}, {ema_cte('w', 30)}, j as (select n.*, f.v as f, w.v as w from n left join f on f.symbol = n.symbol and f.i = n.i left join w on w.symbol = n.symbol and w.i = n.i)"
rule("en_02_ema_trend", lambda b: B.ema_trend(b, name="x"), f"{TWO_EMAS} {sides('f > w', 'f < w', 'j')}")
rule("en_03_squeeze_breakout", lambda b: B.squeeze_breakout(b, name="x"), f"""with {HOURLY}, m as (select *, row_number() over ({P}) - 1 as i, {SMA(20)} as b, {SD(20)} as sd from hourly),
w as (select *, case when b > 0 then 2*2.0*sd/b*100 end as w from m),
r as (select *, case when i >= 100 and w is not null then len(list_filter(array_agg(w) filter (where w is not null) over ({P} rows between 99 preceding and current row), lambda x: x < w))*100.0/nullif(count(w) over ({P} rows between 99 preceding and current row), 0) end as r from w),
q as (select *, max(coalesce(r < 25, false)) {frame(5)} as q from r) {sides('q and close > b', 'q and close < b', 'q')}""")
rule("en_04_rsi_pullback", lambda b: B.rsi_pullback(b, name="x"), f"""with recursive {HOURLY}, {numbered()}, {RSI}, j as (select n.*, r.v as r from n left join rsi r on r.symbol = n.symbol and r.i = n.i), k as (select *, lag(r) over ({P}) as r1 from j)
{sides('r1 <= 40 and r > 40', 'r1 >= 60 and r < 60', 'k')}""")
rule("en_05_ma_pullback", lambda b: B.ma_pullback(b, name="x"), f"{TWO_EMAS} {sides('f > w and low <= f and close > f', 'f < w and high >= f and close < f', 'j')}")
BEFORE = f"over ({P} rows between 20 preceding and 1 preceding)"
rule("en_06_donchian", lambda b: B.donchian(b, name="x"), f"with {HOURLY} {sides(f'count(*) {BEFORE} = 20 and close > max(high) {BEFORE}', f'count(*) {BEFORE} = 20 and close < min(low) {BEFORE}', 'hourly')}")
rule("en_07_volume_surge", lambda b: B.volume_surge(b, name="x"), f"with {HOURLY}, m as (select *, {SMA(20, 'volume')} as m from hourly) {sides('volume >= 1.5*m and close > open', 'volume >= 1.5*m and close < open', 'm')}")
HTF_EMA = f"""h as (select symbol, (bar_ts//14400000)*14400000 as bar_ts, last(close order by bar_ts) as close from hourly group by 1, 2), hn as (select *, row_number() over ({P}) - 1 as i from h), {ema_cte('he', 10, 'hn')},
hv as (select hn.symbol, hn.bar_ts as hts, hn.close as hc, he.v as ma from hn left join he on he.symbol = hn.symbol and he.i = hn.i)"""
rule("fi_01_htf_trend", lambda b: B.htf_trend_filter(b, name="x"), f"with recursive {HOURLY}, {HTF_EMA}, j as (select b.*, hc, ma from hourly b asof left join hv on b.symbol = hv.symbol and b.bar_ts >= hv.hts + 14400000) {sides('ma is null or hc > ma', 'ma is null or hc < ma', 'j')}")
ATR14 = rma_cte("atr", 14, f"({TR})", 13)
rule("fi_02_volatility_floor", lambda b: B.volatility_floor(b, least=60, name="x"), f"with recursive {HOURLY}, {numbered()}, {ATR14}, j as (select n.*, r.v as a from n left join atr r on r.symbol = n.symbol and r.i = n.i) {sides('a/nullif(close, 0)*100 >= 60', 'a/nullif(close, 0)*100 >= 60', 'j')}")
rule("fi_03_volume_filter", lambda b: B.volume_filter(b, name="x"), f"with {HOURLY}, m as (select *, {SMA(20, 'volume')} as m from hourly) {sides('m > 0 and volume >= 0.8*m', 'm > 0 and volume >= 0.8*m', 'm')}")
VOL = f"""{numbered()}, {ATR14}, a as (select n.symbol, n.bar_ts, n.i, r.v as a from n left join atr r on r.symbol = n.symbol and r.i = n.i),
r as (select *, case when i >= 50 and a is not null then len(list_filter(coalesce(array_agg(a) filter (where a is not null) over ({P} rows between 50 preceding and 1 preceding), []), lambda x: x < a))/50.0*100 end as r from a),
g as (select *, case when r > 70 then 'high' when r < 30 then 'low' when r is not null then 'normal' end as regime from r)"""
rule("fi_04_regime_gate", lambda b: B.regime_gate(B.vol_regime(b), " high , normal", "*", name="x"), f"with recursive {HOURLY}, {VOL} {sides('''regime in ('high', 'normal')''', 'true', 'g')}")


@query("re_01_htf_trend_regime", f"""with recursive {HOURLY}, {HTF_EMA}, s as (select *, lag(ma, 3) over (partition by symbol order by hts) as past from hv), t as (select *, (ma - past)/nullif(ma, 0) as sl from s)
select b.symbol, b.bar_ts, case when sl > 0.01 then 'bull' when sl < -0.01 then 'bear' when sl is not null then 'chop' end as regime from hourly b asof left join t on b.symbol = t.symbol and b.bar_ts >= t.hts + 14400000""")
def _(spark, d):
    return B.htf_trend_regime(hourly(spark, d)).select("symbol", "bar_ts", "regime")


@query("ga_20_dependencies", f"""with recursive {HOURLY}, {HTF_EMA}, s as (select *, lag(ma, 3) over (partition by symbol order by hts) as past from hv), {numbered()}, {ema_cte('f', 10)},
j as (select b.*, hc, ma, past from hourly b asof left join s on b.symbol = s.symbol and b.bar_ts >= s.hts + 14400000)
select j.symbol, j.bar_ts, ma is null or hc > ma as long, case when (ma - past)/nullif(ma, 0) > 0.01 then 'bull' when (ma - past)/nullif(ma, 0) < -0.01 then 'bear' when (ma - past)/nullif(ma, 0) is not null then 'chop' end as regime, round(f.v, 6) as ema
from j join n using (symbol, bar_ts) left join f on f.symbol = n.symbol and f.i = n.i""")
def _(spark, d):
    """A filter, a regime and an average over the same bars: one longer timeframe, resolved once for both."""
    from ..operators.dependencies import column_of, with_dependencies

    bars = with_dependencies(hourly(spark, d), [*B.htf_deps(240, 10), *B.htf_deps(240, 10, 3), ("ema", 10)], base=60)
    bars = B.htf_trend_regime(B.htf_trend_filter(bars, name="x"))
    return bars.select("symbol", "bar_ts", F.col("x_long").alias("long"), "regime", F.round(column_of(("ema", 10)), 6).alias("ema"))


@query("re_02_vol_regime", f"with recursive {HOURLY}, {VOL} select symbol, bar_ts, regime from g")
def _(spark, d):
    return B.vol_regime(hourly(spark, d)).select("symbol", "bar_ts", "regime")


@query("re_03_range_regime", f"with recursive {HOURLY}, {numbered()}, {ADX} select n.symbol, n.bar_ts, case when v > 25 then 'trending' when v is not null then 'ranging' end as regime from n left join adx r on r.symbol = n.symbol and r.i = n.i")
def _(spark, d):
    return B.range_regime(hourly(spark, d)).select("symbol", "bar_ts", "regime")


ENTRIES = f"""with {HOURLY}, m as (select *, {SMA(5)} as a, {SMA(20)} as b, {SMA(20, 'volume')} as vm from hourly),
e as (select *, coalesce(a > b, false)::int as t_long, coalesce(a < b, false)::int as t_short, (count(*) {BEFORE} = 20 and close > max(high) {BEFORE})::int as d_long, (count(*) {BEFORE} = 20 and close < min(low) {BEFORE})::int as d_short,
 coalesce(volume >= 1.5*vm and close > open, false)::int as s_long, coalesce(volume >= 1.5*vm and close < open, false)::int as s_short, coalesce(vm > 0 and volume >= 0.8*vm, false) as f from m)"""


def with_votes(spark, d):
    b = hourly(spark, d).withColumns({"a": I.sma(C(), 5), "b": I.sma(C(), 20)})
    b = B.put(b, "t", F.col("a") > F.col("b"), F.col("a") < F.col("b"))
    return B.volume_filter(B.volume_surge(B.donchian(b, name="d"), name="s"), name="f")


@query("ag_01_entry_votes", f"{ENTRIES} select symbol, bar_ts, t_long + d_long + s_long >= 2 as score_long, t_long + d_long + s_long = 3 as all_long, t_short + d_short + s_short > 0 as any_short from e")
def _(spark, d):
    names = ["t", "d", "s"]
    return with_votes(spark, d).select("symbol", "bar_ts", B.entry_ok(names, "long", "score", 2).alias("score_long"), B.entry_ok(names, "long", "all").alias("all_long"), B.entry_ok(names, "short", "any").alias("any_short"))


@query("ag_02_filter_votes", f"{ENTRIES} select symbol, bar_ts, f as all_long, f or t_long = 1 as any_long, true as none_long from e")
def _(spark, d):
    return with_votes(spark, d).select("symbol", "bar_ts", B.filter_ok(["f"], "long").alias("all_long"), B.filter_ok(["f", "t"], "long", "any").alias("any_long"), B.filter_ok([], "long").alias("none_long"))


@query("ag_03_direction", f"{ENTRIES} select symbol, bar_ts, case when f and t_long + d_long + s_long >= 1 then 1 when f and t_short + d_short + s_short >= 1 then -1 else 0 end as direction from e")
def _(spark, d):
    return with_votes(spark, d).select("symbol", "bar_ts", B.direction(["t", "d", "s"], ["f"]).alias("direction"))


@query("m0_signal_counts", f"""{ENTRIES}, h as (select symbol, (bar_ts//14400000)*14400000 as hts, last(close order by bar_ts) as hc from hourly group by 1, 2),
j as (select e.*, h.hc from e asof left join h on e.symbol = h.symbol and e.bar_ts >= h.hts + 14400000)
select symbol, count(*) filter (where f and t_long + d_long + s_long >= 2 and coalesce(close > hc, true)) as longs, count(*) filter (where f and t_short + d_short + s_short >= 2 and coalesce(close < hc, true)) as shorts, count(*) as bars from j group by 1""")
def _(spark, d):
    from ..operators.candles import roll_up_bars
    from ..operators.joins import asof_closed

    bars = with_votes(spark, d)
    htf = roll_up_bars(hourly(spark, d), 240).select("symbol", "bar_ts", F.col("close").alias("hc"))
    bars = asof_closed(bars, htf, 240, ["hc"])
    up = B.entry_ok(["t", "d", "s"], "long", "score", 2) & F.col("f_long") & F.coalesce(C() > F.col("hc"), F.lit(True))
    down = B.entry_ok(["t", "d", "s"], "short", "score", 2) & F.col("f_short") & F.coalesce(C() < F.col("hc"), F.lit(True))
    return bars.groupBy("symbol").agg(F.count_if(up).alias("longs"), F.count_if(down).alias("shorts"), F.count("*").alias("bars"))


def through_sql(name, rule, block, params):
    """A rule's query again, by the table function of SQL."""

    @query(f"udf_11_{name}", ORACLES[rule])
    def _(spark, d):
        from ..plans import sqlblocks

        sqlblocks.register(spark)
        return spark.sql("select * from block(table({bars}), :block, :params)", {"block": block, "params": json.dumps(params)}, bars=hourly(spark, d))


for _name, _rule, _block, _params in [
    ("stoch_cross", "en_01_stoch_cross", "stochCross", {"stochLen": 14, "stochSmth": 3, "longLevel": 30, "shortLevel": 70}),
    ("ema_trend", "en_02_ema_trend", "emaTrend", {"emaFast": 10, "emaSlow": 30}),
    ("rsi_pullback", "en_04_rsi_pullback", "rsiPullback", {"rsiLen": 14, "longLevel": 40, "shortLevel": 60}),
    ("ma_pullback", "en_05_ma_pullback", "maPullback", {"emaFast": 10, "emaSlow": 30}),
    ("donchian", "en_06_donchian", "donchianBreakout", {"period": 20}),
    ("volume_surge", "en_07_volume_surge", "volumeSurge", {"volLen": 20, "multiplier": 1.5}),
    ("volume_filter", "fi_03_volume_filter", "volumeFilter", {"volLen": 20, "minMultiplier": 0.8}),
    ("range_regime", "re_03_range_regime", "rangeRegime", {"adxLen": 14, "adxThreshold": 25}),
]:
    through_sql(_name, _rule, _block, _params)
