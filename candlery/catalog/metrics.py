"""Metrics of trades, sizing rules and reports."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import metrics as M, sizing as S
from ..sources.tables import EXIT_ORDER, table, trades_lineitem
from . import DAILY, EXIT, TRADES, query
from .bars import daily, rounded

PF = "case when sum({l}) > 0 then sum({g})/sum({l}) when sum({g}) > 0 then cast('inf' as double) else 0.0 end"
GP, GL = "coalesce(sum(pnl) filter (where pnl > 0), 0.0)", "coalesce(sum(abs(pnl)) filter (where pnl <= 0), 0.0)"
PFX = f"case when {GL} > 0 then {GP}/{GL} when {GP} > 0 then cast('inf' as double) else 0.0 end"
ORDER = f"over (partition by strategy order by {EXIT} rows between unbounded preceding and current row)"
PRIOR = f"over (partition by strategy order by {EXIT} rows between unbounded preceding and 1 preceding)"
KEYS = ["strategy", *EXIT_ORDER]


def trades(spark, d):
    return trades_lineitem(spark, d)


@query("agg_05_totals", f"with {TRADES} select strategy, count(*) as trades, count(*) filter (where pnl > 0) as wins, round({GP}, 4) as gross_profit, round({GL}, 4) as gross_loss from trades group by 1")
def _(spark, d):
    return rounded(M.trade_totals(trades(spark, d), "strategy"), "gross_profit", "gross_loss", places=4)


@query("agg_06_ratios", f"with {TRADES} select k4 as strategy, round(count(*) filter (where pnl > 0)/count(*)*100, 6) as win_rate, round({PFX}, 6) as pf from trades group by 1")
def _(spark, d):
    t = trades(spark, d).drop("strategy").withColumnRenamed("k4", "strategy")
    return rounded(M.with_ratios(M.trade_totals(t, "strategy")).select("strategy", "win_rate", "pf"), "win_rate", "pf")


@query("agg_07_by_regime", f"with {TRADES} select strategy, coalesce(regime, '_unknown') as regime, count(*) as trades, count(*) filter (where pnl > 0) as wins, round({PFX}, 6) as pf, round({GP} - {GL}, 4) as net from trades group by 1, 2")
def _(spark, d):
    return M.by_regime(trades(spark, d), "strategy").select("strategy", "regime", "trades", "wins", F.round("pf", 6).alias("pf"), F.round("net", 4).alias("net"))


@query("agg_08_sharpe", f"with {TRADES} select k4, round(case when count(*) > 1 and stddev_samp(pnl/100000.0) > 0 then avg(pnl/100000.0)/stddev_samp(pnl/100000.0)*sqrt(count(*)) else 0 end, 6) as sharpe from trades group by 1")
def _(spark, d):
    return trades(spark, d).groupBy("k4").agg(F.round(M.sharpe(100_000.0), 6).alias("sharpe"))


CURVE = f"{TRADES}, curve as (select *, 100000.0 + sum(pnl) {ORDER} as equity from trades)"


@query("agg_09_drawdown", f"with {CURVE}, p as (select strategy, equity, max(equity) {ORDER} as peak from curve) select strategy, round(max(peak - equity), 4) as max_dd, round(max((peak - equity)/nullif(peak, 0)), 6) as max_dd_pct from p group by 1")
def _(spark, d):
    curve = M.equity_curve(trades(spark, d), "strategy", EXIT_ORDER, 100_000.0, keep_stretches=True)
    return M.drawdown(curve, "strategy", EXIT_ORDER).select("strategy", F.round("max_dd", 4).alias("max_dd"), F.round("max_dd_pct", 6).alias("max_dd_pct"))


@query("agg_10_cagr", "select c_custkey, round(case when c_nationkey > 0 and c_acctbal/10000 > -1 then pow(1 + c_acctbal/10000, 1.0/c_nationkey) - 1 else c_acctbal/10000 end, 6) as cagr from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(M.cagr(F.col("c_acctbal") / 10000, F.col("c_nationkey").cast("double")), 6).alias("cagr"))


WINDOWS = f"windows as (select strategy, k2 as win, regime, count(*) as trades, count(*) filter (where pnl > 0) as wins, {PFX} as pf, {GP} as gross_profit, case when regime = 'N' and k2 = 3 then null else {GL} end as gross_loss from trades where regime is not null group by 1, 2, 3)"


def windows(spark, d):
    w = M.with_ratios(trades(spark, d).where("regime is not null").groupBy("strategy", F.col("k2").alias("win"), "regime").agg(*M.totals()))
    return w.withColumn("gross_loss", F.when(~((F.col("regime") == "N") & (F.col("win") == 3)), F.col("gross_loss")))


@query("agg_11_pooled", f"""with {TRADES}, {WINDOWS} select strategy, regime, sum(trades) as trades, sum(wins) as wins,
round(case when count(*) filter (where gross_loss is null) > 0 then sum(trades*pf)/sum(trades) when sum(gross_loss) > 0 then sum(gross_profit)/sum(gross_loss) when sum(gross_profit) > 0 then cast('inf' as double) else 0 end, 6) as pf from windows group by 1, 2""")
def _(spark, d):
    return rounded(M.pooled(windows(spark, d), "strategy", "regime"), "pf")


@query("agg_12_worst_regime", f"with {TRADES}, {WINDOWS} select strategy, win, round(min(pf), 6) as worst_pf from windows where trades >= 5 and isfinite(pf) group by 1, 2")
def _(spark, d):
    return rounded(M.worst_regime(windows(spark, d), "strategy", "win"), "worst_pf")


@query("flt_09_regime_sample", f"with {TRADES}, {WINDOWS} select strategy, win, regime, trades from windows where trades >= 5 and isfinite(pf)")
def _(spark, d):
    w = windows(spark, d)
    return w.where((F.col("trades") >= 5) & (F.abs("pf") < float("inf"))).select("strategy", "win", "regime", "trades")


@query("flt_07_min_trades", "select l_suppkey, count(*) as trades from lineitem group by 1 having count(*) >= 30")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("trades")).where("trades >= 30")


@query("flt_08_cache_validity", "select c_custkey from customer where c_acctbal is not null and isfinite(c_acctbal) and c_acctbal > 0")
def _(spark, d):
    from ..functions.scalars import finite

    return table(spark, d, "customer").where(finite(F.col("c_acctbal")) & (F.col("c_acctbal") > 0)).select("c_custkey")


WF = "wf as (select o_custkey % 40 as run, o_orderkey % 5 as win, sum(case when o_orderstatus = 'F' then 1 else 0 end) as is_trades, avg(o_totalprice)/100000 - 0.5 as is_pf, min(o_totalprice)/100000 as oos_pf from orders group by 1, 2)"


def wf(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("run"), (F.col("o_orderkey") % 5).alias("win")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("is_trades"), (F.avg("o_totalprice") / 100000 - 0.5).alias("is_pf"), (F.min("o_totalprice") / 100000).alias("oos_pf"))


@query("agg_13_walk_forward", f"with {WF} select run, round(avg(is_pf) filter (where is_trades > 0 and is_pf > 0), 6) as mean_is, round(avg(oos_pf) filter (where is_trades > 0 and is_pf > 0), 6) as mean_oos, count(*) filter (where is_trades > 0 and is_pf > 0) as valid, round(avg(oos_pf) filter (where is_trades > 0 and is_pf > 0)/nullif(avg(is_pf) filter (where is_trades > 0 and is_pf > 0), 0), 6) as wfe from wf group by 1")
def _(spark, d):
    return rounded(M.walk_forward_means(wf(spark, d), "run"), "mean_is", "mean_oos", "wfe")


MONTHS = f"""{CURVE}, ends as (select strategy, year(make_timestamp(exit_ms*1000)) as year, month(make_timestamp(exit_ms*1000)) as month, last(equity order by {EXIT}) as "end" from curve group by 1, 2, 3),
months as (select *, coalesce(lag("end") over (partition by strategy order by year, month), 100000.0) as start from ends)"""


def months(spark, d):
    return M.monthly(M.equity_curve(trades(spark, d), "strategy", EXIT_ORDER, 100_000.0), "strategy", "exit_ms", EXIT_ORDER, 100_000.0)


@query("agg_14_monthly", f"""with {MONTHS} select strategy, year, month, round(start, 4) as start, round("end", 4) as finish, round(("end" - start)/nullif(start, 0)*100, 6) as pct from months""")
def _(spark, d):
    return months(spark, d).select("strategy", "year", "month", F.round("start", 4).alias("start"), F.round("end", 4).alias("finish"), F.round("pct", 6).alias("pct"))


@query("agg_14_yearly", f"""with {MONTHS}, y as (select strategy, year, first(start order by month) as start, last("end" order by month) as e from months group by 1, 2) select strategy, year, round((e - start)/nullif(start, 0)*100, 6) as pct from y""")
def _(spark, d):
    return M.yearly(months(spark, d), "strategy").select("strategy", "year", F.round("pct", 6).alias("pct"))


@query("rp_05_month_grid", f"""with {MONTHS}, p as (select strategy, year, month, round(("end" - start)/nullif(start, 0)*100, 6) as pct from months) select strategy, year, """ + ", ".join(f"max(pct) filter (where month = {m}) as m{m:02d}" for m in range(1, 13)) + " from p group by 1, 2")
def _(spark, d):
    return M.month_grid(months(spark, d).withColumn("pct", F.round("pct", 6)), "strategy")


@query("agg_15_buy_and_hold", f"with {DAILY} select symbol, year(make_timestamp(bar_ts*1000)) as year, round((last(close order by bar_ts) - first(open order by bar_ts))/nullif(first(open order by bar_ts), 0)*100, 6) as hold_pct from daily group by 1, 2")
def _(spark, d):
    return rounded(M.buy_and_hold(daily(spark, d)), "hold_pct")


@query("agg_16_signals", "select case l_shipmode when 'x' then 'y' else l_shipmode end as signal, n from (select case l_returnflag when 'A' then 'SL' when 'R' then 'SL' else l_returnflag end as l_shipmode, count(*) as n from lineitem group by 1)")
def _(spark, d):
    return M.signal_counts(table(spark, d, "lineitem"), "l_returnflag", {"A": "SL", "R": "SL"})


@query("agg_17_slippage", """with r as (select l_suppkey as k, l_extendedprice as x, row_number() over (partition by l_suppkey order by l_extendedprice) - 1 as i, count(*) over (partition by l_suppkey) as n from lineitem)
select k, round(avg(x), 4) as mean, max(x) filter (where i = floor(n*0.5)) as median, max(x) filter (where i = floor(n*0.1)) as p10, max(x) filter (where i = floor(n*0.9)) as p90, min(x) as least, max(x) as most from r group by 1""")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("x"))
    return rounded(M.distribution(x, "k", "x"), "mean", places=4)


@query("agg_19_diversity", "with p as (select p_brand as island, 'size' as param, stddev_pop(p_size)/50.0 as s from part group by 1 union all select p_brand, 'price', stddev_pop(p_retailprice)/2000.0 from part group by 1) select island, round(avg(s), 6) as diversity from p group by 1")
def _(spark, d):
    p = table(spark, d, "part")
    genes = p.select(F.col("p_brand").alias("island"), F.inline(F.array(
        F.struct(F.lit("size").alias("param"), F.col("p_size").cast("double").alias("value"), F.lit(0.0).alias("low"), F.lit(50.0).alias("high")),
        F.struct(F.lit("price").alias("param"), F.col("p_retailprice").alias("value"), F.lit(0.0).alias("low"), F.lit(2000.0).alias("high")))))
    return rounded(M.diversity(genes, "island"), "diversity")


@query("agg_20_planet_best", "select s_nationkey as planet, max(s_acctbal) as fitness, arg_max(s_suppkey, s_acctbal) as gene from supplier group by 1")
def _(spark, d):
    best = F.max_by(F.struct(F.col("s_acctbal").alias("fitness"), F.col("s_suppkey").alias("gene")), F.col("s_acctbal"))
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("planet")).agg(best.alias("b")).select("planet", "b.*")


@query("agg_21_unique_entries", "select l_returnflag, count(distinct l_shipdate) as entries from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_shipdate").alias("entries"))


@query("agg_22_commission", f"with {TRADES} select strategy, round(sum(units*(entry_price + entry_price*1.01)*0.0006), 4) as commission from trades group by 1")
def _(spark, d):
    paid = F.col("units") * (F.col("entry_price") + F.col("entry_price") * 1.01) * M.COMMISSION
    return trades(spark, d).groupBy("strategy").agg(F.round(F.sum(paid), 4).alias("commission"))


STREAKS = f"""{TRADES}, s as (select *, case when pnl > 0 then 1 when pnl < 0 then -1 end as s from trades),
l as (select *, last_value(s ignore nulls) {PRIOR} as prev from s), g as (select *, sum(case when s is not null and (prev is null or prev <> s) then 1 else 0 end) {ORDER} as g from l),
streaks as (select *, count(s) over (partition by strategy, g order by {EXIT} rows between unbounded preceding and current row) as streak, case last_value(s ignore nulls) over (partition by strategy, g order by {EXIT} rows between unbounded preceding and current row) when 1 then 'W' when -1 then 'L' end as kind from g)"""


@query("agg_23_streaks", f"with {STREAKS} select strategy, {EXIT}, streak, kind from streaks")
def _(spark, d):
    return M.streaks(trades(spark, d), "strategy", EXIT_ORDER).select(*KEYS, "streak", "kind")


STATS = f"""{TRADES}, stats as (select *, count(*) {PRIOR} as n_before, coalesce(count(*) filter (where pnl > 0) {PRIOR}/nullif(count(*) {PRIOR}, 0), 0) as win_rate, coalesce(avg(pnl) filter (where pnl > 0) {PRIOR}, 0) as avg_win,
 coalesce(avg(-pnl) filter (where pnl < 0) {PRIOR}, 0) as avg_loss, coalesce(max(pnl) filter (where pnl > 0) {PRIOR}, 0) as biggest_win, coalesce(max(-pnl) filter (where pnl < 0) {PRIOR}, 0) as biggest_loss, lag(pnl) over (partition by strategy order by {EXIT}) as last_pnl from trades)"""


@query("agg_24_running_stats", f"with {STATS} select strategy, {EXIT}, n_before, round(win_rate, 6) as win_rate, round(avg_win, 8) as avg_win, round(avg_loss, 8) as avg_loss, round(biggest_win, 6) as biggest_win, round(biggest_loss, 6) as biggest_loss, round(last_pnl, 6) as last_pnl from stats")
def _(spark, d):
    s = rounded(rounded(M.running_stats(trades(spark, d), "strategy", EXIT_ORDER), "win_rate", "biggest_win", "biggest_loss", "last_pnl"), "avg_win", "avg_loss", places=8)
    return s.select(*KEYS, "n_before", "win_rate", "avg_win", "avg_loss", "biggest_win", "biggest_loss", "last_pnl")


@query("po_02_sub_pnl", f"with {TRADES} select {EXIT}, round(units*(entry_price*1.01 - entry_price)*(case when k2 % 2 = 0 then 1 else -1 end) - units*(entry_price + entry_price*1.01)*0.0006, 8) as net from trades")
def _(spark, d):
    p = F.col("entry_price")
    return trades(spark, d).select(*EXIT_ORDER, F.round(M.sub_pnl(F.col("units"), p, p * 1.01, F.col("k2") % 2 == 0), 8).alias("net"))


@query("po_03_risk_share", f"with {TRADES} select {EXIT}, round(1000.0*units/nullif(sum(units) over (partition by k1), 0), 6) as risk from trades")
def _(spark, d):
    return trades(spark, d).select(*EXIT_ORDER, F.round(M.risk_share(F.lit(1000.0), F.col("units"), ["k1"]), 6).alias("risk"))


@query("po_04_leverage_cap", f"with {TRADES} select {EXIT}, round(least(units, 20000.0*2/nullif(entry_price, 0)), 6) as units from trades")
def _(spark, d):
    return trades(spark, d).select(*EXIT_ORDER, F.round(M.leverage_cap(F.col("units"), F.lit(20000.0), F.lit(2), F.col("entry_price")), 6).alias("units"))


def sizing(name, sql, build, source=TRADES, rel="trades", frame=None):
    @query(name, f"with {source} select strategy, {EXIT}, round({sql}, 6) as units from {rel}")
    def _(spark, d):
        t = frame(trades(spark, d)) if frame else trades(spark, d)
        return t.select(*KEYS, F.round(build(), 6).alias("units"))


E, PX = (lambda: F.col("pnl") * 0 + 50_000.0), (lambda: F.col("entry_price"))  # columns need a session, so made when called
EQ = "(pnl*0 + 50000.0)"
sizing("sz_01_flat", "case when entry_price > 0 then 1000.0/nullif(entry_price, 0) else 0 end", lambda: S.flat(E(), PX(), 1000.0))
sizing("sz_02_pct_of_equity", f"{EQ}*0.05/nullif(entry_price, 0)", lambda: S.pct_of_equity(E(), PX(), 5))
sizing("sz_03_pct_of_initial", "100000.0*0.05/nullif(entry_price, 0)", lambda: S.pct_of_initial(F.lit(100_000.0), PX(), 5))
sizing("sz_04_atr_risk", f"case when k2 - 2 > 0 then {EQ}*0.02/nullif(k2 - 2, 0) else 0 end", lambda: S.atr_risk(E(), (F.col("k2") - 2).cast("double"), 2))
sizing("sz_05_martingale", f"{EQ}*0.02*least(pow(2.0, case when kind = 'L' then streak else 0 end), 8.0)/nullif(entry_price, 0)", lambda: S.streak_scaled(E(), PX(), F.col("kind"), F.col("streak"), "L", 2, 2.0, 8.0), STREAKS, "streaks", lambda t: M.streaks(t, "strategy", EXIT_ORDER))
sizing("sz_06_anti_martingale", f"{EQ}*0.02*least(pow(1.5, case when kind = 'W' then streak else 0 end), 5.0)/nullif(entry_price, 0)", lambda: S.streak_scaled(E(), PX(), F.col("kind"), F.col("streak"), "W", 2, 1.5, 5.0), STREAKS, "streaks", lambda t: M.streaks(t, "strategy", EXIT_ORDER))
KELLY = "(avg_win/nullif(avg_loss, 0)*win_rate - (1 - win_rate))/nullif(avg_win/nullif(avg_loss, 0), 0)"
STATS_OF = lambda t: M.running_stats(t, "strategy", EXIT_ORDER)
sizing("sz_07_kelly", f"case when n_before < 20 or avg_loss <= 0 then {EQ}*0.01/nullif(entry_price, 0) when {KELLY} > 0 then {EQ}*least({KELLY}*0.5, 0.25)/nullif(entry_price, 0) else 0 end",
       lambda: S.kelly(E(), PX(), F.col("n_before"), F.col("win_rate"), F.col("avg_win"), F.col("avg_loss"), 0.5, 0.25, 20, 1), STATS, "stats", STATS_OF)
sizing("sz_08_fixed_fractional", f"{EQ}*0.1/greatest(biggest_loss, 100.0)", lambda: S.fixed_fractional(E(), PX(), F.col("biggest_loss"), 0.1, 100.0), STATS, "stats", STATS_OF)
CURVES = f"{TRADES}, c0 as (select *, 100000.0 + sum(pnl) {ORDER} as eq from trades), curves as (select *, count(*) over (partition by strategy order by {EXIT} rows between unbounded preceding and 1 preceding) as n, lag(eq) over (partition by strategy order by {EXIT}) as le, case when count(*) over (partition by strategy order by {EXIT} rows between 10 preceding and 1 preceding) = 10 then avg(eq) over (partition by strategy order by {EXIT} rows between 10 preceding and 1 preceding) end as me from c0)"


def curves(t):
    return M.recent_equity(t, "strategy", EXIT_ORDER, 100_000.0)


sizing("sz_09_equity_curve", f"{EQ}*(case when n < 20 or me is null then 2.0 when le > me then 4.0 else 1.0 end)/100/nullif(entry_price, 0)", lambda: S.equity_curve(E(), PX(), F.col("n_before"), F.col("last_equity"), F.col("mean_equity"), 2.0, 4.0, 1.0, 20), CURVES, "curves", curves)
sizing("sz_10_vol_target", f"case when k2 - 1 > 0 then least({EQ}*0.01/nullif(k2 - 1, 0), {EQ}*0.5/nullif(entry_price, 0)) else 0 end", lambda: S.vol_target(E(), PX(), (F.col("k2") - 1).cast("double"), 1, 50))


@query("rp_01_fitness_terms", "select c_custkey, t.name as term, round(t.norm*t.weight, 8) as contribution from customer, lateral (values ('pf', least(greatest(c_acctbal, 0)/4000, 1.0), 0.5), ('dd', 1 - c_nationkey/25.0, 0.3), ('ret', least(c_nationkey/10.0, 1.0), 0.2)) t(name, norm, weight)")
def _(spark, d):
    term = lambda n, x, w: F.struct(F.lit(n).alias("term"), x.alias("norm"), F.lit(w).alias("weight"))
    n = F.col("c_nationkey")
    terms = F.array(term("pf", F.least(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 4000, F.lit(1.0)), 0.5), term("dd", 1 - n / 25.0, 0.3), term("ret", F.least(n / 10.0, F.lit(1.0)), 0.2))
    return table(spark, d, "customer").select("c_custkey", F.inline(terms)).select("c_custkey", "term", F.round(F.col("norm") * F.col("weight"), 8).alias("contribution"))


@query("rp_02_window_rows", f"with {WF} select run, win, is_trades, round(is_pf, 6) as is_pf, round(oos_pf, 6) as oos_pf, round(oos_pf/nullif(is_pf, 0), 4) as ratio from wf")
def _(spark, d):
    return wf(spark, d).select("run", "win", "is_trades", F.round("is_pf", 6).alias("is_pf"), F.round("oos_pf", 6).alias("oos_pf"), F.round(F.col("oos_pf") / F.nullif(F.col("is_pf"), F.lit(0.0)), 4).alias("ratio"))


@query("rp_03_regime_table", f"with {TRADES}, {WINDOWS} select strategy, win, regime, round(wins/trades*100, 6) as win_pct, trades < 30 as low_n from windows")
def _(spark, d):
    return windows(spark, d).select("strategy", "win", "regime", F.round(F.col("wins") / F.col("trades") * 100, 6).alias("win_pct"), (F.col("trades") < 30).alias("low_n"))
