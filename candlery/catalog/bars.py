"""Scans, roll-ups, filters, joins in time, sorts and sets over bars."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import candles, joins, tables as T
from ..sources.tables import DAY, HOUR, table, ticks_events, ticks_lineitem
from . import DAILY, HOURLY, TICKS, query


def hourly(spark, d):
    return candles.roll_up(ticks_events(spark, d), HOUR)


def daily(spark, d):
    return candles.roll_up(ticks_lineitem(spark, d), DAY)


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("agg_01_ohlcv_rollup", f"with {HOURLY} select symbol, bar_ts, open, high, low, close, round(volume, 6) as volume from hourly")
def _(spark, d):
    return rounded(hourly(spark, d), "volume")


@query("agg_01_daily_rollup", f"with {DAILY} select symbol, bar_ts, open, high, low, close, round(volume, 6) as volume from daily")
def _(spark, d):
    return rounded(daily(spark, d), "volume")


@query("agg_01_rollup_of_rollup", f"with {HOURLY} select symbol, (bar_ts//14400000)*14400000 as bar_ts, first(open order by bar_ts) as open, max(high) as high, min(low) as low, last(close order by bar_ts) as close, round(sum(volume), 6) as volume from hourly group by 1, 2")
def _(spark, d):
    return rounded(candles.roll_up_bars(hourly(spark, d), 240), "volume")


@query("flt_01_partial_first_bar", "select event_type as symbol, ((epoch_us(ts)//1000)//14400000)*14400000 as bar_ts, first(value order by ts, event_id) as open, last(value order by ts, event_id) as close, count(*) as n from events where (epoch_us(ts)//1000) >= (select min((epoch_us(ts)//1000)) + 100000000 from events) group by 1, 2")
def _(spark, d):
    ticks = ticks_events(spark, d)
    start = ticks.agg(F.min("ms").alias("first"))
    late = ticks.join(F.broadcast(start), F.col("ms") >= F.col("first") + 100_000_000)
    at = F.struct("ms", "seq")
    return late.groupBy("symbol", candles.bucket("ms", 240).alias("bar_ts")).agg(F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"), F.count("*").alias("n"))


@query("agg_02_symbol_stats", f"with {TICKS} select symbol, min(ms) as first_ts, max(ms) as last_ts, count(*) as n from ticks group by 1")
def _(spark, d):
    return candles.symbol_stats(ticks_events(spark, d))


@query("agg_03_bounds", f"with {TICKS} select max(ms) as last_ts, min(ms) as first_ts, count(*) as n from ticks where symbol = 'click'")
def _(spark, d):
    return ticks_events(spark, d).where("symbol = 'click'").agg(F.max("ms").alias("last_ts"), F.min("ms").alias("first_ts"), F.count("*").alias("n"))


@query("agg_04_event_count", "select user_id, cast(count(distinct event_type) as integer) as n from events where value > 10 group by 1")
def _(spark, d):
    return table(spark, d, "events").where("value > 10").groupBy("user_id").agg(F.countDistinct("event_type").cast("int").alias("n"))


@query("agg_18_gap_report", f"with {HOURLY}, s as (select symbol, bar_ts - lag(bar_ts) over (partition by symbol order by bar_ts) as step from hourly) select symbol, count(*) filter (where step <> 3600000) as uneven, count(*) filter (where step > 10800000) as holes, max(step) as widest from s group by 1")
def _(spark, d):
    return candles.gap_report(hourly(spark, d), HOUR)


@query("agg_18_holes", f"with {DAILY}, s as (select symbol, bar_ts, bar_ts - lag(bar_ts) over (partition by symbol order by bar_ts) as step from daily) select * from s where step > 3*86400000 order by bar_ts, symbol limit 20")
def _(spark, d):
    return candles.holes(daily(spark, d), DAY)


@query("agg_25_max_id", "select max(o_orderkey) as id from orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.max("o_orderkey").alias("id"))


@query("src_04_kline_decode", "select event_id, (epoch_us(ts)//1000) as ts, value as open, value + 1 as high from events")
def _(spark, d):
    from ..sources.klines import decode

    e = table(spark, d, "events")
    raw = F.to_json(F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.col("value").cast("string"), (F.col("value") + 1).cast("string"), F.lit("0"), F.lit("0"), F.lit("0")))
    return decode(e.select("event_id", raw.alias("kline")), "kline").select("event_id", "ts", "open", "high")


@query("src_06_update_gaps", f"with {TICKS}, s as (select symbol, min(ms) as a, max(ms) as b from ticks group by 1) select symbol, cast(ceil((1706745600000 - b)/60000.0) as bigint) as recent_gap, cast(greatest(0, ceil((a - 1704000000000)/60000.0)) as bigint) as historical_gap from s")
def _(spark, d):
    return candles.update_gaps(candles.symbol_stats(ticks_events(spark, d)), 1_706_745_600_000, 1_704_000_000_000)


@query("src_07_scan", "select event_id, value from events where event_type = 'click' and (epoch_us(ts)//1000) >= 1704800000000")
def _(spark, d):
    e = table(spark, d, "events")
    return e.where((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-09 11:33:20").cast("timestamp_ntz"))).select("event_id", "value")


@query("src_12_point_lookup", "select event_id, event_type, cast(props->>'$.k' as double) as k from events where event_id = 17")
def _(spark, d):
    return table(spark, d, "events").where("event_id = 17").select("event_id", "event_type", F.from_json("props", "k double").k.alias("k"))


@query("src_13_range_inclusive", f"with {HOURLY} select symbol, bar_ts, close from hourly where bar_ts between 1704067200000 and 1704153600000")
def _(spark, d):
    return hourly(spark, d).where(F.col("bar_ts").between(1_704_067_200_000, 1_704_153_600_000)).select("symbol", "bar_ts", "close")


@query("src_14_additive_columns", "select o_orderkey, o_orderstatus, cast(null as integer) as priority from orders union all select c_custkey, cast(null as varchar), 1 from customer")
def _(spark, d):
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.lit(1).alias("priority"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").unionByName(new, allowMissingColumns=True)


@query("snk_01_merge_insert", "select o_custkey, min(o_orderkey) as o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 12) group by 1")
def _(spark, d):
    orders, known = table(spark, d, "orders"), table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return T.first_of(candles_anti(orders, known), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


def candles_anti(rows, known):
    return rows.join(known, "o_custkey", "left_anti")


@query("prj_02_price_sources", f"with {HOURLY} select symbol, bar_ts, round((high+low)/2, 6) as hl2, round((high+low+close)/3, 6) as hlc3, round((open+high+low+close)/4, 6) as ohlc4 from hourly")
def _(spark, d):
    return hourly(spark, d).select("symbol", "bar_ts", *(F.round(candles.price_source(n), 6).alias(n) for n in ("hl2", "hlc3", "ohlc4")))


@query("prj_04_symbol_dates", f"with {TICKS} select symbol, strftime(make_timestamp(min(ms)*1000), '%Y-%m-%d') as first_date, strftime(make_timestamp(max(ms)*1000), '%Y-%m-%d') as last_date, (1706745600000 - max(ms))//86400000 as gap_days from ticks group by 1")
def _(spark, d):
    s = candles.symbol_stats(ticks_events(spark, d))
    day = lambda c: F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd")
    return s.select("symbol", day("first_ts").alias("first_date"), day("last_ts").alias("last_date"), F.floor((1_706_745_600_000 - F.col("last_ts")) / 86_400_000).alias("gap_days"))


@query("prj_05_seconds", f"with {HOURLY} select symbol, bar_ts//1000 as time, close as value from hourly")
def _(spark, d):
    return hourly(spark, d).select("symbol", F.floor(F.col("bar_ts") / 1000).alias("time"), F.col("close").alias("value"))


@query("prj_07_queue_listing", "select o_orderkey as id, o_orderpriority as priority, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end as status, o_orderstatus = 'P' as active from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), status.alias("status"), (F.col("o_orderstatus") == "P").alias("active"))


@query("flt_02_exclusive_end", f"with {HOURLY} select symbol, count(*) as n from hourly where bar_ts < 1705276800000 group by 1")
def _(spark, d):
    return hourly(spark, d).where(F.col("bar_ts") < 1_705_276_800_000).groupBy("symbol").agg(F.count("*").alias("n"))


@query("flt_03_inclusive_end", f"with {HOURLY} select symbol, count(*) as n from hourly where bar_ts <= 1705276800000 group by 1")
def _(spark, d):
    return hourly(spark, d).where(F.col("bar_ts") <= 1_705_276_800_000).groupBy("symbol").agg(F.count("*").alias("n"))


@query("flt_04_start_bar", f"with {HOURLY}, n as (select symbol, bar_ts, row_number() over (partition by symbol order by bar_ts) - 1 as i from hourly) select symbol, coalesce(min(i) filter (where bar_ts >= 1705276800000), count(*)) as bundle, coalesce(min(i) filter (where bar_ts >= 1705276800000), 0) as runner from n group by 1")
def _(spark, d):
    return candles.start_bar(hourly(spark, d), 1_705_276_800_000)


@query("flt_05_null_safe", "select l_linestatus, count(*) as n from lineitem where (case when l_linenumber < 6 then l_discount > 0.05 end) = false or (case when l_linenumber < 6 then l_discount > 0.05 end) is null group by 1")
def _(spark, d):
    flag = F.when(F.col("l_linenumber") < 6, F.col("l_discount") > 0.05)
    return table(spark, d, "lineitem").where(~F.coalesce(flag, F.lit(False))).groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("flt_06_isin", "select o_orderstatus, count(*) as n from orders where o_orderstatus in ('O', 'P') group by 1")
def _(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


ASOF = f"""with {HOURLY}, base as (select symbol, bar_ts, row_number() over (partition by symbol order by bar_ts) - 1 as i from hourly),
h4 as (select symbol, (bar_ts//14400000)*14400000 as hts, first(open order by bar_ts) as hopen, last(close order by bar_ts) as hclose from hourly group by 1, 2),
htf as (select *, row_number() over (partition by symbol order by hts) - 1 as idx from h4),
j as (select b.symbol, b.bar_ts, h.idx, h.hclose from base b asof left join htf h on b.symbol = h.symbol and b.bar_ts >= h.hts + 14400000)"""


def with_h4(spark, d, columns):
    base = hourly(spark, d)
    htf = candles.indexed(candles.roll_up_bars(base, 240)).select("symbol", "bar_ts", F.col("i").alias("idx"), F.col("close").alias("hclose"))
    return joins.asof_closed(base.select("symbol", "bar_ts", "close"), htf, 240, columns)


@query("jn_01_htf_asof", f"{ASOF} select symbol, bar_ts, idx from j")
def _(spark, d):
    return with_h4(spark, d, ["idx"]).select("symbol", "bar_ts", "idx")


@query("jn_02_htf_range_join", f"{ASOF} select symbol, bar_ts, idx from j")
def _(spark, d):
    base = hourly(spark, d)
    return joins.range_join_closed(base, candles.roll_up_bars(base, 240), 240)


@query("jn_03_htf_value", f"{ASOF} select symbol, bar_ts, coalesce(hclose, -1.0) as htf_close from j")
def _(spark, d):
    base = hourly(spark, d)
    htf = candles.indexed(candles.roll_up_bars(base, 240)).select("symbol", F.col("i").alias("idx"), F.col("close").alias("htf_close"))
    return with_h4(spark, d, ["idx"]).join(htf, ["symbol", "idx"], "left").select("symbol", "bar_ts", F.coalesce("htf_close", F.lit(-1.0)).alias("htf_close"))


@query("jn_04_htf_lag", f"""{ASOF}, l as (select *, lag(hclose, 3) over (partition by symbol order by hts) as past from htf)
select b.symbol, b.bar_ts, round((h.hclose - h.past)/nullif(h.hclose, 0), 6) as slope from base b asof left join l h on b.symbol = h.symbol and b.bar_ts >= h.hts + 14400000""")
def _(spark, d):
    base = hourly(spark, d)
    htf = candles.roll_up_bars(base, 240).withColumn("slope", F.round(joins.slope(F.col("close"), 3), 6))
    return joins.asof_closed(base.select("symbol", "bar_ts"), htf, 240, ["slope"])


@query("jn_05_run_spec", "select o_orderkey as run_id, c_name as spec_name from orders left join customer on o_custkey = c_custkey and c_nationkey < 20")
def _(spark, d):
    specs = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(specs, "o_custkey", "left").select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("spec_name"))


@query("jn_06_run_deployment", "select o_orderkey as run_id, c_name as name, 'draft' as status from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(c, "o_custkey").select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("name"), F.lit("draft").alias("status"))


@query("jn_07_anti_insert", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return candles.merge_insert(table(spark, d, "customer").select("c_custkey"), known, ["c_custkey"])


@query("jn_08_cache_delta", "select distinct p_brand from part where p_brand not in (select p_brand from part where p_size < 3)")
def _(spark, d):
    p = table(spark, d, "part")
    return candles.merge_insert(p.select("p_brand"), p.where("p_size < 3").select("p_brand"), ["p_brand"])


@query("jn_09_run_grid", "select r.r_name as symbol, i.label, i.minutes from region r cross join (values ('1H', 60), ('4H', 240), ('1D', 1440)) i(label, minutes)")
def _(spark, d):
    return T.run_grid(table(spark, d, "region").select(F.col("r_name").alias("symbol")), ["1H", "4H", "1D", "no such"])


@query("jn_10_parity_merge", """with a as (select l_shipdate as entry_ts, l_returnflag as direction, row_number() over (partition by l_shipdate, l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as place from lineitem where l_linenumber < 4),
b as (select l_shipdate as entry_ts, l_returnflag as direction, row_number() over (partition by l_shipdate, l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as place from lineitem where l_linenumber >= 4)
select coalesce(a.direction, b.direction) as direction, count(*) as n, count(*) filter (where a.place is null or b.place is null) as divergences from a full join b on a.entry_ts = b.entry_ts and a.direction = b.direction and a.place = b.place group by 1""")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumnsRenamed({"l_shipdate": "entry_ts", "l_returnflag": "direction"})
    merged = joins.merge_ordered(x.where("l_linenumber < 4"), x.where("l_linenumber >= 4"), ["entry_ts", "direction"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return merged.groupBy("direction").agg(F.count("*").alias("n"), F.count_if("diverges").alias("divergences"))


@query("jn_11_window_zip", """with w as (select o_custkey % 2 as run, o_custkey//2 % 50 as win, avg(o_totalprice) as pf from orders group by 1, 2)
select a.win, round((b.pf - a.pf)/greatest(abs(a.pf), abs(b.pf)), 6) as gap, case when abs(b.pf - a.pf) < 0.1*greatest(abs(a.pf), abs(b.pf)) then 'tie' when b.pf > a.pf then 'b' else 'a' end as winner from w a join w b on a.win = b.win and a.run = 0 and b.run = 1""")
def _(spark, d):
    w = table(spark, d, "orders").groupBy((F.col("o_custkey") % 2).alias("run"), (F.floor(F.col("o_custkey") / 2) % 50).alias("win")).agg(F.avg("o_totalprice").alias("pf"))
    return T.compare_windows(w.where("run = 0"), w.where("run = 1"))


@query("jn_12_year_join", f"""with {DAILY}, s as (select year(o_orderdate) as year, sum(o_totalprice) as pnl from orders group by 1), h as (select symbol, year(make_timestamp(bar_ts*1000)) as year, first(open order by bar_ts) as o, last(close order by bar_ts) as c from daily group by 1, 2)
select s.year, symbol, round(pnl, 2) as pnl, round((c - o)/o*100, 6) as hold_pct from s left join h using (year)""")
def _(spark, d):
    from ..operators.metrics import buy_and_hold

    strategy = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("pnl"))
    hold = buy_and_hold(daily(spark, d)).select("symbol", "year", F.round("hold_pct", 6).alias("hold_pct"))
    return strategy.join(hold, "year", "left")


@query("jn_13_membership", "select l_returnflag, count(*) as n from lineitem where l_returnflag in ('A', 'R') group by 1")
def _(spark, d):
    allowed = F.transform(F.split(F.lit(" A, R ,,"), ","), lambda x: F.trim(x))
    return table(spark, d, "lineitem").where(F.array_contains(allowed, F.col("l_returnflag"))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("srt_01_bar_order", f"with {HOURLY} select symbol, bar_ts, close from hourly order by bar_ts, symbol")
def _(spark, d):
    return hourly(spark, d).select("symbol", "bar_ts", "close").orderBy("bar_ts", "symbol")


@query("srt_02_claim_order", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderpriority desc, o_orderkey limit 1")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority").orderBy(F.desc("o_orderpriority"), "o_orderkey").limit(1)


@query("srt_03_newest_first", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("srt_05_by_trades", "select l_returnflag, count(*) as trades from lineitem group by 1 order by 2 desc")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("trades")).orderBy(F.desc("trades"))


@query("srt_06_tranches", """with t as (select p_partkey, [p_size % 7, p_size % 5, p_size % 3] as m from part),
u as (select p_partkey, unnest(m) as mult from t), r as (select p_partkey, mult, row_number() over (partition by p_partkey order by mult) as k from u where mult > 0)
select p_partkey, string_agg('TP' || k || '=' || mult, ',' order by k) as label from r group by 1""")
def _(spark, d):
    p = table(spark, d, "part")
    mults = F.array_sort(F.filter(F.array(F.col("p_size") % 7, F.col("p_size") % 5, F.col("p_size") % 3), lambda x: x > 0))
    label = F.array_join(F.transform(mults, lambda x, i: F.concat(F.lit("TP"), (i + 1).cast("string"), F.lit("="), x.cast("string"))), ",")
    return p.where(F.size(mults) > 0).select("p_partkey", label.alias("label"))


@query("top_01_per_island", "select * from (select l_suppkey as island, l_extendedprice as fitness, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rank from lineitem) where rank <= 20")
def _(spark, d):
    x = table(spark, d, "lineitem")
    return T.top_per(x, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 20).select(F.col("l_suppkey").alias("island"), F.col("l_extendedprice").alias("fitness"), "l_orderkey", "l_linenumber", "rank")


@query("top_02_global_merge", "select l_partkey as gene, max(l_extendedprice) as fitness from lineitem group by 1 order by 2 desc, 1 limit 20")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_extendedprice").alias("fitness"))
    return T.best_distinct(x, "gene", "fitness", 20)


@query("top_03_migrants", """with e as (select s_suppkey as src, (s_suppkey + 1) % (select count(*) from supplier) as dst from supplier),
r as (select l_suppkey, l_partkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as k from lineitem)
select dst as island, l_partkey as gene, l_extendedprice as fitness from r join e on l_suppkey = src where k <= 2""")
def _(spark, d):
    s = table(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    edges = s.join(F.broadcast(n), F.lit(True)).select(F.col("s_suppkey").alias("island"), ((F.col("s_suppkey") + 1) % F.col("n")).alias("dst"))
    x = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "island")
    best = T.top_per(x, ["island"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 2)
    return best.join(edges, "island").select(F.col("dst").alias("island"), F.col("l_partkey").alias("gene"), F.col("l_extendedprice").alias("fitness"))


@query("top_04_cache_cap", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem where l_extendedprice > 0 order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 50000")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return T.keep_best(x, "l_extendedprice", 50_000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("top_05_bottom_quarter", """with r as (select c_nationkey as island, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as best, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey desc) as worst, count(*) over (partition by c_nationkey) as n from customer)
select island, c_custkey from r where worst <= n//4 and best > 3""")
def _(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "island")
    return T.worst_share(c, "island", "c_acctbal", "c_custkey", 0.25, 3).select("island", "c_custkey")


@query("set_01_concat", "select l_orderkey as k from lineitem where l_linenumber = 1 union all select o_orderkey from orders where o_orderstatus = 'P'")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k")).unionByName(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k")))


@query("set_02_first_seen", "select event_type || '/' || (event_id % 3) as key, min(event_id) as first_seen from events group by 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("key"), "event_id")
    return T.first_of(e, ["key"], ["event_id"]).select("key", F.col("event_id").alias("first_seen"))


@query("set_03_last_wins", "select user_id as key, arg_max(value, event_id) as value from events group by 1")
def _(spark, d):
    return T.last_wins(table(spark, d, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("seq")), ["key"], "seq").select("key", "value")


@query("set_04_event_dedupe", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def _(spark, d):
    return T.first_of(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("set_05_key_difference", "select distinct l_partkey from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_returnflag = 'A'")
def _(spark, d):
    x = table(spark, d, "lineitem")
    return candles.merge_insert(x.where("l_returnflag = 'R'").select("l_partkey"), x.where("l_returnflag = 'A'").select("l_partkey"), ["l_partkey"])


@query("set_06_signal_union", "select l_returnflag as signal from lineitem union select o_orderstatus from orders")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("signal")).union(table(spark, d, "orders").select("o_orderstatus")).distinct()


@query("set_07_content_upsert", "select sha256(p_brand || '|' || p_size) as hash, min(p_partkey) as earliest from part group by 1")
def _(spark, d):
    p = table(spark, d, "part").withColumn("hash", F.sha2(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")), 256))
    return T.first_of(p, ["hash"], ["p_partkey"]).select("hash", F.col("p_partkey").alias("earliest"))
