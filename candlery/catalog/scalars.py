"""Scalar functions, the block catalogue and the queue's state rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.tables import table
from ..streaming import queue as Q
from . import query


@query("fn_01_floor_bucket", "select event_id, ((epoch_us(ts)//1000)//900000)*900000 as bucket from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.floor_div(F.unix_millis(F.col("ts").cast("timestamp")), 900_000).alias("bucket"))


@query("fn_02_arithmetic", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt(abs(l_quantity - 25)), 6) as a, round(pow(l_discount + 1, 3), 6) as b, floor(l_quantity/7) as c, ceil(l_quantity/7) as d, round(log10(l_extendedprice), 6) as e, greatest(l_tax, l_discount) as f from lineitem")
def _(spark, d):
    x, c = table(spark, d, "lineitem"), F.col
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.sqrt(F.abs(c("l_quantity") - 25)), 6).alias("a"), F.round(F.pow(c("l_discount") + 1, F.lit(3)), 6).alias("b"),
                    F.floor(c("l_quantity") / 7).cast("double").alias("c"), F.ceil(c("l_quantity") / 7).cast("double").alias("d"), F.round(F.log10("l_extendedprice"), 6).alias("e"), F.greatest("l_tax", "l_discount").alias("f"))


@query("fn_03_snap", "select p_partkey, round(least(greatest(0.5 + floor((p_size/9.0 - 0.5)/0.25 + 0.5)*0.25, 0.5), 4.0), 6) as v from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.snap(F.col("p_size") / 9.0, F.lit(0.5), F.lit(4.0), F.lit(0.25)), 6).alias("v"))


@query("fn_04_step_places", "select p_partkey, floor(p_retailprice*10 + 0.5)/10 as v from part")
def _(spark, d):
    n = 10 ** X.places(0.1)
    return table(spark, d, "part").select("p_partkey", (X.half_up(F.col("p_retailprice") * n) / n).alias("v"))


@query("fn_05_aligned", "select p_partkey, abs(p_size/2.5 - floor(p_size/2.5 + 0.5)) < 1e-9 as ok from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.aligned(F.col("p_size").cast("double"), F.lit(2.5)).alias("ok"))


NORMS = "case when c_acctbal <= 0 then 0.0 else least(c_acctbal/2500/4, 1.0) end as pf, greatest(least(1 - c_nationkey/20.0, 1.0), 0.0) as dd, case when c_acctbal <= 0 then 0.0 else least(c_acctbal/5000, 1.0) end as ret"
PF, DD, RET = (lambda: F.col("c_acctbal") / 2500), (lambda: F.col("c_nationkey") / 20.0), (lambda: F.col("c_acctbal") / 5000)  # columns need a session, so made when called


@query("fn_06_normalise", f"with n as (select c_custkey, {NORMS}, greatest(c_nationkey - 5, 0) as a, greatest(c_nationkey - 10, 0) as b from customer) select c_custkey, round(pf, 6) as pf, round(dd, 6) as dd, round(ret, 6) as ret, round(case when a + b > 0 then a/(a + b) else 0.5 end, 6) as w from n")
def _(spark, d):
    a, b = ((F.col("c_nationkey") - k).cast("double") for k in (5, 10))
    w = X.normal_weights(a, b)[0]
    return table(spark, d, "customer").select("c_custkey", *(F.round(x, 6).alias(n) for n, x in (("pf", X.normal_pf(PF(), 4.0)), ("dd", X.normal_dd(DD())), ("ret", X.normal_return(RET(), 1.0)), ("w", w))))


@query("fn_07_dates", "select event_id, epoch_us(ts)//1000 as ms, strftime(ts, '%Y-%m-%d') as day, year(ts) as y, month(ts) as m from events")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.year(ts).alias("y"), F.month(ts).alias("m"))


NAMES = "(case p_size % 7 when 0 then 'hourly' when 1 then '4h' when 2 then 'daily' when 3 then 'Weekly' when 4 then 'monthly' when 5 then '30' else 'odd' end)"


def names():
    return F.element_at(F.array(*(F.lit(x) for x in ("hourly", "4h", "daily", "Weekly", "monthly", "30", "odd"))), (F.col("p_size") % 7 + 1).cast("int"))


@query("fn_08_timeframe_minutes", f"select p_partkey, case lower({NAMES}) when 'hourly' then 60 when '4h' then 240 when 'daily' then 1440 when 'weekly' then 10080 when 'monthly' then 43200 when '30' then 30 end as minutes from part")
def _(spark, d):
    return table(spark, d, "part").withColumn("x", names()).select("p_partkey", X.timeframe_minutes(F.col("x")).alias("minutes"))


@query("fn_09_interval_label", "select p_partkey, case p_size*30 when 30 then '30m' when 60 then '1H' when 120 then '2H' when 240 then '4H' when 360 then '6H' when 720 then '12H' when 1440 then '1D' else (p_size*30) || 'm' end as label, case when p_size*30 < 60 then (p_size*30) || 'm' when p_size % 2 = 0 then (p_size//2) || 'H' else (p_size//2) || '.5H' end as hours from part")
def _(spark, d):
    m = F.col("p_size") * 30
    return table(spark, d, "part").select("p_partkey", X.interval_label(m).alias("label"), X.hours_label(m).alias("hours"))


@query("fn_10_period_years", "with p as (select o_orderkey, ['3M', '6M', '1y', '5y', '?'][cast(left(o_orderpriority, 1) as integer)] as x from orders) select o_orderkey, case x when '3M' then 0.25 when '6M' then 0.5 when '1y' then 1.0 when '5y' then 5.0 end as years from p")
def _(spark, d):
    label = F.element_at(F.array(*map(F.lit, ("3M", "6M", "1y", "5y", "?"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", X.period_years(label).alias("years"))


@query("fn_11_duration", """with s as (select o_orderkey, cast(floor(o_totalprice) as bigint) as s from orders) select o_orderkey, coalesce(nullif(concat_ws(' ', case when s//86400 > 0 then (s//86400) || 'd' end, case when s//3600 % 24 > 0 then (s//3600 % 24) || 'h' end,
case when s//60 % 60 > 0 then (s//60 % 60) || 'm' end, case when s % 60 > 0 then (s % 60) || 's' end), ''), '0s') as t from s""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.duration(F.floor("o_totalprice")).alias("t"))


@query("fn_12_dataset_id", "select o_orderkey, left(sha256(o_orderkey || ':' || o_custkey || ':' || o_orderstatus), 32) as id from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.dataset_id(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("id"))


@query("fn_13_gene_hash", """select p_partkey, left(sha256('{"a":' || p_size || ',"b":"' || p_brand || '"}'), 12) as h from part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))), 256), 1, 12).alias("h"))


@query("fn_15_gene_key", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey || ',' || l_linenumber || ',' || l_partkey as key, l_linenumber as second from lineitem")
def _(spark, d):
    key = X.gene_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", key.alias("key"), F.transform(F.split(key, ","), lambda v: v.cast("int"))[1].alias("second"))


@query("fn_16_dedup_key", "select event_id, event_id || ':' || event_type || ':' || case when value > 10 then 'long' else '' end as key from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.dedup_key(F.col("event_id"), F.col("event_type"), F.when(F.col("value") > 10, "long")).alias("key"))


@query("fn_17_name_list", "select p_partkey, p_size % 3 = 0 or (p_size % 3 = 1 and p_size in (7, 10)) as ok from part")
def _(spark, d):
    raw = F.when(F.col("p_size") % 3 == 0, "*").when(F.col("p_size") % 3 == 1, " 7 ,10, ").otherwise("none")
    return table(spark, d, "part").select("p_partkey", X.allows(X.name_set(raw), F.col("p_size").cast("string")).alias("ok"))


@query("fn_18_name_check", r"""with n as (select o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || case when o_custkey % 5 = 0 then 'x' else '' end || o_custkey || '-' || case when o_orderkey % 7 = 0 then o_orderpriority else lower(o_orderpriority) || '--a' end as name from orders)
select o_orderkey, regexp_full_match(name, '[0-9]{8}-[0-9]+-[a-z0-9-]+') as ok from n""")
def _(spark, d):
    from ..plans.spec import NAME

    o, c = table(spark, d, "orders"), F.col
    third = F.when(c("o_orderkey") % 7 == 0, c("o_orderpriority")).otherwise(F.concat(F.lower("o_orderpriority"), F.lit("--a")))
    name = F.concat_ws("-", F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.when(c("o_custkey") % 5 == 0, "x").otherwise(""), c("o_custkey").cast("string")), third)
    return o.select("o_orderkey", name.rlike(rf"\A(?:{NAME.pattern})\z").alias("ok"))


@query("fn_19_json", "select event_id, cast(props->>'$.k' as bigint) as k from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("fn_20_qualified_id", "select p_partkey, 'entry.' || p_brand || '.a.b' as id, p_brand as instance, 'a.b' as local from part")
def _(spark, d):
    q = F.concat_ws(".", F.lit("entry"), F.col("p_brand"), F.lit("a.b"))
    parts = F.split(q, r"\.", 3)
    return table(spark, d, "part").select("p_partkey", q.alias("id"), parts[1].alias("instance"), parts[2].alias("local"))


@query("fn_23_redact", "select c_custkey, left(c_name, 4) || '…' as s from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.redacted(F.col("c_name")).alias("s"))


@query("fn_24_shorten", "select doc_id, case when length(text) > 280 then left(text, 280) || '…' else text end as t from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.shortened(F.col("text")).alias("t"))


@query("fn_25_number_or", "select c_custkey, case when c_nationkey = 3 then -1.0 when c_nationkey = 4 then -1.0 else c_acctbal end as v from customer")
def _(spark, d):
    x = F.when(F.col("c_nationkey") == 3, float("nan")).when(F.col("c_nationkey") == 4, float("inf")).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", X.number_or(x, F.lit(-1.0)).alias("v"))


RUNS = "runs as (select o_orderkey as id, case o_orderstatus when 'O' then 'pending' when 'F' then 'running' else 'completed' end as status, cast(substr(o_orderpriority, 1, 1) as integer) as priority, o_custkey % 50 = 0 as cancel_requested, o_custkey % 4000 as beat_age, o_custkey % 3 = 0 as has_results from orders)"


def runs(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 50 == 0).alias("cancel_requested"),
                    (F.col("o_custkey") % 4000).alias("beat_age"), (F.col("o_custkey") % 3 == 0).alias("has_results"))


@query("st_07_claim", f"with {RUNS}, n as (select id from runs where status = 'pending' and not cancel_requested order by priority desc, id limit 1) select id, case when id in (select id from n) then 'running' else status end as status from runs")
def _(spark, d):
    return Q.claim(runs(spark, d)).select("id", "status")


@query("st_08_stale", f"with {RUNS} select id, case when status = 'running' and beat_age > 3000 then case when has_results then 'completed' else 'pending' end else status end as status from runs")
def _(spark, d):
    return Q.recover(runs(spark, d), 3000).select("id", "status")


@query("st_09_cancel", f"with {RUNS} select id, case when cancel_requested and status in ('pending', 'running') then 'cancelled' else status end as status from runs")
def _(spark, d):
    return Q.cancel(runs(spark, d)).select("id", "status")


@query("st_10_complete", f"with {RUNS} select id, case when status = 'running' and has_results then 'completed' when status = 'running' and beat_age > 3500 then 'failed' else status end as status from runs")
def _(spark, d):
    return Q.complete(runs(spark, d), F.col("has_results"), F.col("beat_age") > 3500).select("id", "status")


EVENTS = "ev as (select event_id, user_id, event_type, epoch_us(ts)//1000 as bar_time, epoch_us(ts)//1000 + (event_id % 700 - 100)*60000 as received, case event_type when 'click' then 60 else 240 end as tf from events)"


@query("st_02_inbox_dedupe", "select user_id as deployment_id, event_type as dedup_key, min(event_id) as event_id from events group by 1, 2")
def _(spark, d):
    from ..streaming.inbox import first_alerts

    e = table(spark, d, "events").select(F.col("user_id").alias("deployment_id"), F.col("event_type").alias("dedup_key"), "event_id")
    return first_alerts(e, "event_id")


@query("st_03_late_alerts", f"with {EVENTS} select event_id, case when received - bar_time > 2*tf*60000 then 'stale' when bar_time - received >= tf*60000 then 'future' else 'ok' end as verdict from ev")
def _(spark, d):
    from ..streaming.inbox import timeliness

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    tf = F.when(F.col("event_type") == "click", 60).otherwise(240)
    return table(spark, d, "events").select("event_id", timeliness(ms, ms + (F.col("event_id") % 700 - 100) * 60_000, tf).alias("verdict"))


@query("st_04_tumbling", "select event_type, epoch_us(time_bucket(interval '4 hours', ts, timestamp '1970-01-01'))//1000 as start, count(*) as n from events group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "4 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_millis("w.start").alias("start"), "n")


@query("st_05_closed_windows", "with b as (select event_type, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') as s, count(*) as n from events group by 1, 2) select event_type, epoch_us(s)//1000 as start, n from b where s + interval '4 hours' <= (select max(ts) from events)")
def _(spark, d):
    from ..streaming.inbox import closed_windows

    return closed_windows(table(spark, d, "events"))
