"""Sources that resume, exactly-once inserts, leases, deletes, cancelling and payloads: streams and tables made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles
from ..sources import files, pages, payloads, sinks
from ..sources.tables import table, ticks_events
from ..streaming import control, leases, ledger, progress
from . import HOURLY, query
from .bars import hourly

#: One-minute bars of the events table, for the SQL side.
MINUTES = HOURLY.replace("hourly as", "minutes as").replace("3600000", "60000")
MINUTE_BARS = f"{MINUTES} select symbol, bar_ts as ts, open, high, low, close, round(volume, 6) as volume from minutes"
HALF = 1_705_276_800_000


def minutes(spark, d):
    return candles.roll_up(ticks_events(spark, d), 1).withColumnRenamed("bar_ts", "ts")


def tidy(bars):
    return bars.withColumn("volume", F.round("volume", 6)).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("src_02_resume_stream", f"with {MINUTE_BARS}")
def _(spark, d):
    """Half of the pages, then the rest beside them: the stream's second run reads what is new."""
    source, path, mark = files.scratch(spark), files.scratch(spark), files.scratch(spark)
    bars = minutes(spark, d)
    for part in (F.col("ts") < HALF, F.col("ts") >= HALF):
        pages.save_pages(bars.where(part), source)
        ledger.insert_stream(pages.stream(spark, source), "pages", path, ["symbol", "ts"], ["open"], mark, "ts").awaitTermination()
    return tidy(ledger.read(spark, path))


@query("src_03_backward_scan", f"with {MINUTE_BARS} where bar_ts >= 1705276800000 and symbol <> 'view'")
def _(spark, d):
    source = files.scratch(spark)
    pages.save_pages(minutes(spark, d), source)
    return tidy(pages.scan(spark, source).where((F.col("ts") >= HALF) & (F.col("symbol") != "view")))


@query("st_06_resume", f"with {MINUTES}, mark as (select symbol, max(bar_ts) as last from minutes where bar_ts < 1705276800000 group by 1) select symbol, bar_ts as ts, close from minutes join mark using (symbol) where bar_ts > last")
def _(spark, d):
    """What a stream brings that goes on after the last bar of each symbol that a table has."""
    source, path, new = (files.scratch(spark) for _ in range(3))
    bars = minutes(spark, d)
    pages.save_pages(bars, source)
    ledger.insert_batch(bars.where(F.col("ts") < HALF), "start", path, ["symbol", "ts"], ["open"])
    resumed = pages.stream(spark, source, resume=ledger.marks(ledger.read(spark, path)))
    ledger.insert_stream(resumed, "new", new, ["symbol", "ts"], ["open"], files.scratch(spark)).awaitTermination()
    return ledger.read(spark, new).select("symbol", "ts", "close")


@query("snk_01_stream_upsert", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def _(spark, d):
    """The first event of each user and type from a stream in parts; its last batch is replayed and writes nothing."""
    source, path = files.scratch(spark), files.scratch(spark)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    mark = files.scratch(spark)
    edges = e.agg(F.max("event_id")).first()[0]
    for low, high in ((0, edges // 3), (edges // 3 + 1, edges)):
        e.where(F.col("event_id").between(low, high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        ledger.insert_stream(stream, "events", path, ["user_id", "event_type"], ["event_id"], mark).awaitTermination()
    if ledger.insert_batch(e, ledger.batches(spark, path)[-1], path, ["user_id", "event_type"], ["event_id"]):
        raise ValueError("a batch was written twice")
    return ledger.read(spark, path)


LEASE_HOURS, DELAY_MINUTES = 24, 10
LEASES = f"""ev as (select user_id as run_id, event_id, epoch_us(ts)//1000 as tm,
   case when event_type = 'purchase' and event_id % 25 = 0 then 'result' when event_type = 'error' and event_id % 200 = 0 then 'cancel' else 'beat' end as kind from events),
 wm as (select max(tm) - {DELAY_MINUTES * 60_000} as mark from ev),
 c as (select run_id, min(tm) as cancelled from ev where kind = 'cancel' group by 1),
 g as (select ev.*, coalesce(lead(tm) over (partition by run_id order by tm, event_id), mark) - tm > {LEASE_HOURS * 3_600_000} as lapses, cancelled,
   max(kind = 'result') over (partition by run_id order by tm, event_id) as results from ev cross join wm left join c using (run_id)),
 done as (select run_id, min(tm) as fin from g where lapses and results group by 1),
 ended as (select run_id, cancelled, done.fin as done from (select distinct run_id, cancelled from g) left join done using (run_id)),
 alive as (select g.* from g join ended using (run_id) where (g.cancelled is null or g.tm < g.cancelled) and (done is null or g.tm <= done)),
 final as (select run_id, max_by(lapses, tm) as lapsed, count(*) filter (where lapses) as lapses from alive group by 1)
 select run_id, case when done is not null and (ended.cancelled is null or done < ended.cancelled) then 'completed' when ended.cancelled is not null then 'cancelled' when lapsed then 'pending' else 'running' end as status, coalesce(lapses, 0) as lapses
 from ended left join final using (run_id)"""


@query("st_08_leases", f"with {LEASES}")
def _(spark, d):
    """Events as beats of a run for each user: a day without one ends the lease."""
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 25 == 0), "result").when((F.col("event_type") == "error") & (F.col("event_id") % 200 == 0), "cancel").otherwise("beat")
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("t"), kind.alias("kind"))
    source, path, mark = (files.scratch(spark) for _ in range(3))
    for part in (F.unix_millis("t") < HALF, F.unix_millis("t") >= HALF):
        e.where(part).write.mode("append").parquet(source)
        beats = spark.readStream.schema(e.schema).parquet(source)
        leases.start(leases.lease_changes(beats, LEASE_HOURS * 3_600_000, f"{DELAY_MINUTES} minutes"), path, mark).awaitTermination()
    return leases.last_status(spark.read.schema(leases.CHANGES).parquet(path))


@query("snk_08_delete_symbol", f"with {HOURLY} select symbol, count(*) as n from hourly where symbol <> 'click' group by 1")
def _(spark, d):
    path = files.scratch(spark)
    sinks.by_symbol(hourly(spark, d), path)
    sinks.delete_symbol(spark, path, "click")
    return spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("n"))


@query("snk_08_delete_range", f"with {HOURLY} select symbol, bar_ts as ts, close from hourly where symbol <> 'click' or bar_ts not between 1704500000000 and 1705276800000")
def _(spark, d):
    path = files.scratch(spark)
    sinks.by_symbol(hourly(spark, d).select("symbol", F.col("bar_ts").alias("ts"), "close"), path)
    sinks.delete_between(spark, path, "click", 1_704_500_000_000, HALF)
    return spark.read.parquet(path).select("symbol", "ts", "close")


@query("snk_07_progress", "select count(*) as n, count(*) filter (where event_type = 'click') as clicks, max(epoch_us(ts)//1000) as last, round(sum(value), 4) as total from events")
def _(spark, d):
    """Counts that a listener hears from a stream while it copies events."""
    e = table(spark, d, "events")
    source, heard = files.scratch(spark), []
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = progress.counted(stream, "copied", n=F.count("*"), clicks=F.count_if(F.col("event_type") == "click"), last=F.max(F.unix_millis(F.col("ts").cast("timestamp"))), total=F.sum("value"))
    with progress.reported(spark, lambda name, batch, counts: heard.append(counts.get("copied")) if name == "copy" else None):
        seen.writeStream.queryName("copy").format("parquet").option("path", files.scratch(spark)).option("checkpointLocation", files.scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    batches = spark.createDataFrame([(h["n"], h["clicks"], h["last"], h["total"]) for h in heard if h], "n long, clicks long, last long, total double")
    return batches.agg(F.sum("n").alias("n"), F.sum("clicks").alias("clicks"), F.max("last").alias("last"), F.round(F.sum("total"), 4).alias("total"))


@query("st_09_interrupt", "select l_returnflag as run, case when l_returnflag = 'N' then 'cancelled' else 'completed' end as status, case when l_returnflag <> 'N' then count(*) end as n from lineitem group by 1")
def _(spark, d):
    """A run for each return flag; the one whose row asks for it is interrupted, though its job would take long."""
    x = table(spark, d, "lineitem")
    queue = x.groupBy(F.col("l_returnflag").alias("run")).agg(F.count_if(F.col("l_linestatus") == "O") > 0).toDF("run", "cancel_requested")
    flags = {r.run: r.cancel_requested and r.run == "N" for r in queue.collect()}  # a few rows
    slow = F.expr("aggregate(sequence(1, 4000), 0L, (a, i) -> a + i * l_partkey)")

    def work(run):
        rows = x.where(F.col("l_returnflag") == run)
        return lambda: (rows.where(slow > 0) if flags[run] else rows).count()

    done = control.run_all(spark, {run: work(run) for run in flags}, lambda: [run for run, flag in flags.items() if flag])
    return spark.createDataFrame([(run, status, n) for run, (status, n) in done.items()], "run string, status string, n long")


def with_payloads(spark, d):
    """The events table with props as variants; every tenth one is cut off."""
    path = files.scratch(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.expr("if(event_id % 10 = 0, left(props, length(props) - 1), props)").alias("props"))
    payloads.save(e, path, "props")
    return path


@query("fn_19_variant", "select event_type, count(*) as n, count(*) filter (where event_id % 10 = 0) as malformed, sum(case when event_id % 10 > 0 then cast(props->>'$.k' as double) end) as total, 0 as words from events group by 1")
def _(spark, d):
    rows = spark.read.parquet(with_payloads(spark, d)).select("event_type", F.col("props").isNull().alias("bad"), payloads.field("props", "$.k", "double").alias("k"), payloads.field("props", "$.k.word", "string").alias("word"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("bad").alias("malformed"), F.sum("k").alias("total"), F.count("word").alias("words"))


@query("prj_01_metadata", "select event_id, event_type, user_id from events")
def _(spark, d):
    return payloads.listing(spark, with_payloads(spark, d))


@query("src_12_payload_lookup", "select event_id, event_type, user_id, cast(props->>'$.k' as double) as k from events where user_id = 17 and event_id % 10 > 0 union all select event_id, event_type, user_id, null from events where user_id = 17 and event_id % 10 = 0")
def _(spark, d):
    return payloads.lookup(spark, with_payloads(spark, d), "user_id", 17, k=("props", "$.k", "double"))
