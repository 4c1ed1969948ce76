"""What is written and read back: each query writes to a folder of its own and returns what the files then hold."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans import search as S
from ..sources import files, sinks, specs
from ..sources.tables import table
from . import query
from .simulation import SIM, trades


@query("snk_02_append", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2")
def _(spark, d):
    path, rows = files.scratch(spark), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    sinks.append(rows.where("l_linenumber < 4"), path)
    sinks.append(rows.where("l_linenumber >= 4"), path)
    return spark.read.parquet(path).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("src_05_ingest", "select event_type as symbol, epoch_us(ts)//1000 as ts, max(value) as close from events group by 1, 2")
def _(spark, d):
    """Events as saved pages of 1,000 klines or so, ingested twice: what is there stays once."""
    pages, path = files.scratch(spark), files.scratch(spark)
    e = table(spark, d, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "value").groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    kline = F.array(F.col("ts").cast("string"), *[F.col("value").cast("string")] * 5)
    e.groupBy("event_type", F.pmod(F.xxhash64("ts"), F.lit(8)).alias("page")).agg(F.to_json(F.collect_list(kline)).alias("value")).write.partitionBy("event_type", "page").text(pages)
    symbols = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    for symbol in symbols + symbols[:1]:
        sinks.ingest(spark, f"{pages}/event_type={symbol}/*", symbol, path)
    return spark.read.parquet(path).select("symbol", "ts", "close")


@query("snk_03_cache_save", "select cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) || ':' || cast(l_partkey as varchar) as gene_key, l_extendedprice - 20000 as fitness from lineitem where l_extendedprice > 20000 order by fitness desc, gene_key limit 50000")
def _(spark, d):
    """A cache that is replaced by a better one, and read back."""
    path = files.scratch(spark)
    rows = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("gene_key"), (F.col("l_extendedprice") - 20000).alias("fitness"), F.lit("{}").alias("metrics"))
    sinks.save_cache(rows.limit(10), path, 5)
    sinks.save_cache(rows, path)
    return sinks.load_cache(spark, path).select("gene_key", "fitness")


@query("src_10_cache_missing", "select l_returnflag as cache, count(*) filter (where l_extendedprice > 20000 and l_returnflag <> 'N') as n from lineitem group by 1")
def _(spark, d):
    """A cache for each return flag but one; that one is missing, which is no error."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("gene_key"), (F.col("l_extendedprice") - 20000).alias("fitness"), F.lit("{}").alias("metrics"))
    paths = {r.l_returnflag: files.scratch(spark) for r in rows.select("l_returnflag").distinct().collect()}  # a few
    for flag, path in paths.items():
        if flag != "N":
            sinks.save_cache(rows.where(F.col("l_returnflag") == flag), path, 1 << 30)
    counts = [sinks.load_cache(spark, path).agg(F.lit(flag).alias("cache"), F.count("*").alias("n")) for flag, path in paths.items()]
    return reduce(DataFrame.unionByName, counts)


@query("snk_05_trade_csv", f"""{SIM} select symbol, signal as "Signal", count(*) as n, round(sum(round(exit_price, 2)), 2) as price, round(sum(round(pnl, 2)), 2) as pnl, min(strftime(make_timestamp(exit_ts*1000), '%Y-%m-%d %H:%M')) as first from trades group by 1, 2""")
def _(spark, d):
    path = files.scratch(spark)
    sinks.export_trades(trades(spark, d), path)
    rows = spark.read.csv(path, header=True)
    return rows.groupBy("symbol", "Signal").agg(F.count("*").alias("n"), F.round(F.sum(F.col("Exit Price").cast("double")), 2).alias("price"), F.round(F.sum(F.col("Net PnL").cast("double")), 2).alias("pnl"), F.min("Exit Date").alias("first"))


NAMED = "'20240101-' || n_nationkey || '-' || replace(replace(lower(n_name), ' ', '-'), '_', '-')"


@query("src_08_spec_scan", f"""select {NAMED} || '.json' as filename, {NAMED} as name, cast(null as varchar) as error from nation
union all select 'broken-' || r_regionkey || '.json', null, 'not a JSON object' from region union all select 'nameless-' || r_regionkey || '.json', null, 'no name' from region""")
def _(spark, d):
    """SRC-8, SRC-9 and SNK-4: a spec for each nation saved, one replaced, broken files for each region beside them, all listed."""
    folder = files.scratch(spark)
    nations = [f"20240101-{r.n_nationkey}-{r.n_name.lower().replace(' ', '-').replace('_', '-')}" for r in table(spark, d, "nation").collect()]  # 25 names
    for name in nations:
        specs.save(spark, S.TREND | {"name": name}, folder)
    path, replaced = specs.save(spark, S.TREND | {"name": nations[0]}, folder, overwrite=True)
    if not replaced or specs.load(spark, path)["name"] != nations[0]:
        raise ValueError("the spec was not replaced")
    for r in table(spark, d, "region").collect():
        files.write_text(spark, f"{folder}/broken-{r.r_regionkey}.json", '{"name": ', False)
        files.write_text(spark, f"{folder}/nameless-{r.r_regionkey}.json", json.dumps({"description": r.r_name}), False)
    good, bad = specs.scan(spark, folder)
    return good.select("filename", "name", F.lit(None).cast("string").alias("error")).unionByName(bad.select("filename", F.lit(None).cast("string").alias("name"), "error"))


@query("snk_09_deployment", "select r_name as spec_hash, 'R' || r_regionkey as symbol, cast(60*(r_regionkey + 1) as integer) as timeframe, ['dry-run', 'paper', 'live-stub'][r_regionkey % 3 + 1] as mode, 'draft' as status, 64 as secret_length, cast(1 as bigint) as n from region")
def _(spark, d):
    """A deployment for each region, re-read from the table."""
    path = files.scratch(spark)
    rows = [sinks.deploy(spark, path, r.r_name, f"R{r.r_regionkey}", 60 * (int(r.r_regionkey) + 1), sinks.MODES[r.r_regionkey % 3], config={"region": r.r_name}) for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    return reduce(DataFrame.unionByName, rows).groupBy("spec_hash", "symbol", "timeframe", "mode", "status", F.length("secret_key").alias("secret_length")).agg(F.count("*").alias("n"))
