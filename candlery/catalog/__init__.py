"""Queries over the driver's tables: each applies one operator, beside the SQL that it has to equal."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


#: Hourly bars of the events table and daily bars of lineitem, for the SQL side.
HOURLY = """hourly as (select event_type as symbol, ((epoch_us(ts)//1000)//3600000)*3600000 as bar_ts, first(value order by ts, event_id) as open, max(value) as high,
 min(value) as low, last(value order by ts, event_id) as close, sum(cast(props->>'$.k' as double)) as volume from events group by 1, 2)"""
DAILY = """daily as (select l_returnflag as symbol, ((epoch_us(l_shipdate)//1000)//86400000)*86400000 as bar_ts,
 first(l_extendedprice/l_quantity order by (epoch_us(l_shipdate)//1000), l_orderkey, l_linenumber, l_partkey, l_suppkey) as open, max(l_extendedprice/l_quantity) as high, min(l_extendedprice/l_quantity) as low,
 last(l_extendedprice/l_quantity order by (epoch_us(l_shipdate)//1000), l_orderkey, l_linenumber, l_partkey, l_suppkey) as close, sum(l_quantity) as volume from lineitem group by 1, 2)"""
TICKS = "ticks as (select event_type as symbol, (epoch_us(ts)//1000) as ms, event_id as seq, value as price, cast(props->>'$.k' as double) as volume from events)"
TRADES = """trades as (select l_linestatus as strategy, (epoch_us(l_shipdate)//1000) as exit_ms, l_orderkey as k1, l_linenumber as k2, l_partkey as k3, l_suppkey as k4,
 case when l_linenumber < 6 then l_returnflag end as regime, l_quantity as units, l_extendedprice/l_quantity as entry_price,
 case when l_discount = 0.05 then 0.0 else l_extendedprice*(l_discount-l_tax) end as pnl from lineitem)"""
EXIT = "exit_ms, k1, k2, k3, k4"
