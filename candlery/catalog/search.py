"""Fitness, windows, the parameter space, the simulation and the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import many, params as P, search as S
from ..plans.spec import catalogue
from ..sources.tables import table
from . import DAILY, query
from .bars import daily, hourly, rounded



SHORT = [(p[0].split(".")[-1], *p[1:]) for p in P.derive(S.TREND)[0]]
ORDER = [{"lhs": "emaFast", "op": "<", "rhs": "emaSlow", "repair": "clamp-rhs"}]


@query("ga_09_composite_fitness", """with m as (select c_custkey, c_acctbal/2500 as pf, c_nationkey/25.0 as dd, c_acctbal/8000 as ret, c_custkey % 120 as positions, case when c_custkey % 7 > 0 then c_nationkey/10.0 end as worst, case when c_custkey % 3 = 0 then c_nationkey/25.0 end as wfe from customer)
select c_custkey, positions < 30 or coalesce(worst < 1.0, false) or coalesce(wfe < 0.5, false) as eliminated, round(case when positions < 30 or coalesce(worst < 1.0, false) or coalesce(wfe < 0.5, false) then -1000.0 else
 (0.5*(case when pf <= 0 then 0 else least(pf/4, 1) end) + 0.3*greatest(least(1 - dd, 1), 0) + 0.2*(case when ret <= 0 then 0 else least(ret, 1) end))*least(1.0, positions/100.0) end, 6) as score from m""")
def _(spark, d):
    c = F.col
    m = table(spark, d, "customer").select("c_custkey", (c("c_acctbal") / 2500).alias("pf"), (c("c_nationkey") / 25.0).alias("max_dd_pct"), (c("c_acctbal") / 8000).alias("annual_return"), F.lit(0.0).alias("net_pct"), (c("c_custkey") % 120).alias("positions"),
                                           F.when(c("c_custkey") % 7 > 0, c("c_nationkey") / 10.0).alias("worst_pf"), F.when(c("c_custkey") % 3 == 0, c("c_nationkey") / 25.0).alias("wfe"))
    score = S.composite({"pf": 0.5, "dd": 0.3, "ret": 0.2}, {"pf": 4.0, "ret": 1.0}, {"minTradesPerWindow": 30, "worstRegimePfFloor": 1.0, "wfeMin": 0.5}, 100)
    return m.select("c_custkey", score["eliminated"].alias("eliminated"), F.round(score["score"], 6).alias("score"))


@query("ga_08_classic_score", "with m as (select c_custkey, c_custkey % 80 as trades, c_acctbal/10000 as net, c_nationkey/50.0 as dd from customer) select c_custkey, round(case when trades < 3 then -5000.0 when trades < 30 then -1000.0 + trades*10 else net*100*(1 - 0.3*least(greatest(dd, 0)/0.25, 1)*least(greatest(dd, 0)/0.25, 1)) end, 6) as score from m")
def _(spark, d):
    score = S.classic_score(F.col("c_custkey") % 80, F.col("c_acctbal") / 10000, F.col("c_nationkey") / 50.0)
    return table(spark, d, "customer").select("c_custkey", F.round(score, 6).alias("score"))


def by_symbol(scheme, start):
    @query(f"ga_14_{scheme}", f"""with {DAILY}, n as (select symbol, count(*) as length from daily group by 1), r as (select *, cast(floor((length - 200)*0.2) as bigint) as region from n), w as (select *, region // 5 as step, unnest(range(5)) as i from r)
select symbol, length, cast(i as integer) as "index", cast({start} as integer) as is_start, cast(length - region + i*step as integer) as is_end, cast(least(length - region + (i + 1)*step, length) as integer) as oos_end from w""")
    def _(spark, d):
        lengths = daily(spark, d).groupBy("symbol").agg(F.count("*").alias("length"))
        return S.windows(lengths, 200, 5, 0.2, "rolling" if scheme == "rolling_bounds" else "anchored")


by_symbol("window_bounds", "200")
by_symbol("rolling_bounds", "200 + i*step")


NATIONS = "n as (select count(*) as islands from nation), s as (select unnest(range(islands)) as i, islands from n)"


def islands(spark, d):
    """An island for each nation."""
    return table(spark, d, "nation").count()


@query("ga_10_ring", f"with {NATIONS} select i as island, (i + 1) % islands as target from s")
def _(spark, d):
    return P.topology(spark, islands(spark, d), "ring")


@query("ga_10_torus", f"""with {NATIONS}, z as (select i, islands, greatest(2, cast(round(sqrt(islands)) as bigint)) as wide from s), g as (select i, i // wide as y, i % wide as x, wide, cast(ceil(islands / wide) as bigint) as tall from z)
select a.i as island, b.i as target from g a join g b on least(abs(a.y - b.y), a.tall - abs(a.y - b.y)) + least(abs(a.x - b.x), a.wide - abs(a.x - b.x)) = 1""")
def _(spark, d):
    return P.topology(spark, islands(spark, d), "torus")


@query("ga_18_mutation_gradient", f"with {NATIONS} select i as island, round(least(0.4*(0.5 + i/(islands - 1.0)), 0.9), 6) as mutation_rate, round(0.12 + i/(islands - 1.0)*0.18, 6) as per_gene from s")
def _(spark, d):
    return rounded(P.mutation_gradient(spark, islands(spark, d), 0.4), "mutation_rate", "per_gene")



def specs(spark, d):
    """A spec for each part, its ranges from the part's size; every ninth one is not valid."""
    c, value, span = F.col, lambda x: F.struct(x.alias("value")), lambda a, b, s: F.struct(a.alias("min"), b.alias("max"), s.alias("step"))
    ref = lambda block, **params: F.struct(F.lit(block).alias("block"), F.lit(1).alias("version"), F.struct(*(p.alias(k) for k, p in params.items())).alias("params"))
    lit, size = F.lit, c("p_size").cast("int")
    trend = ref("emaTrend", emaFast=span(lit(5) + c("p_partkey").cast("int") % 4, lit(20) + size % 20, lit(1)), emaSlow=span(lit(30), lit(150) + 5 * size, lit(5)))
    slow = ref("htfTrendFilter", htfTfMin=value(60 * (1 + size % 4)), maLen=span(lit(10), 10 + size, lit(1)))
    stop = ref("atrHardStop", atrLen=value(lit(14)), atrSL=span(lit(0.5), lit(4.0), lit(0.25)), emergencySlPct=value(lit(25)))
    spec = F.struct(
        F.concat(lit("20240101-"), c("p_partkey").cast("string"), F.when(c("p_partkey") % 9 == 0, "-A").otherwise("-part")).alias("name"),
        F.struct(lit("all").alias("mode"), span(lit(1), lit(2), lit(1)).alias("threshold"), F.array(trend).alias("blocks")).alias("entries"),
        F.struct(lit("all").alias("mode"), F.array(slow).alias("blocks")).alias("filters"),
        F.struct(stop.alias("hardStop")).alias("exits"), ref("pctOfEquity", pct=value(lit(10))).alias("sizing"),
    )
    return table(spark, d, "part").select(c("p_partkey").alias("id"), F.to_json(spec).alias("spec"))


VALID = "p as (select p_partkey as id, p_partkey % 4 as k, p_size as size from part where p_partkey % 9 <> 0)"


@query("ga_01_param_space", f"""with {VALID}, x as (select *, unnest(range(5)) as j from p)
select id, ['emaTrend.main.emaFast', 'emaTrend.main.emaSlow', 'htfTrendFilter.main.maLen', 'atrHardStop.main.atrSL', '_meta.entries.threshold'][j + 1] as param, case j when 3 then 'float' else 'int' end as type,
 cast([5 + k, 30, 10, 0.5, 1][j + 1] as double) as "min", cast([20 + size % 20, 150 + 5*size, 10 + size, 4, 2][j + 1] as double) as "max", cast([1, 5, 1, 0.25, 1][j + 1] as double) as step from x""")
def _(spark, d):
    return many.spaces(specs(spark, d))


@query("ga_16_lookback", f"with {VALID} select id, 0 as timeframe, cast(greatest(200, 151 + 5*size) as integer) as bars from p union all select id, cast(60*(1 + size % 4) as integer), cast(11 + size as integer) from p")
def _(spark, d):
    return many.lookbacks(specs(spark, d))


@query("sp_01_validate", "select p_partkey as id, p_partkey % 9 = 0 as refused from part")
def _(spark, d):
    return many.checked(specs(spark, d)).select("id", (F.col("hash").isNull() & F.col("problems").startswith("name")).alias("refused"))


@query("ga_22_slots", f"""with {VALID}, x as (select *, unnest(range(4)) as j from p)
select id, cast(j as integer) as place, ['entries.blocks[0]', 'filters.blocks[0]', 'exits.hardStop', 'sizing'][j + 1] as path, ['entry', 'filter', 'exit', 'sizing'][j + 1] as kind, ['emaTrend', 'htfTrendFilter', 'atrHardStop', 'pctOfEquity'][j + 1] as block, 1 as version,
 ['{{"emaFast": ' || (5 + k) || ', "emaSlow": 30}}', '{{"htfTfMin": ' || (60*(1 + size % 4)) || ', "maLen": 10}}', '{{"atrLen": 14, "atrSL": 0.5, "emergencySlPct": 25.0}}', '{{"pct": 10.0}}'][j + 1] as params from x""")
def _(spark, d):
    return many.slots(specs(spark, d))


@query("srt_04_block_order", f"with {VALID} select t.kind, t.id, n from (values ('entry', 'emaTrend', 1), ('filter', 'htfTrendFilter', 2), ('exit', 'atrHardStop', 3), ('sizing', 'pctOfEquity', 4)) t(kind, id, o), (select count(*) as n from p) order by o, t.id")
def _(spark, d):
    """Blocks that the specs use, in the order of their kinds."""
    used = many.slots(specs(spark, d)).groupBy("kind", F.col("block").alias("id"), "version").agg(F.count("*").alias("n"))
    known = F.broadcast(catalogue(spark).select("kind", "id", "version", "kind_order"))  # the library's blocks
    return used.join(known, ["kind", "id", "version"]).orderBy("kind_order", "id", "version").select("kind", "id", "n")


@query("ga_05_constraint_repair", "select p_partkey, p_size % 33 + 8.0 as fast, case when p_size % 33 + 8.0 < p_size*1.0 then p_size*1.0 else least(greatest(30 + floor((least(greatest(p_size % 33 + 8.0 + 5, p_size), 150) - 30)/5 + 0.5)*5, 30), 150) end as slow from part")
def _(spark, d):
    params = [("fast", "int", 8, 40, 1), ("slow", "int", 30, 150, 5)]
    g = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 33 + 8.0).alias("fast"), (F.col("p_size") * 1.0).alias("slow"))
    return P.repair(g, params, [{"lhs": "fast", "op": "<", "rhs": "slow", "repair": "clamp-rhs"}])


@query("ga_06_frozen", "select p_partkey, 20.0 as fast, p_size*1.0 as slow from part")
def _(spark, d):
    g = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 33 + 8.0).alias("fast"), (F.col("p_size") * 1.0).alias("slow"))
    return P.freeze(g, {"fast": 20.0, "unknown": 1.0})


@query("ga_06_sweep", "with m as (select * from (values (0, 'emaFast', 18.0), (1, 'emaSlow', 60.0), (2, 'period', 26.0), (3, 'atrSL', 2.25)) t(j, id, value)), p as (select cast(unnest(range(count(*))) as integer) as planet from nation) select planet, id, value from p left join m on planet > 0 and (planet - 1) % (select count(*) from m) = j")
def _(spark, d):
    """A planet for each nation."""
    rows = [(k, *next(((i, float(v)) for i, v in f.items()), (None, None))) for k, f in enumerate(P.sweep(SHORT, islands(spark, d)))]
    return spark.createDataFrame(rows, "planet int, id string, value double")


@query("ga_19_classic_repair", """with g as (select p_partkey, p_size % 33 + 8.0 as "emaFast", 30.0 as "emaSlow", 2.0 as "tp1Mult", 1.5 as "tp2Mult", 3.0 as "tp3Mult", 50.0 as "tp1Pct", 50.0 as "tp2Pct" from part)
select p_partkey, "emaFast", case when "emaFast" >= 30 then least(greatest(30 + floor(("emaFast" + 10 - 30)/5 + 0.5)*5, 30), 150) else 30.0 end as "emaSlow", 2.0 as "tp1Mult", 2.5 as "tp2Mult", 3.0 as "tp3Mult", 50.0 as "tp1Pct", 40.0 as "tp2Pct" from g""")
def _(spark, d):
    fixed = {"emaSlow": 30.0, "tp1Mult": 2.0, "tp2Mult": 1.5, "tp3Mult": 3.0, "tp1Pct": 50.0, "tp2Pct": 50.0}
    g = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 33 + 8.0).alias("emaFast"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    return P.repair_classic(g)


def genes_of(spark, d):
    """A gene for each part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"))


@query("ga_02_random_genes")
def _(spark, d):
    return P.genes_for(genes_of(spark, d), SHORT, 7)


@query("ga_03_mutate_cross")
def _(spark, d):
    g = P.genes_for(genes_of(spark, d), SHORT, 7)
    names = [p[0] for p in SHORT]
    pairs = g.select("gene_id", F.struct(*names).alias("a")).join(g.select((F.col("gene_id") + 1).alias("gene_id"), F.struct(*names).alias("b")), "gene_id")
    return P.repair(P.mutate(P.cross(pairs, SHORT, 3), SHORT, 0.3, 5), SHORT, ORDER)


@query("ga_10_search")
def _(spark, d):
    return S.search(hourly(spark, d), planets=2, islands=2, size=5, generations=2, every=1, travel=1, knockout=True).drop("regimes")


@query("lg_01_classic")
def _(spark, d):
    gene = {p[0]: p[2] + (p[3] - p[2]) / 2 // p[4] * p[4] for p in P.CLASSIC}
    return S.classic_run(daily(spark, d), gene).drop("regimes")
