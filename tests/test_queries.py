"""Every query with an oracle against DuckDB, on whole tables."""

import math
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from candlery.queries import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return float(value)
    return str(value)


def rows_of(names, rows):
    """Rows by column name, sorted by their texts first and their numbers to seven digits, so that close rows pair up."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: (tuple(x for x in r if isinstance(x, str)), tuple(float(f"{x:.4g}") for x in r if not isinstance(x, str)), tuple(x for x in r if not isinstance(x, str))))


def same(a, b):
    """Queries round at six decimals: one unit there, or one part in 10**9, is the sums' order."""
    return a == b if isinstance(a, str) or isinstance(b, str) else a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-6)


def assert_same(got, want):
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert len(x) == len(y) and all(map(same, x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = all_queries()[name](spark, sf_dir)
    want = duck.sql(all_oracles()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert_same(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall()))


@pytest.mark.parametrize("name", ["agg_09_drawdown", "agg_14_monthly", "agg_17_slippage", "agg_23_streaks", "agg_24_running_stats", "sz_05_martingale", "sz_07_kelly", "sz_09_equity_curve"])
def test_small_stretches_equal_oracle(spark, duck, sf_dir, name, monkeypatch):
    """The same over some hundred stretches, most of them of one key's few rows."""
    from candlery.operators import metrics

    for setting, value in (("STRETCH_ROWS", 23), ("CELLS", 700), ("MOST_CELLS", 700)):
        monkeypatch.setattr(metrics, setting, value)
    assert metrics.in_stretches(all_queries()["sz_01_flat"](spark, sf_dir), "exit_ms").select("_b").distinct().count() > 100
    test_query_equals_oracle(spark, duck, sf_dir, name)


@pytest.mark.parametrize("name, most", [("sz_05_martingale", 3), ("sz_06_anti_martingale", 3), ("sz_09_equity_curve", 7), ("agg_24_running_stats", 2)])
def test_trades_are_sent_once(spark, sf_dir, name, most, monkeypatch):
    """F7 to F9: joins with what came before a stretch, and windows over stretches, share one exchange of the trades."""
    from candlery.operators import metrics

    monkeypatch.setattr(metrics, "STRETCH_ROWS", 500)
    plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= most


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_query_without_oracle_runs(spark, sf_dir, name):
    """What must hold of results that SQL can't give: rows, no nulls in keys, and values within bounds."""
    df = all_queries()[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in ("ga_02_random_genes", "ga_03_mutate_cross"):
        from candlery.catalog.search import SHORT

        assert all(lo <= r[n] <= hi and abs((r[n] - lo) / step - round((r[n] - lo) / step)) < 1e-9 for r in rows for n, _, lo, hi, step in SHORT)
        assert len({r["gene_id"] for r in rows}) == len(rows) and len({tuple(r[p[0]] for p in SHORT) for r in rows}) > len(rows) / 2
    elif name == "ga_10_search":
        assert all(r["score"] is not None and r["trades"] >= 0 for r in rows) and max(r["score"] for r in rows) > -1000
    else:
        assert name == "lg_01_classic" and all(r["trades"] >= r["wins"] >= 0 and r["equity"] > 0 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
