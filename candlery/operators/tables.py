"""Top-k, de-duplication and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import in_stretches

#: The most rows that one task sorts to find the best ones.
IN_ONE_TASK = 100_000
#: Fixed: labels of intervals in minutes.
INTERVALS = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1H": 60, "2H": 120, "4H": 240, "6H": 360, "8H": 480, "12H": 720, "1D": 1440, "1W": 10080}


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregate with a partial step before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def last_wins(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*key, "_row.*")


def top_per(df: DataFrame, key: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The n first rows of each key with their rank; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def best_distinct(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n best keys by their best value."""
    return df.groupBy(key).agg(F.max(value).alias(value)).orderBy(F.desc(value), key).limit(n)


def keep_best(df: DataFrame, value: str, n: int, ties: list[str]) -> DataFrame:
    """The n best rows whose value is a positive finite number; in their order if n is IN_ONE_TASK at most.

    Of more, those that are all among the best are left where they are: counts by stretch of values (in_stretches) tell
    in which stretch the n-th best lies, and only its rows are put in order, over many tasks if they are many.
    """
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0) & (F.col(value) < float("inf"))
    rows, order = df.where(good), [F.desc(value), *ties]
    if n <= IN_ONE_TASK:
        return rows.orderBy(*order).limit(n)
    if rows.count() <= n:
        return rows
    x, held = in_stretches(rows, value), 0
    for edge, more in sorted(((r[0], r[1]) for r in x.groupBy("_b").count().collect()), reverse=True):  # a row a stretch
        if held + more > n:
            break
        held += more
    last = x.where(F.col("_b") == edge).drop("_b").orderBy(*order)
    if n - held <= IN_ONE_TASK:
        last = last.limit(n - held)
    else:  # very many rows of nearly one value
        ranked = last.rdd.zipWithIndex().filter(lambda r: r[1] < n - held).keys()
        last = df.sparkSession.createDataFrame(ranked, df.schema, verifySchema=False)
    return x.where(F.col("_b") > edge).drop("_b").unionByName(last)


def worst_share(df: DataFrame, group: str, value: str, tie: str, share: float, elites: int) -> DataFrame:
    """The worst share of each group, never its elites."""
    w = W.partitionBy(group)
    ranked = df.withColumns({"_best": F.row_number().over(w.orderBy(F.desc(value), tie)), "_n": F.count("*").over(w)})
    return ranked.where((F.col("_n") - F.col("_best") < F.floor(F.col("_n") * share)) & (F.col("_best") > elites)).drop("_best", "_n")


def run_grid(symbols: DataFrame, labels: list[str]) -> DataFrame:
    """Each symbol with each known interval; unknown labels are left out. The list of labels is a few literals."""
    known = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(INTERVALS[x]).alias("minutes")) for x in labels if x in INTERVALS))
    return symbols.select("symbol", F.inline(known))


def compare_windows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Windows of two runs side by side: relative gap, and a winner when it is a tenth or more."""
    both = a.select("win", F.col("pf").alias("x")).join(b.select("win", F.col("pf").alias("y")), "win")
    scale = F.greatest(F.abs("x"), F.abs("y"))
    winner = F.when(F.abs(F.col("y") - F.col("x")) < 0.1 * scale, "tie").when(F.col("y") > F.col("x"), "b").otherwise("a")
    return both.select("win", F.round((F.col("y") - F.col("x")) / scale, 6).alias("gap"), winner.alias("winner"))
