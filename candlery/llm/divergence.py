"""Source divergence audit: how far each source's use of terms is from the other sources and from its language.

Each kept term is a wide vector, its counts by source of the language. Functions over that array give what the term
adds to each pair of sources, and partial sums in each task leave one row a pair. A pair's sum starts from what terms
that neither source holds give, so that only terms of at least one of the two send anything.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import broadcast_if_small, small_batches, stored, table

#: Documents of a language that a term needs, and ranks of terms that are reported.
MIN_DOCS, TOP = 10, 10
#: Terms that a task holds before it hands on what it has counted.
HELD_TERMS = 1_000_000
#: Bytes of terms as they are, A-Z lowered, all others blank: a term is a run of ASCII letters and non-ASCII symbols.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with it), several rows a term; null counts as ''."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def rows_of(held):
        for (lang, source), (n, docs) in held.items():
            terms = list(docs)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array(list(docs.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for text, *group in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms = (text or b"").translate(_FOLD).split()
                n, docs = held[tuple(group)]
                size -= len(docs)
                n.update(terms)
                docs.update(set(terms))
                size += len(docs)
                if size > HELD_TERMS:
                    yield from rows_of(held)
                    held.clear()
                    size = 0
        yield from rows_of(held)

    rows = docs.select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def share(count: str, whole: str) -> str:
    """SQL of 1 + floor(10**9 * count / whole) in 64-bit integers, three digits at a time; whole is below 9 * 10**15."""
    first, rest = f"({count} * 1000L) div {whole}", f"({count} * 1000L) % {whole}"
    second, last = f"(({rest}) * 1000L) div {whole}", f"(((({rest}) * 1000L) % {whole}) * 1000L) div {whole}"
    return f"(1L + ({first}) * 1000000L + ({second}) * 1000L + {last})"


def apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distance to the others, and its most overused terms.

    A language's kept terms are those that at least min_docs of its rows hold. A source gives a term the share
    p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), N of its occurrences of the V kept terms, the language as a whole
    likewise q; two shares differ by floor((p - q)**2 / (p + q)). Part `pair` has every other source of the language
    with the sum over all kept terms (0 without any); part `term` the `top` terms that the source holds with p > q.
    Ranks go by value, descending, then by item's UTF-8.

    Null text, lang and source count as ''; a source without terms has all shares of zero counts; each row is a
    document, repeated ones too; no rows give none. Only these three columns are read.
    """
    rows = docs.select("text", "lang", "source")
    names = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = stored(names.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))

    # A term's vector: its counts by number of the source, of at most as many entries as the language has sources.
    known = counted(rows).join(broadcast_if_small(groups), ["lang", "source"]).repartition("lang", "term")
    by_source = known.groupBy("lang", "term", "i").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("counts"))
    terms = stored(by_term.where(F.col("docs") >= min_docs).drop("docs"))

    # A row a language: its sources, N + 2 V of each and of all, and V.
    held = terms.select("lang", F.explode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("held"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    entries = groups.join(broadcast_if_small(held), ["lang", "i"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "source", F.coalesce("held", F.lit(0)).alias("held")))).alias("all"))
    langs = entries.join(sizes, "lang", "left").selectExpr(
        "lang", "coalesce(v, 0L) as v", "coalesce(total, 0L) + 2 * coalesce(v, 0L) as whole", "transform(all, x -> x.source) as sources", "transform(all, x -> x.held + 2 * coalesce(v, 0L)) as wholes"
    )
    # Shares of a count of zero; without kept terms there are none, and every pair's sum is 0.
    langs = stored(langs.selectExpr("*", f"transform(wholes, w -> if(v = 0, 1L, {share('2L', 'w')})) as zeros"))

    wide = terms.join(broadcast_if_small(langs), "lang").selectExpr("*", "transform(wholes, (w, i) -> coalesce(counts[i], 0L)) as c")
    wide = wide.selectExpr("lang", "term", "c", "zeros", f"{share('(n + 2)', 'whole')} as q", f"transform(wholes, (w, i) -> {share('(c[i] + 2)', 'w')}) as p")

    more = f"{apart('x', 'y')} - {apart('zeros[i]', 'zeros[i + k + 1]')}"
    sent = wide.selectExpr("lang", f"""inline(flatten(transform(p, (x, i) -> filter(
        transform(slice(p, i + 2, size(p)), (y, k) -> named_struct('i', i, 'j', i + k + 1, 'v', if(c[i] + c[i + k + 1] > 0, {more}, null))),
        s -> s.v is not null))))""")  # fmt: skip
    sums = sent.groupBy("lang", "i", "j").agg(F.sum("v").alias("more"))
    both = langs.selectExpr("lang", "v", "sources", "zeros", "posexplode(sources) as (a, source)").selectExpr("*", "posexplode(sources) as (b, item)").where("a <> b")
    both = both.selectExpr("lang", "source", "item", "least(a, b) as i", "greatest(a, b) as j", f"v * {apart('zeros[a]', 'zeros[b]')} as base")
    pairs = both.join(sums, ["lang", "i", "j"], "left").selectExpr("lang", "source", "'pair' as part", "item", "base + coalesce(more, 0L) as value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    over = wide.selectExpr("lang", "term as item", f"inline(filter(transform(p, (x, i) -> named_struct('i', i, 'value', if(c[i] > 0 and x > q, {apart('x', 'q')}, null))), s -> s.value is not null))")
    order = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    over = over.join(broadcast_if_small(groups), ["lang", "i"]).selectExpr("lang", "source", "'term' as part", "item", "value", "rank")
    return pairs.unionByName(over)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
