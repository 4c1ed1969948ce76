"""Benchmark decontamination with DataFrame functions only.

Words are hashed once, and window hashes combine them by doubling. A set of the benchmark's window hashes, as bits of
one array that goes to every task, sorts out nearly all windows inside each document's row. The few that remain are
joined with the windows' own words, so a hit is exact: by broadcast while the windows' text is small, and by a shuffled
join beyond that. A benchmark with more windows than the set has room for is taken in blocks, one after the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER_ASCII, UPPER_ASCII, plain_names, stored, table

WINDOW = 10
#: What stands between words, after lower-casing: all ASCII but digits and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
HEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Windows in a block, and bits of the set for each: 1 MB at most, and at most one in 8 windows passes by chance.
BLOCK, BITS_EACH = 1 << 20, 8
BROADCAST_BYTES = 32 << 20


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER_ASCII, LOWER_ASCII), GAPS), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: its words, how many, and the ids of the items that hold it.

    Items without an id or without words have no window; one with fewer words than a window is one itself.
    """
    words = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array(split_words(F.col("text")))).alias("words"))
    size = F.size("words")
    at = F.explode(F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1))))
    rows = words.where(size > 0).select("item_id", "words", at.alias("at")).select("item_id", F.expr(f"slice(words, at, {window})").alias("words"))
    return rows.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("k", F.size("words"))


def with_window_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (with words) and, for each length k, a column h<k>: hashes of the runs of k words, by place.

    A hash is of the hashes of its two parts. Each step is a projection of its own, so that it is computed once.
    """
    out = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    have = {1}

    def join(a: int, b: int) -> None:
        nonlocal out
        if a + b not in have:
            n = F.greatest(F.size(f"h{a}") - b, F.lit(0))
            out = out.withColumn(f"h{a + b}", F.zip_with(F.slice(f"h{a}", F.lit(1), n), F.slice(f"h{b}", F.lit(1 + a), n), lambda x, y: F.xxhash64(x, y)))
            have.add(a + b)

    for k in sorted(lengths):
        parts = [1 << i for i in range(k.bit_length() - 1, -1, -1) if k >> i & 1]
        for i in range(1, k.bit_length()):
            join(1 << i - 1, 1 << i - 1)
        for i in range(1, len(parts)):
            join(sum(parts[:i]), parts[i])
    return out


def _bits(windows: DataFrame, count: int) -> tuple[Column, int]:
    """The set as one constant array of longs, and how many bits it has."""
    bits = 1 << max(12, (32 * count).bit_length() if count <= BLOCK // 4 else (BITS_EACH * count - 1).bit_length())
    slot = F.pmod(F.col("hash"), F.lit(bits))
    rows = windows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    out = np.zeros(bits // 64, np.int64)
    for word, value in rows:  # at most bits / 64 rows
        out[word] = value
    # As one text, which the optimizer makes an array of: a literal array would go to the JVM element by element.
    return F.split(F.lit(",".join(map(str, out.tolist()))), ",").cast("array<bigint>"), bits


def _candidates(k: int, bitmap: Column, bits: int) -> Column:
    """Of a row's runs of k words, those whose bit is set, with the place of their first word; hashes are in column h<k>."""
    hashes = F.col(f"h{k}")
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))

    def possible(i):
        slot = F.pmod(F.get(hashes, i), F.lit(bits))
        return F.getbit(F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1

    return F.transform(F.filter(starts, possible), lambda i: F.struct(i.cast("int").alias("at"), F.slice("words", i + 1, k).alias("words")))


def _found(docs: DataFrame, windows: DataFrame, count: int, lengths: list[int], broadcast: bool) -> DataFrame:
    """doc_id, text_hash, n_words and own (a row for each of docs), and at, k and items of the windows found."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(split_words(F.col("text")))).alias("words"))
    found = F.expr("array(cast(null as struct<at: int, words: array<string>>))")
    if count:
        bitmap, bits = _bits(windows, count)
        base = with_window_hashes(base, lengths)
        for k in lengths:
            found = F.concat(found, _candidates(k, bitmap, bits))
    rows = base.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.explode(found).alias("w"))
    rows = rows.select("doc_id", "text_hash", "n_words", F.col("w").isNull().alias("own"), F.col("w.at").alias("at"), F.col("w.words").alias("words"))
    known = windows.select("words", "items", "k")
    return rows.join(F.broadcast(known) if broadcast else known, "words", "left").where("own or k is not null").drop("words")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, text_hash, n_words, hit (positions of hit words, from 0), items (ids, as strings).

    Null and empty texts have no words. Rows repeated in full give a row each; a null doc_id is a value like another.
    """
    windows = benchmark_windows(items, window)
    own = F.coalesce(*(F.when(F.col("k") == k, F.get(f"h{k}", F.lit(0))) for k in range(1, window + 1)))
    windows = stored(with_window_hashes(windows, list(range(1, window + 1))).select("words", "items", "k", own.alias("hash")))
    count, size = windows.agg(F.count("*"), F.sum(F.length(F.array_join("words", " ")) + 16)).first()
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # at most `window` values
    blocks = -(-count // BLOCK) or 1
    rows = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b)
        more = _found(docs, part, count // blocks, lengths, (size or 0) // blocks <= BROADCAST_BYTES)
        rows = more if rows is None else rows.unionByName(more.where("not own"))
    rows = rows.withColumn("hit", F.when(F.col("k").isNotNull(), F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)))
    out = rows.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if("own").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """hits() as counts and a digest of the item ids."""
    return hits(docs, items, window).select(
        "doc_id", F.col("n_words").cast("long"), F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words and what follows them cut out.

    Columns other than doc_id and text pass through, whatever their names; a null text stays null.
    """
    docs, back = plain_names(docs, ("doc_id", "text"), ())
    names = {c: f"bad_{c}" for c in ("doc_id", "text_hash", "hit")}
    bad = hits(docs.select("doc_id", "text"), items, window).where(F.size("hit") > 0).select(*(F.col(c).alias(n) for c, n in names.items())).dropDuplicates([names["doc_id"], names["text_hash"]])
    same = docs["doc_id"].eqNullSafe(bad[names["doc_id"]]) & (F.xxhash64(docs["text"]) == bad[names["text_hash"]])
    if remove == "documents":
        return back(docs.join(bad, same, "left_anti"))
    hit = F.col(names["hit"])
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(hit, i)), "")
    text = F.when(hit.isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", HEAD, 0), kept))
    return back(docs.join(bad, same, "left").withColumn("text", text))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
