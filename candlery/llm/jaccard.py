"""Exact Jaccard join of documents on word shingles, and the components of its links.

Filters come before pairs. A document can only have a partner if, among the first of its shingles in a global order,
enough are held by another document too; that is tested in two orders, by hash and by frequency among the documents
left. Pairs come from shared prefix shingles of the second order: first with each shingle's least document, then,
once linked documents are one component, only across components. A pair's prefixes in two more orders have to meet
before its sets are compared. Texts with equal sets count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import PACKED, bucket_of, buckets_for, components, mix, packed, plain_names, slices, stored, table, text_buffer, to_buckets, unpacked, window_hashes, words, with_top

SHINGLE = 5
#: Similarity in hundredths.
LEAST = 75
#: Of a document's size: how many of its first shingles in the hash order have to be shared.
SHARE = 0.1
BROADCAST_IDS = 1_000_000


def prefix_size(n: np.ndarray, more: np.ndarray | int = 1, least: int = LEAST) -> np.ndarray:
    """Sets with a partner of that similarity share at least `more` elements among this many first ones."""
    return np.minimum(n, n + (-n * least // 100) + more)


def wanted(n: np.ndarray) -> np.ndarray:
    """How many shared shingles the hash order's prefix is laid out for."""
    return np.maximum(1, (n * SHARE).astype(np.int64))


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; the text of each; the set sizes."""
    data, offsets = text_buffer(column)
    _, _, hashed, first = words(data, offsets, lower=True)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, 0))
    full = window_hashes(hashed, width)
    start = np.repeat(first[:-1], np.maximum(count - width + 1, 0))
    begin = np.cumsum(np.maximum(count - width + 1, 0)) - np.maximum(count - width + 1, 0)
    out = mix(full[start + np.arange(len(doc)) - np.repeat(begin, np.maximum(count - width + 1, 0))]) if len(doc) else np.zeros(0, np.uint64)
    for size in range(1, width):  # shorter texts: all their words
        short = np.flatnonzero(count == size)
        if len(short):
            out = np.concatenate([out, mix(window_hashes(hashed, size)[first[short]] + np.uint64(size))])
            doc = np.concatenate([doc, short])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, doc, np.bincount(doc, minlength=len(count))


def set_keys(values: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    at = np.cumsum(sizes) - sizes
    filled = sizes > 0
    out = []
    for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
        key = np.zeros(len(sizes), np.uint64)
        if len(values):
            key[filled] = np.add.reduceat(mix(values ^ np.uint64(salt)), at[filled])
        out.append(mix(key + sizes.astype(np.uint64)))
    return out[0], out[1]


def documents_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the two halves of the set's key, for each row."""

    def run(batches):
        for batch in slices(batches):
            values, doc, sizes = shingles(batch.column("text"))
            a, b = set_keys(values, doc, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", "n_shingles", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def _prefixes(docs: DataFrame, buckets: int) -> DataFrame:
    """PACKED: the hash order's prefixes of the distinct sets of each slice, owned by the first half of their key."""

    def run(batches):
        for batch in slices(batches):
            values, doc, sizes = shingles(batch.column("text"))
            key, _ = set_keys(values, doc, sizes)
            first = np.zeros(len(sizes), bool)
            first[np.unique(key, return_index=True)[1]] = True
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = first[doc] & (place < prefix_size(sizes, wanted(sizes))[doc])
            yield packed(key[doc[keep]], values[keep], bucket_of(values[keep] * np.uint64(0x9E3779B97F4A7C15), buckets))

    return docs.select("text").mapInArrow(run, PACKED)


def _shared(batches):
    """How many of each owner's values in this bucket another owner holds too."""
    owner, value, _ = unpacked(batches)
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[keep], value[keep]
    same = value[1:] == value[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not len(owner):
        shared = np.zeros(0, bool)
    who, count = np.unique(owner[shared], return_counts=True)
    for a in range(0, len(who), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(who[a : a + (1 << 16)].view(np.int64)), pa.array(count[a : a + (1 << 16)])], names=["k1", "shared"])


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n and the sorted hashes of the documents in ids."""

    def run(batches):
        for batch in slices(batches):
            values, _, sizes = shingles(batch.column("text"))
            at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "n", "hashes"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    # A document that came in several rows with different texts has a set for each; see join_documents.
    return rows.mapInArrow(run, "doc_id long, n long, hashes binary")


def _all_values(sets: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "hashes"):
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            data, _ = text_buffer(batch.column("hashes"))
            values = np.frombuffer(data.tobytes(), np.uint64)
            yield packed(np.repeat(ids, n), values, bucket_of(values * np.uint64(0x9E3779B97F4A7C15), buckets))

    return sets.select("doc_id", "n", "hashes").mapInArrow(run, PACKED)


def _frequent(batches_buckets: int):
    """Sends each value that several documents hold back to its documents' buckets, with its frequency."""

    def run(batches):
        owner, value, _ = unpacked(batches, np.int64)
        order = np.argsort(value, kind="stable")
        owner, value = owner[order], value[order]
        begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
        count = np.diff(np.append(begin, len(value)))
        frequency = np.repeat(count, count)
        keep = frequency > 1
        owner, value, frequency = owner[keep], value[keep], frequency[keep].astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        owner, value, frequency = owner[order], value[order], frequency[order]
        yield packed(owner, value, bucket_of(mix(owner.view(np.uint64)), batches_buckets), frequency)

    return run


def _rarest(batches):
    """Each document's shared values that its prefix in the order of frequency holds; none if too few are shared."""
    owner, value, frequency = unpacked(batches, np.int64, np.uint32)
    order = np.lexsort((value, frequency, owner))
    owner, value = owner[order], value[order]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    count = np.diff(np.append(begin, len(owner)))
    place = np.arange(len(owner)) - np.repeat(begin, count)
    for a in range(0, len(owner), 1 << 17):
        part = slice(a, a + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(owner[part]), pa.array(value[part].view(np.int64)), pa.array(place[part]), pa.array(np.repeat(count, count)[part])], names=["doc_id", "token", "place", "shared"])


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted sets reach the similarity; first whether their prefixes meet, in two orders by hash."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    p, q = int(prefix_size(np.int64(len(a)), 1, least)), int(prefix_size(np.int64(len(b)), 1, least))
    for x, y in ((a[:p], b[:q]), (a[-p:], b[-q:])):
        at = np.searchsorted(y, x)
        if not (y[np.minimum(at, len(y) - 1)] == x).any():
            return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(h, np.uint64) for h in batch.column(c).to_pylist()] for c in ("x", "y"))
            good = pa.array([similar(p, q) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _sketched(sets: DataFrame, bits: int = 1024) -> DataFrame:
    """doc_id and the parity of its hashes by slot, as 64-bit columns: two sets differ in at least as many elements as sketches in bits."""
    n_words = bits // 64

    def run(batches):
        for batch in batches:
            ids, n = batch.column("doc_id"), batch.column("n").to_numpy()
            data, _ = text_buffer(batch.column("hashes"))
            slot = (np.frombuffer(data.tobytes(), np.uint64) % np.uint64(bits)).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            odd = (np.bincount(row * bits + slot, minlength=len(n) * bits) & 1).astype(np.uint8).reshape(len(n), bits)
            cells = np.packbits(odd, axis=1).view(np.int64).reshape(len(n), n_words)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(n_words))], names=["doc_id", *(f"s{i}" for i in range(n_words))])

    return sets.select("doc_id", "n", "hashes").mapInArrow(run, "doc_id long, " + ", ".join(f"s{i} long" for i in range(n_words)))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id) of each row, and components (id, component) of the linked classes.

    A class is the texts with one set, named by its least doc_id.
    """
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    rows = with_top(stored(documents_keys(docs.where("doc_id is not null"))), ["k1", "k2", "n_shingles"], "doc_id", "class_id", F.min)
    rows = stored(rows.withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))))
    classes = rows.where("n_shingles > 0 and doc_id = class_id").select("k1", "n_shingles", "class_id").distinct()
    shared = to_buckets(_prefixes(docs, buckets), _shared, "k1 long, shared long", buckets).groupBy("k1").agg(F.sum("shared").alias("shared"))
    enough = F.greatest(F.lit(1), F.floor(F.floor(F.col("n_shingles") * (LEAST / 100) * SHARE)))
    chosen = stored(classes.join(shared, "k1").where(F.col("shared") >= enough).select(F.col("class_id").alias("doc_id")))
    sets = stored(_sets(docs, chosen))
    back = to_buckets(_all_values(sets, buckets), _frequent(buckets), PACKED, buckets)
    tokens = to_buckets(back, _rarest, "doc_id long, token long, place long, shared long", buckets).join(sets.select("doc_id", "n"), "doc_id")
    fewest = F.ceil(F.col("n") * LEAST / 100)
    # Of the prefix of n - fewest + 1, the n - shared elements that nobody shares come first.
    tokens = stored(tokens.where((F.col("shared") >= fewest) & (F.col("place") < F.col("shared") - fewest + 1)).select("token", "doc_id", "n", "shared"))
    least = tokens.groupBy("token").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).where("size > 1").select("token", "a")
    near = (F.col("n") * 100 >= F.col("m") * LEAST) & (F.col("m") * 100 >= F.col("n") * LEAST)
    # What two sets have in common both share with another document, so no pair has more in common than either shares.
    near = near & ((F.col("n") + F.col("m")) * LEAST <= F.least("shared", "shared_m") * (100 + LEAST))
    size_of = tokens.select(F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("shared").alias("shared_m")).distinct()
    star = tokens.join(least, "token").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), "n", "shared").distinct().join(size_of, "a").where(near).select("a", "b")
    star = stored(star)
    found = _verified(star, sets)
    first = components(found)
    # What is left: pairs in different components that share a prefix token.
    marked = tokens.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    marked = stored(marked.join(mixed, "token"))
    sketch = _sketched(sets.join(marked.select("doc_id").distinct(), "doc_id", "left_semi"))
    sketch = stored(sketch)
    marked = marked.join(sketch, "doc_id")
    cells = [c for c in sketch.columns if c != "doc_id"]
    other = marked.select(F.col("token"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("shared").alias("shared_m"), F.col("component").alias("other"), *(F.col(c).alias(f"o{c}") for c in cells))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in cells), F.lit(0))
    cross = marked.join(other, "token").where((F.col("component") < F.col("other")) & near & (apart * (100 + LEAST) <= (F.col("n") + F.col("m")) * (100 - LEAST)))
    cross = cross.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = _verified(cross, sets)
    # A doc_id that came with several texts is one document: their classes are linked through it.
    several = rows.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b")
    several = rows.join(several.select("doc_id", "a"), "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b"))
    return rows.select("doc_id", "n_shingles", "class_id"), components(found.union(more).union(several))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links, itself included) of each row.

    Texts without words, null ones too, have no shingles and no links. Rows without a doc_id are left out; repeated
    rows stay. Rows that share a doc_id but not the text are one document, with the links of all its texts; n_shingles
    is that of the row's own text.
    """
    rows, linked = links(docs)
    linked = linked.select(F.col("id").alias("class_id"), F.col("component").alias("component_id"))
    return rows.join(linked, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the least doc_id of each component only; rows without a doc_id stay."""
    docs, back = plain_names(docs, ("doc_id", "text"), ())
    keep = join_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    return back(docs.where("doc_id is null").unionByName(docs.join(keep, "doc_id", "left_semi")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
