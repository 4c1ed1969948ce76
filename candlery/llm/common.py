"""What several operators share: scratch tables, Arrow batches as numpy buffers, word and window hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: ASCII white space that ends a word in the word-shingle operators: tab to carriage return, and space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z on bytes; other bytes (so all of UTF-8's longer forms) stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share (spark.checkpoint.dir), removed with the session.

    Only where that is unset and everything runs in this process, as in tests, a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("candlery.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="candlery-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("candlery.scratch", base)
    path = f"{base.rstrip('/')}/candlery-{uuid.uuid4().hex}"
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: While a scratch table is written: Arrow batches of some MB, so that a task's memory does not depend on how long
#: 10,000 texts are, and no shuffle files left behind, since the table is what later jobs read.
_WHILE_STORING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """df written (with the writer's options) to the shared folder and read back: later jobs, and lost executors, start from the files."""
    path = scratch(df.sparkSession)
    with _settings(df.sparkSession, _WHILE_STORING):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that stored() wrote and no later step reads."""
    for t in tables:
        system, place = _file_system(t.sparkSession, t.stored_at)
        system.delete(place, True)


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that none of `taken` has in any case."""
    taken, name = {t.lower() for t in taken}, prefix
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(docs: DataFrame, needed: tuple[str, ...], results: tuple[str, ...]):
    """docs as an operator can work on it whatever its other columns are called, and the function that names them back.

    Columns `needed` keep their names (a column of that very name comes before one in another case); columns called
    like a result, in any case, are dropped; all others, with dots, backticks or whatever else, are c0_, c1_, ...
    back(rows, results, without) has docs' columns as docs called them, but those of `without`, and the results.
    """
    named = docs.columns
    lower = [c.lower() for c in named]
    place = {n: named.index(n) if n in named else lower.index(n.lower()) for n in needed}
    new = [f"c{i}_" for i in range(len(named))]
    for n, i in place.items():
        new[i] = n
    keep = [i for i, c in enumerate(lower) if i in place.values() or c not in {r.lower() for r in results}]

    def back(rows: DataFrame, results: tuple[str, ...] = results, without: tuple[str, ...] = ()) -> DataFrame:
        return rows.select(*(F.col(new[i]).alias(named[i]) for i in keep if new[i] not in without), *results)

    return docs.toDF(*new).select(*(new[i] for i in keep)), back


def extended(df: DataFrame, results: str, replaced: tuple[str, ...] = ()) -> T.StructType:
    """df's schema, without the columns `replaced`, and the results' fields after it."""
    return T.StructType([f for f in df.schema.fields if f.name not in replaced] + T.StructType.fromDDL(results).fields)


def with_top(rows: DataFrame, keys: list[str], value: str, by: str, top, salts: int = 64) -> DataFrame:
    """rows with column `by`: top (F.min or F.max) of value over equal keys; null keys are on their own.

    A key may hold a third of all rows: its rows meet by key and salt first, its salts afterwards, and only keys with
    several rows come back, as a table of their own, so that the join with rows can be split where it is skewed.
    """
    salt = fresh("salt", rows.columns)
    part = rows.groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(salts)).alias(salt)).agg(top(value).alias(by), F.count("*").alias("n"))
    whole = stored(part.groupBy(*keys).agg(top(by).alias(by), F.sum("n").alias("n")).where("n > 1").drop("n"))
    return rows.join(whole, keys, "left").withColumn(by, F.coalesce(by, value))


#: Bytes of a table that every task may get whole.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its rows, measured as text, are few bytes; else as it is, for Spark to shuffle and split.

    df is read for it, so it should be a stored table or a small aggregate.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows for frames of whole texts that the caller runs later, unless the session sets its own.

    With Spark's 10,000 a task's memory would depend on how long so many texts are. The setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, 1000)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.array(column.fill_null("").cast(pa.large_binary()))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of each run of `width` neighbours of a uint64 array, by doubling; not yet mixed."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out, have, power, square, got, rest = None, 0, base, values, 1, width
    while rest:  # out covers `have` symbols, square covers `got`
        if rest & 1:
            if out is None:
                out, have = square, got
            else:
                n = len(values) - have - got + 1
                out, have = out[:n] * power + square[have : have + n], have + got
        rest >>= 1
        if rest:
            n = len(square) - got
            square, got = square[:n] * power + square[got : got + n], got * 2
            power = np.uint64(int(power) * int(power) & (1 << 64) - 1)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many spans of a byte array, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _BASE + np.uint64(1))
    live, step = np.arange(len(starts)), 0
    while True:
        live = live[size[live] > step]
        if not len(live):
            return out
        left = size[live] - step
        word = eights[starts[live] + step]
        short = left < 8
        word[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix((out[live] ^ word) * _BASE + np.uint64(step))
        step += 8


def slices(batches, text: str = "text", limit: int = 8 << 20):
    """Arrow batches cut into runs of rows with about `limit` bytes of text, which bounds what numpy holds."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1, [len(sizes)]])
        for a, b in zip(cut[:-1], cut[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space of all texts of a batch: starts, ends, hashes, and each text's first word."""
    if lower:
        data = LOWER[data]
    starts, ends = word_bounds(data, offsets)
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    begins[offsets[:-1][offsets[:-1] < len(data)]] |= inside[1:-1][offsets[:-1][offsets[:-1] < len(data)]]
    stops = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= len(data))] - 1
    stops[cut] |= inside[1:-1][cut]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


#: Many small values on their way to buckets by hash: for each owner in turn `counts` of the values.
PACKED = "bucket int, owners binary, counts binary, hashes binary, extra binary"
_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("owners", "counts", "hashes", "extra"))])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(owner: np.ndarray, hashes: np.ndarray, bucket: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket. owner: 64-bit, with equal ones side by side within a bucket."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")  # 16 bits sort faster
    owner, hashes, bucket = owner[order], hashes[order], bucket[order]
    extra = extra[order] if extra is not None else None
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    runs = np.flatnonzero(new)
    counts = np.diff(np.append(runs, len(owner))).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    rows = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
        i, j = np.searchsorted(runs, (a, b))
        rows.append((int(bucket[a]), owner[runs[i:j]].tobytes(), counts[i:j].tobytes(), hashes[a:b].tobytes(), b"" if extra is None else extra[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PACKED)], schema=_PACKED)


def unpacked(batches, owner_type=np.uint64, extra_type=None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """All values of a bucket: owner, hash and extra of each."""
    owners, hashes, extras = [np.zeros(0, owner_type)], [np.zeros(0, np.uint64)], []
    for batch in batches:
        for own, counts, values, extra in zip(*(batch.column(c).to_pylist() for c in ("owners", "counts", "hashes", "extra"))):
            owners.append(np.repeat(np.frombuffer(own, owner_type), np.frombuffer(counts, np.uint32)))
            hashes.append(np.frombuffer(values, np.uint64))
            if extra_type is not None:
                extras.append(np.frombuffer(extra, extra_type))
    return np.concatenate(owners), np.concatenate(hashes), np.concatenate(extras) if extras else (np.zeros(0, extra_type) if extra_type is not None else None)


#: Text whose values a bucket is to hold at most; a task holds a bucket.
BUCKET_TEXT = 64 << 20


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """As many buckets as there are shuffle partitions, or as the text needs, so that a bucket doesn't grow with the input."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET_TEXT))


def to_buckets(rows: DataFrame, run, schema: str, buckets: int | None = None) -> DataFrame:
    """Deals PACKED rows out by bucket, one a task, and runs over each bucket's batches."""
    return rows.repartitionById(buckets or partitions(rows.sparkSession), "bucket").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id it is linked to, in any number of steps) of all ids in edges (a, b).

    Least labels spread along edges, and each round labels also jump to their label's label, so the number of rounds
    grows with the logarithm of the longest path. Each round is a stored table.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        spread = both.join(labels, both["b"] == labels["id"]).groupBy(both["a"].alias("id")).agg(F.min("component").alias("near"))
        near = spread.join(labels, "id").select("id", F.least("near", "component").alias("near"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("near"), F.col("component").alias("top"))
        new = stored(near.join(up, "near", "left").select("id", F.least("near", F.coalesce("top", "near")).alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
