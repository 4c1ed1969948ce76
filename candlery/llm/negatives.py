"""Hard negatives: exact searches over vectors that lie sorted by (pivot, distance) in cells of the shared folder.

Vectors become integers and get one more component, so that all are equally long; then a greater inner product with an
anchor means a smaller distance to it. Each vector is stored under its nearest pivot, sorted by its distance to that.
A scan of radius R reads, for each anchor and pivot, the cells with keys within R of the anchor's own distance to the
pivot; by the triangle inequality every vector outside them is farther than R. Radii grow until what is left is too
far to matter: the k-th best so far is nearer than R, or a band ends before R.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import partitions, stored, table

POSITIVES, NEGATIVES = 5, 10
#: Negatives score from 30 to 90 hundredths of their positive.
LOW, HIGH = 30, 90
#: Pivots are means of this many rows at most (8 MB of them), those with the least hashes of vec_id.
SAMPLE, PIVOTS = 4096, 32
#: Bytes of a cell's vectors and anchors of a block.
CELL_BYTES, BLOCK = 1 << 19, 128
#: The first scan's radius as a share of the keys' spread within a pivot, and the growth of later ones.
FIRST, GROWTH = 0.125, 4.0


def numbers(vectors: DataFrame, vector: str) -> DataFrame:
    """id, label and v (little-endian 64-bit integers) of the rows that take part, one a vec_id."""
    x = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    ok = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ok)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("of")).select("id", "of.*")

    def run(batches):
        for batch in batches:
            column = batch.column("x")
            size, flat = column.value_lengths().to_numpy(), np.floor(256 * column.flatten().to_numpy()).astype("<i8")
            edges = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()), pa.array(size, pa.int32())], names=["id", "label", "v", "size"])

    return stored(rows.mapInArrow(run, "id long, label long, v binary, size int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row for each vector; shorter ones end in zeros."""
    values = column.to_pylist()
    if all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), "<i8").reshape(len(values), width)
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in values), "<i8").reshape(len(values), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in doubles while no sum passes 2**53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


class Space:
    """The common length, and the pivots' places among vectors that are made equally long."""

    def __init__(self, rows: DataFrame):
        self.width = rows.agg(F.max("size")).first()[0] or 0
        width = self.width

        def longest(batches):
            for batch in batches:
                x = matrix(batch.column("v"), width).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(1).max(initial=0))])], names=["square"])

        self.square = rows.select("v").mapInArrow(longest, "square double").agg(F.max("square")).first()[0] or 0.0
        sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(PIVOTS, min(SAMPLE, (8 << 20) // (8 * max(1, width))))).select("v").collect()]
        self.pivots = self._means(self.raised(matrix(pa.array(sample, pa.binary()), width).astype(float))) if sample else np.zeros((1, width + 1))

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.square - (x * x).sum(1)))])

    @staticmethod
    def _means(points: np.ndarray) -> np.ndarray:
        means = points[np.linspace(0, len(points) - 1, min(PIVOTS, len(points))).astype(int)]
        for _ in range(8):
            near = ((points * points).sum(1)[:, None] + (means * means).sum(1) - 2 * points @ means.T).argmin(1)
            means = np.array([points[near == k].mean(0) if (near == k).any() else means[k] for k in range(len(means))])
        return means

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To each pivot, by differences: those of near points are exact enough."""
        return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in self.pivots], axis=1)

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector has that inner product with an anchor of that squared length."""
        return np.sqrt(np.maximum(0, square + self.square - 2 * score))


def index(rows: DataFrame, space: Space) -> DataFrame:
    """All rows in cells: pivot, low and high (distances to it), and the cell's ids, labels and vectors, packed."""
    width, cell = space.width, max(16, CELL_BYTES // (8 * max(1, space.width)))

    def key(batches):
        for batch in batches:
            d = space.distances(space.raised(matrix(batch.column("v"), width).astype(float)))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "label", "v"]).columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])], names=["id", "label", "v", "pivot", "distance"])

    def pack(batches):
        for batch in batches:
            ids, labels, pivots, keys = (batch.column(c).to_numpy() for c in ("id", "label", "pivot", "distance"))
            x, starts = matrix(batch.column("v"), width), np.flatnonzero(np.diff(pivots, prepend=-1))
            cuts = np.unique(np.concatenate([starts, *(np.arange(a, b, cell) for a, b in zip(starts, [*starts[1:], len(ids)])), [len(ids)]]).astype(int))
            rows = [(pivots[a], keys[a], keys[b - 1], ids[a:b].tobytes(), labels[a:b].tobytes(), x[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["pivot", "low", "high", "ids", "labels", "vectors"])

    keyed = stored(rows.mapInArrow(key, "id long, label long, v binary, pivot int, distance double"))
    dealt = keyed.repartitionByRange(partitions(rows.sparkSession), "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    cells = dealt.mapInArrow(pack, "pivot int, low double, high double, ids binary, labels binary, vectors binary")
    return stored(cells.withColumn("cell", F.monotonically_increasing_id()))


#: What a search finds: for each anchor and band, a row and its score.
FOUND = "anchor long, band int, id long, score long"
_PACKED = ("ids", "labels", "vectors", "lows", "highs", "done", "radius", "places")


def _blocks(asked: DataFrame, space: Space) -> DataFrame:
    """Anchors in blocks, those near each other together, with each block's reach at each pivot.

    A cell is of interest from `low` to `high`; one that touches `first` to `last` was in every anchor's last scan.
    """
    width = space.width

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                n, flat = part.num_rows, {c: part.column(c) for c in part.schema.names}
                done, radius = (flat[c].to_numpy()[:, None] for c in ("done", "radius"))
                d = flat["places"].flatten().to_numpy().reshape(n, -1)
                values = [flat["id"].to_numpy(), flat["label"].to_numpy(), matrix(flat["v"], width), flat["lows"].flatten().to_numpy(), flat["highs"].flatten().to_numpy(), done, radius, d]
                reach = zip((d - radius).min(0).tolist(), (d + radius).max(0).tolist(), (d - done).max(0).tolist(), (d + done).min(0).tolist())
                reach = [{"pivot": p, "from": a, "to": b, "first": c, "last": e} for p, (a, b, c, e) in enumerate(reach)]
                kind = pa.list_(pa.struct([("pivot", pa.int32()), *((c, pa.float64()) for c in ("from", "to", "first", "last"))]))
                yield pa.RecordBatch.from_arrays([*(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values), pa.array([reach], kind)], names=[*_PACKED, "reach"])

    columns = asked.select("id", "label", "v", "lows", "highs", "done", "radius", "places")
    near = (F.array_position("places", F.array_min("places")), F.array_min("places"), F.col("id"))
    dealt = columns.repartitionByRange(partitions(asked.sparkSession), *near).sortWithinPartitions(*near)
    schema = ", ".join(f"{c} binary" for c in _PACKED) + ", reach array<struct<pivot:int,from:double,to:double,first:double,last:double>>"
    return stored(dealt.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _scan(asked: DataFrame, cells: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """FOUND rows of the cells that the anchors' radii reach and did not reach before: k of each cell, anchor and band."""
    blocks, width = _blocks(asked, space), space.width
    reach = blocks.select("block", F.inline("reach"))
    places = cells.select("cell", F.col("pivot").alias("at"), "low", "high")
    meets = (F.col("pivot") == F.col("at")) & (F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to"))
    pairs = reach.join(places, meets & ~((F.col("low") <= F.col("last")) & (F.col("high") >= F.col("first")))).select("block", "cell")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, labels, x = np.frombuffer(row["cell_ids"], "<i8"), np.frombuffer(row["cell_labels"], "<i8"), np.frombuffer(row["cell_vectors"], "<i8")
                own, kinds, done, radius = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("labels", "<i8"), ("done", "<f8"), ("radius", "<f8")))
                lows, highs = (np.frombuffer(row[c], "<i8").reshape(len(own), -1) for c in ("lows", "highs"))
                d = np.frombuffer(row["places"], "<f8").reshape(len(own), -1)[:, row["pivot"]]
                use = np.flatnonzero((row["low"] <= d + radius) & (row["high"] >= d - radius) & ~((row["low"] <= d + done) & (row["high"] >= d - done)))
                if not len(use):
                    continue
                scores = products(np.frombuffer(row["vectors"], "<i8").reshape(len(own), width)[use], x.reshape(len(ids), width))
                for q, score in zip(use.tolist(), scores):
                    fits = (labels == kinds[q]) & (ids != own[q]) if same else labels != kinds[q]
                    for band in np.flatnonzero(lows[q] <= highs[q]).tolist():
                        at = np.flatnonzero(fits & (score >= lows[q, band]) & (score <= highs[q, band]))
                        at = at[_best(score[at], ids[at], k)]
                        out.append((np.full(len(at), own[q]), np.full(len(at), band, np.int32), ids[at], score[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "band", "id", "score"])

    bodies = cells.select("cell", "pivot", "low", "high", *(F.col(c).alias(f"cell_{c}") for c in ("ids", "labels", "vectors")))
    return pairs.join(blocks.drop("reach"), "block").join(bodies, "cell").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(asked: DataFrame, cells: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """anchor, band, id, score and rank: the k rows of greatest score in each anchor's bands, exact.

    asked: id, label, v, square (its squared length), places (its distances to the pivots), lows and highs (bounds of
    its bands' scores). same: whether rows of the anchor's label, or all others, are looked for.
    """
    spark = asked.sparkSession
    ends = {r.pivot: (r.low, r.high) for r in cells.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # PIVOTS rows at most
    spans = F.array(*(F.array(*map(F.lit, ends.get(p, (float("inf"), float("-inf"))))) for p in range(len(space.pivots))))
    spread = max((b - a for a, b in ends.values()), default=0.0)
    far = lambda score: f"sqrt(greatest(0D, square + {space.square!r}D - 2 * ({score})))"
    asked = stored(asked.withColumn("done", F.lit(float("-inf"))).withColumn("radius", F.lit(max(1.0, FIRST * spread))))
    found = spark.createDataFrame([], FOUND)
    while asked.limit(1).count():
        found = stored(_ranked(found.unionByName(_scan(asked, cells, space, same, k)), k).drop("rank"))
        last = found.groupBy("anchor", "band").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        last = last.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("band", F.when(F.col("n") == k, F.col("least"))))).alias("least"))
        # What a scan must reach: beyond it a band has no row, or none as good as its k-th. Scores are whole numbers.
        rows = asked.join(last, "id", "left").withColumn("done", F.col("radius"))
        rows = rows.withColumn("needed", F.expr(f"array_max(transform(lows, (low, b) -> if(low > highs[b], 0D, {far('coalesce(least[b], low) - 0.5')})))"))
        whole = F.forall(F.zip_with("places", spans, lambda d, s: (d - F.col("radius") <= s[0]) & (d + F.col("radius") >= s[1])), lambda x: x)
        open_ = rows.where((F.col("needed") > F.col("done")) & ~whole).withColumn("radius", F.least("needed", F.col("done") * GROWTH))
        asked = stored(open_.drop("needed", "least"))
    return _ranked(found, k)


def mine(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the anchors' hard negatives.

    Components count as floor(256 * x), scores are inner products; greater ones come first, ties by smaller vec_id. An
    anchor's positives are its first `positives` other rows of the same label; each one's negatives the first
    `negatives` rows of other labels that score from `low` to `high` hundredths of it. Fewer there are fewer.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; of rows with one vec_id
    that with the least label and vector counts; shorter vectors end in zeros. No rows, or no anchors, give none.
    Other columns are not read. Scores beyond 64 bits are not defined.
    """
    rows = numbers(vectors, vector)
    space = Space(rows)
    cells, width = index(rows, space), space.width

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            d = space.distances(np.column_stack([x, np.zeros(len(x))]))
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "label", "v"]).columns, pa.array((x * x).sum(1)), pa.array(list(d), pa.list_(pa.float64()))], names=["id", "label", "v", "square", "places"])

    chosen = stored(rows.where(anchors.replace("vec_id", "id")).mapInArrow(place, "id long, label long, v binary, square double, places array<double>"))
    every = F.array(F.lit(-(1 << 60)).cast("long")), F.array(F.lit(1 << 60).cast("long"))
    near = stored(search(chosen.withColumns({"lows": every[0], "highs": every[1]}), cells, space, True, positives))

    floor = "(({0}) - pmod({0}, 100L)) div 100L"
    bounds = near.select(F.col("anchor").alias("id"), "rank", F.expr("-" + floor.format(f"(-{low} * score)")).alias("low"), F.expr(floor.format(f"({high} * score)")).alias("high"))
    bands = bounds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("bands"))
    filled = "slice(concat(transform(bands, x -> x.{0}), array_repeat({1}, {2})), 1, {2})"  # those that lack are empty, from 1 to 0
    bands = bands.selectExpr("id", f"{filled.format('low', '1L', positives)} as lows", f"{filled.format('high', '0L', positives)} as highs")
    hard = search(chosen.join(bands, "id"), cells, space, False, negatives)
    pairs = near.select(F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select(F.col("anchor").alias("anchor_id"), "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(hard, ["anchor_id", "band"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"))
