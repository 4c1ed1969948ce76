"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

N-grams are of whole words in lower case, which 64-bit hashes stand for; nothing else about a text is folded or left
out. All n-grams fall into ROUNDS parts by their middle word, and a round counts its part of the trusted text's
n-grams, joins counts, contexts and lower orders by n-gram, and joins the values with its part of the n-grams of the
texts to score. So only a part of all n-grams lies on disk at a time, and what a round moves grows with the text.

A text's log probability is a sum of one value for each of its n-grams, seen or not, so only sums by text come back.
Values are whole numbers of 1 / UNIT, so sums do not depend on their order. Texts ask a slice at a time: a bucket gets
how many n-grams each text of the slice asks it for and 48 bits of each, and sends back a number for each text.
N-grams that make up more than one in HOT of the trusted text (words: in HOT_WORDS) are no matter of joins: there are
so many of them at most a kind, tasks hold their values, and no task gets all texts' questions for a frequent word.

Texts are cut into words once. What is kept of them is a number of three bytes for each of the COMMON most frequent
words of the trusted text, whose hashes and values tasks hold, and the hash of every other word; rounds start from that.

Below single words, in place of a uniform distribution, stands how a word is spelt: the chances of each byte after
each other byte, a table of 256 times 256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, PACKED, SPACE, bucket_of, extended, forget, mix, packed, partitions, plain_names, slices, stored, table, text_buffer, to_buckets, unpacked, word_bounds, words

WORD_ORDER = 3
#: Hashes of the marks before a text (which has two of the first) and after it.
BEFORE, AFTER = mix(np.array([1, 2], np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rounds: one for each so many bytes of text, and no more than so many.
ROUND_BYTES, ROUNDS = 32 << 20, 16
HOT, HOT_WORDS = 1 << 15, 1 << 18
SLICE, CACHED = 4 << 20, 1 << 19
#: Words that tasks hold, and a slice of texts in terms of them: text_key and number of symbols of each text, three bytes
#: (in columns of their own, which compress better) of each symbol's number, from 1, and the hashes of those without one.
COMMON = 1 << 18
CUT_NAMES = ["owners", "sizes", "low", "middle", "high", "rare"]
CUT = ", ".join(f"{c} binary" for c in CUT_NAMES)
UNIT = 1 << 22
#: Of the trusted documents kept back from training, this share lies within its language's threshold.
QUANTILE = 0.98
BROADCAST_LABELS = 2_000_000
#: What a trigram abc has besides the key of ab: b's key, the word c's hash (all other keys follow) and how often it occurs in a slice.
TRIGRAM = np.dtype([("b", "<u8"), ("c", "<u8"), ("n", "<u4")])
#: The same once ab is done with: (its count - discount) over what its context gives away, and its count.
RATIO = np.dtype([("b", "<u8"), ("c", "<u8"), ("x", "<f4"), ("n", "<u4")])
#: A row of RATIO can be a context (x: its value) or a pair (x: its probability, n: its value, b: how often it occurs) as well.
_TRIGRAM, _IS_CONTEXT, _IS_PAIR = np.arange(3, dtype=np.uint64)


def _marked(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id of trusted documents (quality 1): those to train on, and the fifth kept back."""
    marks = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    back = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return marks.where(~back), marks.where(back)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else ids


def discounts(counts: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(float(min(max(x, 0.05), k + 0.95)) for k, x in enumerate(d))


class Held:
    """Keys of so many bits that a task holds, to be found among many."""

    def __init__(self, keys: np.ndarray, bits: int = 64):
        self.place = np.argsort(keys).astype(np.int32)
        self.keys, self.shift = keys[self.place], np.uint64(bits - 20)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """By the first 20 bits of a key: where such keys begin, and whether there are several."""
        n = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << 20)
        return np.minimum(np.cumsum(n) - n, max(len(self.keys) - 1, 0)).astype(np.int32), n > 1

    def find(self, keys: np.ndarray, slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The number of each key, -1 for those that aren't held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = (keys >> self.shift).astype(np.int64)
        at = slots[0][slot]
        there = self.keys[at] == keys
        look = np.flatnonzero(slots[1][slot] & ~there)
        at[look] = np.minimum(np.searchsorted(self.keys, keys[look]), len(self.keys) - 1)
        there[look] = self.keys[at[look]] == keys[look]
        return np.where(there, self.place[at], -1).astype(np.int32)


def symbols_of(data: np.ndarray, offsets: np.ndarray, cut: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' symbols, and how many each has.

    A text is two marks, its words in lower case, and a mark. Words are hashed a few texts at a time, in what a
    processor's cache holds, unless the words are given.
    """
    if cut is None:
        at = np.concatenate([[0], np.flatnonzero(np.diff(offsets[1:] // CACHED)) + 1, [len(offsets) - 1]])
        hashes, count = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
        for a, b in zip(at[:-1], at[1:]):
            _, _, own, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)
            hashes.append(own)
            count.append(np.diff(first))
        hashes, count = np.concatenate(hashes), np.concatenate(count)
    else:
        hashes, count = cut
    size = count + 3
    own = np.arange(len(hashes)) + np.repeat(3 * np.arange(len(count)) + 2, count)
    symbols = np.full(size.sum(), BEFORE, np.uint64)
    symbols[own] = hashes
    symbols[np.cumsum(size) - 1] = AFTER
    return symbols, size


def coded(owners: np.ndarray, symbols: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[bytes]:
    """A slice of texts as the columns of CUT; number: that of each symbol, 0 if it isn't common."""
    planes = number.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [owners.tobytes(), size.astype(np.uint32).tobytes(), *(planes[:, k].tobytes() for k in range(3)), symbols[number == 0].tobytes()]


def opened(batches, held):
    """text_keys, symbols and sizes, a slice at a time, of texts or (with a model's held) of columns of CUT."""
    if held is None:
        for batch in slices(batches, limit=SLICE):
            yield batch.column("text_key").to_numpy().view(np.uint64), *symbols_of(*text_buffer(batch.column("text")))
        return
    hashes = np.append(np.zeros(1, np.uint64), held.value[0])
    for batch in batches:
        for row in zip(*(batch.column(c) for c in CUT_NAMES)):
            owners, size, low, middle, high, rare = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.uint64, np.uint32, np.uint8, np.uint8, np.uint8, np.uint64)))
            number = high.astype(np.int32)
            for plane in (middle, low):
                number <<= 8
                number |= plane
            symbols = hashes[number]
            symbols[number == 0] = rare
            yield owners, symbols, size.astype(int)


def middles(symbols: np.ndarray, size: np.ndarray, part: int, rounds: int) -> np.ndarray:
    """Places of the middle words of this part's trigrams."""
    own = part_of(mix(symbols), rounds) == part
    end = np.cumsum(size)
    own[end - 1] = own[end - size] = False
    return np.flatnonzero(own)


def around(symbols: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys b, ab, bc and abc of the trigrams with the middle word at places i. An n-gram's key is made from that of the n-gram without its last word, so a context has the key it has as an n-gram."""
    b, c = symbols[i], symbols[i + 1]
    key = mix(b)
    ab = longer(mix(symbols[i - 1]), b)
    return key, ab, longer(key, c), longer(ab, c)


def byte_pairs(trusted: DataFrame) -> np.ndarray:
    """Log chances of each byte after each other byte in words in lower case between single spaces.

    A line feed after a space stands for the end of a text. Pairs that training never saw count half.
    """

    def run(batches):
        count = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, limit=SLICE):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends = word_bounds(data, offsets)
            inside, data = ~SPACE[data], LOWER[data]
            pair = np.empty(len(data), np.uint16)  # of each byte of a word and the one before it
            pair[1:] = data[:-1]
            pair[starts] = 32
            pair <<= 8
            pair |= data
            count += np.bincount(pair[inside], minlength=1 << 16)
            count[32::256] += np.bincount(data[ends - 1], minlength=256)  # the space after a word
            count[32 << 8 | 10] += len(offsets) - 1
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count[found])], names=["pair", "n"])

    count = np.full(1 << 16, 0.5)
    for pair, n in trusted.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():  # 2**16 rows at most
        count[pair] += n
    count = count.reshape(256, 256)
    return np.log(count / count.sum(1, keepdims=True))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in lower case, a space after each, and where each begins."""
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    joined = np.full(at[-1], 32, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[inside] = LOWER[data[np.repeat(starts - at[:-1], size)[inside] + np.flatnonzero(inside)]]
    return joined, at


def spelt(pairs: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The log probability of each word in lower case and the space after it."""
    joined, at = _joined(data, starts, ends)
    each = pairs[np.concatenate([[32], joined[:-1]]), joined] if len(joined) else np.zeros(0)
    return np.diff(np.concatenate([[0.0], np.cumsum(each)])[at])


def after(pairs: np.ndarray) -> float:
    return float(pairs[32, 10])


def part_of(words_: np.ndarray, rounds: int) -> np.ndarray:
    return (words_ >> np.uint64(20)) % np.uint64(rounds)


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram and one more word, given by its hash."""
    return mix(key * _STEP + word)


def dealt(spark: SparkSession, rounds: int) -> int:
    """Buckets for one round's part of the n-grams: fewer than for all, so that a text has several in one."""
    return max(min(partitions(spark), 24), partitions(spark) // rounds)


def trigrams(cut: DataFrame, held, part: int, rounds: int, by_context: bool, buckets: int, run, schema: str) -> DataFrame:
    """run(k3, ab, rows, n) -> batches, over the distinct trigrams abc whose middle word is of this part; those of a pair ab (by_context) or bc are together."""

    def send(batches):
        for _, symbols, size in opened(batches, held):
            i = middles(symbols, size, part, rounds)
            b, ab, bc, k3 = around(symbols, i)
            order, begin = _groups(k3)
            one, rows = order[begin], np.zeros(len(begin), TRIGRAM)
            rows["b"], rows["c"], rows["n"] = b[one], symbols[i[one] + 1], np.diff(np.append(begin, len(order)))
            ab = ab[one]
            yield packed(np.zeros(len(one), np.uint64), ab, bucket_of(ab if by_context else bc[one], buckets), rows)

    def gather(batches):
        _, ab, rows = unpacked(batches, extra_type=TRIGRAM)
        k3 = longer(ab, rows["c"])
        order, begin = _groups(k3)
        one = order[begin]
        n = np.add.reduceat(rows["n"][order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        yield from run(k3[one], ab[one], rows[one], n)

    return to_buckets(cut.mapInArrow(send, PACKED), gather, schema, buckets)


def _batches(names: list[str], *columns: np.ndarray):
    for a in range(0, len(columns[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a : a + (1 << 17)])) for c in columns], names=names)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and where each begins in it."""
    order = np.argsort(values)
    return order, np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0])) if len(values) else np.zeros(0, int)


def _pairs(rows: np.ndarray, n: np.ndarray):
    """Of trigrams by their pairs bc: their order by pairs and where each pair begins, keys of each pair and its words, how many trigrams end in it, and how often it occurs."""
    bc = longer(rows["b"], rows["c"])
    order, begin = _groups(bc)
    one = order[begin]
    return order, begin, bc[one], rows["b"][one], mix(rows["c"][one]), np.diff(np.append(begin, len(order))), np.add.reduceat(n[order], begin) if len(begin) else n[:0]


def _counts(k3: np.ndarray, ab: np.ndarray, rows: np.ndarray, n: np.ndarray):
    """What one bucket's trigrams add to the statistics: kind, word and five numbers.

    Kinds 3 and 2: how many trigrams and pairs have a count of 1 to 4, and (of 3) their occurrences; kind "b": a word's
    pairs, their counts' sum and how many have a count of 1, 2 and more; kind "c": how many pairs end in a word.
    """
    _, _, _, b, c, cont, _ = _pairs(rows, n)
    out = [np.array([[3, 0, *((n == r).sum() for r in range(1, 5)), n.sum()], [2, 0, *((cont == r).sum() for r in range(1, 5)), 0]], np.int64)]
    for kind, word in ((0, b), (1, c)):
        order, begin = _groups(word)
        if len(begin):
            m = cont[order]
            sums = [np.add.reduceat(x.astype(np.int64), begin) for x in ((m == 1), (m == 2), (m > 2), m, np.ones_like(m))]
            out.append(np.column_stack([np.full(len(begin), kind), word[order[begin]].view(np.int64), *sums]))
    yield from _batches(["kind", "word", "x1", "x2", "x3", "x4", "x5"], *np.concatenate(out).T)


STATISTICS = "kind long, word long, x1 long, x2 long, x3 long, x4 long, x5 long"


def _off(n: str, cuts: tuple[float, float, float]):
    return F.when(F.col(n) == 1, cuts[0]).when(F.col(n) == 2, cuts[1]).otherwise(cuts[2])


class Model:
    """The lower orders of all parts, and the discounts; the highest order's values are made part by part."""

    def __init__(self, trusted: DataFrame, rounds: int = ROUNDS):
        self.rounds, self.spelling = rounds, byte_pairs(trusted)
        spellings = stored(self._spellings(trusted))
        self._hold(spellings)
        self.cut = stored(self.sliced(trusted.select("text", F.lit(0).cast("long").alias("text_key"))), compression="zstd")
        few = -(-rounds // 2)  # counting takes half the disk that scoring takes
        parts = [stored(trigrams(self.cut, self.held, part, few, False, partitions(trusted.sparkSession), _counts, STATISTICS).groupBy("kind", "word").agg(*(F.sum(f"x{k}").alias(f"x{k}") for k in range(1, 6)))) for part in range(few)]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        kinds = {r.kind: r for r in every.where("kind >= 2").groupBy("kind").agg(*(F.sum(f"x{k}").alias(f"x{k}") for k in range(1, 6))).collect()}
        self.positions = kinds[3].x5 if 3 in kinds else 0
        self.cuts = {k: discounts(tuple(kinds[k][1:5]) if k in kinds else (0, 0, 0, 0)) for k in (3, 2)}
        of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, F.col(x)))
        word = stored(every.where("kind < 2").groupBy("word").agg(of(1, "x5").alias("n"), *(of(0, f"x{k}").alias(f"x{k}") for k in range(1, 5))))
        single = word.where("n is not null")
        self.cuts[1] = discounts(tuple(single.agg(*(F.count_if(F.col("n") == r) for r in range(1, 5))).first()))
        n, off = single.agg(F.sum("n"), F.sum(_off("n", self.cuts[1]))).first()
        self.spread = off / n if n else 1.0  # of single words' chances, what goes by spelling
        own = (F.col("n") - _off("n", self.cuts[1])) / float(n or 1) + self.spread * F.exp("spelt")
        d1, d2, d3 = self.cuts[2]
        back = (F.col("x1") * d1 + F.col("x2") * d2 + F.col("x3") * d3) / F.col("x4")
        #: Each word, and the marks: its probability (not of the mark before texts), and count and share given away as a context.
        self.words = stored(word.join(spellings, "word", "left").select("word", F.when(F.col("n").isNotNull(), own).alias("p"), "spelt", "often", F.col("x4").alias("total"), back.alias("back")), compression="zstd")
        forget(word, spellings)
        forget(*parts)
        self._know()

    def _spellings(self, trusted: DataFrame) -> DataFrame:
        """word, its hash, spelt, and how often it occurs, of the trusted text's words and the mark after a text."""
        pairs = self.spelling

        def run(batches):
            for batch in slices(batches, limit=SLICE):
                data, offsets = text_buffer(batch.column("text"))
                starts, ends, hashes, _ = words(data, offsets, True)
                order, begin = _groups(hashes)
                where, n = order[begin], np.diff(np.append(begin, len(order)))
                hashes = np.append(hashes[where], AFTER)
                yield pa.RecordBatch.from_arrays([pa.array(mix(hashes).view(np.int64)), pa.array(hashes.view(np.int64)), pa.array(np.append(spelt(pairs, data, starts[where], ends[where]), after(pairs))), pa.array(np.append(n, len(offsets) - 1))], names=["word", "hash", "spelt", "often"])

        return trusted.select("text").mapInArrow(run, "word long, hash long, spelt double, often long").groupBy("word").agg(F.first("hash").alias("hash"), F.first("spelt").alias("spelt"), F.sum("often").alias("often"))

    def _hold(self, spellings: DataFrame) -> None:
        """The most frequent words, COMMON of them at most, and the marks: their hashes, the most frequent first, and keys."""
        least, room = None, COMMON
        for often, n in spellings.groupBy("often").count().orderBy(F.desc("often")).limit(COMMON).collect():
            if (room := room - n) < 0:
                break
            least = often
        found = spellings.where(F.col("often") >= least).select("hash", "often").toArrow() if least is not None else None
        hashes = found["hash"].to_numpy()[np.argsort(-found["often"].to_numpy(), kind="stable")].view(np.uint64) if found is not None else np.zeros(0, np.uint64)
        self.hashes = np.concatenate([[BEFORE, AFTER], hashes[hashes != AFTER]]).astype(np.uint64)
        self.common = Held(mix(self.hashes))
        # Sent once for all rounds: what functions take along is copied for each of them.
        self.held = spellings.sparkSession.sparkContext.broadcast((self.hashes, self.common))

    def _know(self) -> None:
        """What pairs of common words need: count and share given away of each as a context, and each one's probability."""
        keys = F.broadcast(self.words.sparkSession.createDataFrame(pa.table({"word": mix(self.hashes).view(np.int64)})))
        rows = self.words.join(keys, "word").select("word", "total", "back", "p").toArrow()
        self.known = np.full((3, len(self.hashes)), np.nan)
        place = self.common.find(rows["word"].to_numpy().view(np.uint64), self.common.slots())
        for k, name in enumerate(rows.column_names[1:]):
            self.known[k, place] = rows[name].to_numpy()
        self.worth = self.words.sparkSession.sparkContext.broadcast(self.known)

    def sliced(self, docs: DataFrame) -> DataFrame:
        """Texts (text_key and text), cut."""
        held = self.held

        def run(batches):
            common = held.value[1]
            slots = common.slots()
            for batch in slices(batches, limit=SLICE):
                symbols, size = symbols_of(*text_buffer(batch.column("text")))
                columns = coded(batch.column("text_key").to_numpy(), symbols, size, common.find(mix(symbols), slots) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], names=CUT_NAMES)

        return docs.mapInArrow(run, CUT)

    def single_values(self) -> DataFrame:
        """gram, v and n of single words, as n-grams (over their spelling) and as contexts of the second order."""
        own = F.log("p") - F.lit(float(np.log(self.spread))) - F.col("spelt")
        v = F.coalesce(own, F.lit(0.0)) + F.coalesce(F.log("back"), F.lit(0.0))
        return self.words.select(F.col("word").alias("gram"), _whole(v).alias("v"), F.greatest("often", "total").alias("n"))

    def part_values(self, part: int, most: int) -> DataFrame:
        """What each trigram, and each pair as its context or its lower order, adds to a text's log probability, as told() has it."""
        rounds, buckets, (d1, d2, d3), cuts = self.rounds, dealt(self.cut.sparkSession, self.rounds), self.cuts[3], self.cuts[2]
        held, worth, positions = self.held, self.worth, self.positions

        def ratios(k3, ab, rows, n):
            order, begin = _groups(ab)
            if not len(begin):
                return
            k3, rows, n = k3[order], rows[order], n[order]
            off = np.where(n == 1, d1, np.where(n == 2, d2, d3))
            total, given = np.add.reduceat(n, begin), np.add.reduceat(off, begin)
            out, common = np.zeros(len(k3), RATIO), held.value[1]
            slots = common.slots()
            out["b"], out["c"], out["n"] = rows["b"], rows["c"], n
            out["x"] = (n - off) / np.repeat(given, np.diff(np.append(begin, len(order))))
            here = (common.find(out["b"], slots) >= 0) & (common.find(mix(out["c"]), slots) >= 0)  # such pairs need no join
            yield packed(np.full(len(k3), _TRIGRAM), k3, bucket_of(longer(rows["b"], rows["c"]), buckets) + here * buckets, out)
            out, context = np.zeros(len(begin), RATIO), ab[order[begin]] ^ np.uint64(_CONTEXT)
            out["x"], out["n"] = np.log(given / total), total
            yield packed(np.full(len(begin), _IS_CONTEXT), context, bucket_of(context, buckets) + buckets, out)

        def pairs(batches):
            _, _, rows = unpacked(batches, extra_type=RATIO)
            yield from _batches(["bc", "b", "c", "cont", "often"], *(x.view(np.int64) for x in _pairs(rows, rows["n"].astype(np.int64))[2:]))

        def tell(batches):
            for batch in batches:
                bc, rows = batch.column("bc").to_numpy().view(np.uint64), np.zeros(len(batch), RATIO)
                rows["x"], rows["n"], rows["b"] = batch.column("p2").to_numpy(), batch.column("v").to_numpy().view(np.uint32), batch.column("often").to_numpy()
                yield packed(np.full(len(bc), _IS_PAIR), bc, bucket_of(bc, buckets), rows)

        def value(batches):
            owner, gram, rows = unpacked(batches, extra_type=RATIO)
            common, known = held.value[1], worth.value
            slots = common.slots()
            three, joined, context = (np.flatnonzero(owner == kind) for kind in (_TRIGRAM, _IS_PAIR, _IS_CONTEXT))
            joined = joined[np.argsort(gram[joined])]
            n = rows["n"][three].astype(np.int64)
            order, begin, bc, b, c, cont, often = _pairs(rows[three], n)
            b, c = common.find(b, slots), common.find(c, slots)
            off = np.where(cont == 1, cuts[0], np.where(cont == 2, cuts[1], cuts[2]))
            p2 = (cont - off) / known[0, b] + known[1, b] * known[2, c]
            v2 = np.log(p2) - np.log(known[1, b]) - np.log(known[2, c])
            p2 = p2.astype(np.float32)
            v2 = np.rint(np.where((b < 0) | (c < 0), 0, v2) * UNIT).astype(np.int32)
            far = np.flatnonzero((b < 0) | (c < 0))
            at = joined[np.searchsorted(gram[joined], bc[far])]
            p2[far], v2[far] = rows["x"][at], rows["n"][at].view(np.int32)
            v3 = np.log1p(rows["x"][three[order]].astype(float) / np.repeat(p2, cont))
            yield from told(gram[three[order]], np.rint(v3 * UNIT).astype(np.int32), n[order], most, positions, buckets)
            yield from told(bc, v2, often, most, positions, buckets)
            yield from told(gram[context], np.rint(rows["x"][context].astype(float) * UNIT).astype(np.int32), rows["n"][context].astype(np.int64), most, positions, buckets)

        tri = stored(trigrams(self.cut, self.held, part, rounds, True, buckets, ratios, PACKED))
        two = to_buckets(tri.where(F.col("bucket") < buckets), pairs, "bc long, b long, c long, cont long, often long", buckets)
        contexts = self.words.where("total is not null").select(F.col("word").alias("b"), "total", "back").where(F.shiftrightunsigned("b", 20) % rounds == part)  # part_of
        single = self.words.where("p is not null").select(F.col("word").alias("c"), F.col("p").alias("p1"))
        two = two.join(contexts.hint("shuffle_hash"), "b").join(single.hint("shuffle_hash"), "c")
        p = (F.col("cont") - _off("cont", self.cuts[2])) / F.col("total") + F.col("back") * F.col("p1")
        two = two.select("bc", p.cast("float").alias("p2"), _whole(F.log(p) - F.log("back") - F.log("p1")).alias("v"), "often")
        every = tri.withColumn("bucket", F.col("bucket") % buckets).unionByName(two.mapInArrow(tell, PACKED))
        out = stored(to_buckets(every, value, PACKED, buckets))
        forget(tri)
        return out


def told(gram: np.ndarray, v: np.ndarray, n: np.ndarray, most: int, positions: int, buckets: int):
    """Rows of n-grams' values for their buckets; those that tasks hold are rows of bucket -1, with whole keys."""
    v, hot = v.astype(np.int32), n * most > positions
    if hot.any():
        yield _rows([(-1, b"", b"", gram[hot].tobytes(), v[hot].tobytes())])
        gram, v = gram[~hot], v[~hot]
    order, cuts = _by_bucket(gram, buckets)
    gram, v = short(gram[order]), v[order]
    for k in range(0, len(cuts), 64):
        yield _rows([(bucket, b"", b"", gram[a:b].tobytes(), v[a:b].tobytes()) for bucket, a, b in cuts[k : k + 64]])


def _whole(v):
    return F.round(v * UNIT).cast("int")


#: A pair's key as a context differs from its key as an n-gram, since they can be of different parts.
_CONTEXT = 0x5DEECE66D1CE4E5B


def _asked(symbols: np.ndarray, size: np.ndarray, part: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams texts ask for in a round: the text of each place, and a row of keys for it; part -1: single words and the marks."""
    text = np.repeat(np.arange(len(size), dtype=np.uint32), size)
    if part < 0:  # each is the end of one trigram and the middle of the next; of the marks one is only this, one that
        own = np.ones(len(symbols), bool)
        own[np.cumsum(size) - size] = False
        return text[own], mix(symbols[own])[:, None]
    i = middles(symbols, size, part, rounds)
    _, ab, bc, k3 = around(symbols, i)
    return text[i], np.column_stack([k3, bc, ab ^ np.uint64(_CONTEXT)])


def short(grams: np.ndarray) -> np.ndarray:
    """The lower six bytes of each key; the bucket holds more of it."""
    return np.ascontiguousarray(grams).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6]


def widened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _by_bucket(gram: np.ndarray, buckets: int):
    """An order that brings keys of a bucket together without changing theirs, and (bucket, begin, end) of each."""
    bucket = bucket_of(gram, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])), len(order)) if len(order) else np.zeros(1, int)
    return order, [(int(bucket[order[a]]), a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, owners, counts, hashes, extra) of each row."""
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "owners", "counts", "hashes", "extra"])


def _sums(docs: DataFrame, values: DataFrame, part: int, model: Model) -> DataFrame:
    """text_key and known: the sum of the values of one round's n-grams, of all rows with a text."""
    rounds, common = model.rounds, model.held if "low" in docs.columns else None
    buckets = dealt(docs.sparkSession, rounds)
    if "gram" in values.columns:  # single words' come as rows
        most, positions = HOT_WORDS if part < 0 else HOT, model.positions

        def tell(batches):
            for batch in batches:
                yield from told(batch.column("gram").to_numpy().view(np.uint64), batch.column("v").to_numpy(), batch.column("n").to_numpy(), most, positions, buckets)

        values = values.select("gram", "v", "n").mapInArrow(tell, PACKED)
    hot = values.where("bucket < 0").select("hashes", "extra").collect()  # 3 * HOT or 2 * HOT_WORDS n-grams at most
    near = Held(np.frombuffer(b"".join(r.hashes for r in hot), np.uint64)), np.frombuffer(b"".join(r.extra for r in hot), np.int32)
    near = docs.sparkSession.sparkContext.broadcast(near)

    def ask(batches):
        held, worth = near.value
        slots, task = held.slots(), TaskContext.get().partitionId()
        for number, (owner, symbols, texts) in enumerate(opened(batches, common)):
            size, sums = len(owner), np.zeros(len(owner), np.int64)
            own, gram = _asked(symbols, texts, part, rounds)
            own, gram = np.repeat(own, gram.shape[1]), gram.ravel()  # texts in order, as their counts need it
            if len(worth):
                k = held.find(gram, slots)
                there, rest = np.flatnonzero(k >= 0), np.flatnonzero(k < 0)
                sums += np.bincount(own[there], worth[k[there]], minlength=size).astype(np.int64)  # whole numbers, far below 2**53
                own, gram = own[rest], gram[rest]
            # A slice is named by its texts, so that what a repeated task sends for others can't be taken for it.
            name = mix(np.bitwise_xor.reduce(longer(owner, np.arange(size, dtype=np.uint64)), keepdims=True) + mix(np.array([task << 32 | number], np.uint64)))
            slice_ = name.tobytes() + np.uint32(size).tobytes()
            order, cuts = _by_bucket(gram, buckets)
            own, gram = own[order], short(gram[order])
            rows = []
            for bucket, a, b in cuts:
                count = np.bincount(own[a:b], minlength=size)
                rows.append((bucket, slice_, count.astype(np.uint8 if count.max() < 256 else np.uint32).tobytes(), gram[a:b].tobytes(), b""))
            # Which texts these are, and what is known already, goes along to the place where the slice's sums meet.
            rows.append((int(bucket_of(name, buckets)[0]), slice_, b"", b"", owner.tobytes() + sums.tobytes()))
            yield _rows(rows)

    def match(batches):
        told, asked = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("owners", "counts", "hashes", "extra"))):
                (asked if row[0] else told).append(row)
        here = Held(widened(b"".join(r[2] for r in told)), 48)
        value, slots = np.append(np.frombuffer(b"".join(r[3] for r in told), np.int32), np.int32(0)), here.slots()  # at -1 nothing
        del told
        held, size = [], 0
        for k, row in enumerate(asked):
            held.append(row)
            size += len(row[2]) // 6
            if size < 1 << 20 and k + 1 < len(asked):
                continue
            texts = [int(np.frombuffer(r[0], np.uint32, 1, 8)[0]) if r[2] else 0 for r in held]
            begin = np.cumsum([0, *texts])
            counts = [np.frombuffer(r[1], np.uint8 if len(r[1]) == n else np.uint32) for r, n in zip(held, texts)]
            own = np.repeat(np.arange(begin[-1]), np.concatenate(counts).astype(np.int64))
            at = here.find(widened(b"".join(r[2] for r in held)), slots)
            sums = np.bincount(own, value[at], minlength=begin[-1]).astype(np.int64)
            rows = []
            for r, a, b in zip(held, begin[:-1], begin[1:]):
                to = int(bucket_of(np.frombuffer(r[0], np.uint64, 1), buckets)[0])
                if not r[2]:
                    rows.append((to, r[0], b"texts", b"", r[3]))
                    continue
                own, which = sums[a:b], np.flatnonzero(sums[a:b])
                own = own if np.abs(own).max() >> 31 else own.astype(np.int32)
                sparse = 3 * len(which) < 2 * (b - a)
                rows.append((to, r[0], b"", which.astype(np.uint32 if b - a > 1 << 16 else np.uint16).tobytes() if sparse else b"", (own[which] if sparse else own).tobytes()))
            yield _rows(rows)
            held, size = [], 0

    def gather(batches):
        sums, owners = {}, {}
        for batch in batches:
            for slice_, what, which, values_ in zip(*(batch.column(c).to_pylist() for c in ("owners", "counts", "hashes", "extra"))):
                size = int(np.frombuffer(slice_, np.uint32, 1, 8)[0])
                sum_ = sums.setdefault(slice_, np.zeros(size, np.int64))
                if what:
                    owners[slice_], known = np.frombuffer(values_, np.int64).reshape(2, size)
                    sum_ += known
                elif which:
                    which = np.frombuffer(which, np.uint32 if size > 1 << 16 else np.uint16)
                    sum_[which] += np.frombuffer(values_, np.int32 if len(values_) == 4 * len(which) else np.int64)
                elif values_:
                    sum_ += np.frombuffer(values_, np.int32 if len(values_) == 4 * size else np.int64)
        if sums.keys() - owners.keys():
            raise RuntimeError("a task that ran again got other texts than before")
        for slice_, owner in owners.items():
            yield from _batches(["text_key", "known"], owner, sums[slice_])

    columns = CUT_NAMES if common is not None else ["text_key", "text"]
    both = docs.select(*columns).mapInArrow(ask, PACKED).unionByName(values.where("bucket >= 0"))
    sums = to_buckets(to_buckets(both, match, PACKED, buckets), gather, "text_key long, known long", buckets)
    out = stored(sums.groupBy("text_key").agg(F.sum("known").alias("known")))
    near.destroy()
    return out


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but text, n_symbols (words, and the mark after them), and perplexity a symbol; null for null and empty texts.

    Equal texts share their n-grams' sums: those of all rows with a text, over the number of such rows.
    """
    docs, back = plain_names(docs, ("text",), ("n_symbols", "perplexity"))
    kept = [c for c in docs.columns if c != "text"]
    docs = docs.select(*kept, "text", F.xxhash64("text").alias("text_key"))
    pairs, spread, held, parts = model.spelling, model.spread, model.held, []

    def run(batches):
        common = held.value[1]
        slots = common.slots()
        for batch in slices(batches, limit=SLICE):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends, hashes, first = words(data, offsets, True)
            order, begin = _groups(hashes)
            one, which = order[begin], np.zeros(len(starts), np.int32)
            which[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(order))))
            each = spelt(pairs, data, starts[one], ends[one])[which]
            n = np.diff(first) + 1
            base = np.diff(np.concatenate([[0.0], np.cumsum(each)])[first]) + after(pairs) + n * np.log(spread)
            symbols, size = symbols_of(data, offsets, (hashes, n - 1))
            number = np.full(len(symbols), 1, np.int32)  # _hold: BEFORE, and after it AFTER
            number[np.cumsum(size) - 1] = 2
            number[np.arange(len(hashes)) + np.repeat(3 * np.arange(len(n)) + 2, n - 1)] = (common.find(mix(hashes[one]), slots) + 1)[which]
            columns = coded(batch.column("text_key").to_numpy(), symbols, size, number)
            slice_ = [pa.array([x, *[None] * (len(n) - 1)], pa.binary()) for x in columns]  # the slice's first row has it
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*kept, "text_key")), pa.array(np.where(np.diff(offsets) > 0, n, 0)), pa.array(base), *slice_], names=[*kept, "text_key", "n_symbols", "base", *CUT_NAMES])

    both = stored(docs.mapInArrow(run, extended(docs, f"text_key long, n_symbols long, base double, {CUT}", ("text", "text_key"))), compression="zstd")
    rows, cut = both.select(*kept, "text_key", "n_symbols", "base"), both.select(*CUT_NAMES).where("low is not null")
    for part in range(-1, model.rounds):
        values = model.single_values() if part < 0 else model.part_values(part, HOT)
        parts.append(_sums(cut, values, part, model))
        if part >= 0:
            forget(values)
    known = parts[0]
    for more in parts[1:]:
        known = known.unionByName(more)
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies"))
    known = stored(known.groupBy("text_key").agg(F.sum("known").alias("known")).join(copies, "text_key"))
    value = F.exp(-(F.col("base") + F.coalesce(F.col("known") / F.col("copies") / UNIT, F.lit(0.0))) / F.col("n_symbols"))
    out = rows.join(known, "text_key", "left").withColumn("perplexity", F.when(F.col("n_symbols") > 0, value))
    return back(out, without=("text",))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and keep (perplexity up to its language's threshold) of each row.

    The threshold is a quantile of perplexities of trusted documents that the model has not seen, by language; a
    language without any (a null one is a language too) takes that of all. Null and empty texts have no perplexity and
    aren't kept; without trusted text there is no threshold, and all others are kept. Repeated rows stay.
    """
    train, back = _marked(docs, labels)
    trusted = docs.select("doc_id", "text").join(_small(train), "doc_id", "left_semi")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(trusted, min(ROUNDS, 1 + size // ROUND_BYTES))
    rows = stored(perplexities(docs.select("doc_id", "lang", "text"), model))
    held = rows.join(_small(back), "doc_id", "left_semi").where("perplexity is not null")
    value = F.percentile_approx("perplexity", quantile, 10_000)
    by = held.groupBy(F.col("lang").alias("of")).agg(value.alias("own"))  # a row a language
    common = held.agg(value).first()[0]
    out = rows.join(F.broadcast(by) if by.limit(10_001).count() <= 10_000 else by, rows["lang"].eqNullSafe(by["of"]), "left")
    threshold = F.coalesce("own", F.lit(common).cast("double"))
    keep = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
