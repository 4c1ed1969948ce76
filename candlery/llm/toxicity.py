"""Toxicity by a weighted lexicon that labelled documents teach, matched with Aho-Corasick over folded text.

Terms are whole words and word beginnings. A term's weight is its log odds between toxic and clean training documents;
phrases that clean documents hold are exceptions. A document's score is a logistic curve over its heaviest term and
its sum of weights, normalised by length; the curve is fitted on counts of binned training documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import extended, plain_names, slices, small_batches, stored, table

#: Fixed: look-alikes of Latin letters, folded when a text holds any; dashes, quotes and wide blanks become a space.
HOMOGLYPHS = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
     "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
    | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
    | {c: " " for c in "‐‑‒–—‘’“”…　\xa0"} | {c: None for c in "​‌‍⁠\xad"}
)
ODD = re.compile("[\xa0\xadıͰ-ԯ​-⁠　０-ｚ]")
#: ASCII in one step: digits and signs that stand for letters (i, l, 1, ! and | are one letter), else a space.
FOLD = bytearray(b" " * 48 + b"oizeasgtbg" + b" " * 198)
FOLD[97:123] = b"abcdefghijkimnopqrstuvwxyz"
FOLD[128:256] = bytes(range(128, 256))
FOLD[ord("@")], FOLD[ord("$")], FOLD[ord("|")] = ord("a"), ord("s"), ord(" ")
FOLD = bytes(FOLD)
RUNS = re.compile(rb"[@$]{2,}|[@$](?![a-z])")
SHORTEST, LONGEST = 3, 8
#: A term needs this many distinct toxic training texts, and an exception this many clean ones, however many there are.
SUPPORT, CLEAN_SUPPORT = 4, 3
#: Up to this many candidate terms clean rows count only those; beyond, all terms are counted and joined as tables.
CANDIDATES = 200_000
BROADCAST_LABELS = 2_000_000
#: Labelled texts that the lexicon, the exceptions and the curve are learnt from, about: of more, those with the least
#: hashes. It bounds what the driver and each task hold of the model.
TRAINING_ROWS = 2_000_000
#: Terms and phrases that a task holds before it hands on what it has counted.
HELD_TERMS = 300_000


def fold(text: str | None) -> str:
    """Lower case without disguises: one Latin-1 character a UTF-8 byte, words between single or more spaces."""
    text = (text or "").lower()
    if not text.isascii() and ODD.search(text):
        text = text.translate(HOMOGLYPHS)
    data = text.encode("utf-8", "replace")
    if b"$" in data or b"@" in data:
        data = RUNS.sub(b" ", data)
    return f" {data.translate(FOLD).decode('latin-1')} "


def terms_of(word: str):
    yield f" {word} "
    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield f" {word[:k]}"


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of labelled rows whose crc32(doc_id) mod 5 isn't 0; equal texts with equal labels count once.

    Of more than TRAINING_ROWS such texts a sample by hash, of about so many, is taken.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, "doc_id")
    rows = rows.groupBy(F.sha2("text", 256).alias("digest"), "toxic").agg(F.first("text").alias("text"))
    rows = stored(rows.select("text", "toxic"))  # read several times
    n = rows.count()
    return rows if n <= TRAINING_ROWS else rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * TRAINING_ROWS / n))


def _counted(rows: DataFrame, known: frozenset | None) -> DataFrame:
    """For each term (of known, or all): documents with it, and which of 64 kinds of word precede it."""

    def rows_of(count, before):
        names = list(count)
        kinds = [(b := before.get(t, 0)) - (b >> 63 << 64) for t in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[t] for t in names], pa.int64()), pa.array(kinds, pa.int64())], names=["term", "n", "before"])

    def run(batches):
        count, before, docs = Counter(), {}, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs += 1
                if len(count) > HELD_TERMS:
                    yield rows_of(count, before)
                    count, before = Counter(), {}
                words, seen = fold(text).split(), {}
                for a, b in zip([""] + words, words):
                    seen.setdefault(b, a)
                mine = set()
                for word, previous in seen.items():
                    bit = 1 << (sum(previous.encode("latin-1")) & 63)
                    for term in terms_of(word):
                        if known is None or term in known:
                            mine.add(term)
                            if known is None:
                                before[term] = before.get(term, 0) | bit
                count.update(mine)
        count[""] = docs
        yield rows_of(count, before)

    return rows.select("text").mapInArrow(run, "term string, n long, before long").groupBy("term").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("before")).alias("kinds"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of terms that mark toxic rows: frequent there, in varied company, and rare in clean rows."""
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    counted = stored(_counted(toxic, None))
    n_toxic = (counted.where("term = ''").agg(F.sum("n")).first()[0]) or 0
    terms = counted.where((F.col("n") >= SUPPORT) & (F.col("kinds") >= F.least(F.lit(8), F.col("n") / 2)) & (F.col("term") != "")).select("term", F.col("n").alias("t"))
    # A term that a fourth of the clean rows holds more often than all toxic ones is out, which leaves few to count in all.
    some = _counted(clean.where(F.crc32(F.col("text").cast("binary")) % 4 == 0), None).select("term", F.col("n").alias("c"))
    terms = stored(terms.join(some, "term", "left").where("c is null or c <= t").select("term", "t"))
    known = frozenset(r.term for r in terms.collect()) if terms.limit(CANDIDATES + 1).count() <= CANDIDATES else None
    against = stored(_counted(clean, known).select("term", "n"))
    n_clean = (against.where("term = ''").agg(F.sum("n")).first()[0]) or 0
    both = terms.join(against, "term", "left").select("term", "t", F.coalesce("n", F.lit(0)).alias("c")).where("t >= c")
    weights = {}
    for term, t, c in both.toLocalIterator():
        share, n = t / (t + c), t + c
        low = (share + 1.92 / n - 1.96 * np.sqrt(share * (1 - share) / n + 0.96 / n / n)) / (1 + 3.84 / n)  # Wilson's lower bound
        if low >= 0.5:
            weights[term] = float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))
    # A longer term goes when a beginning of it weighs nearly as much.
    return {t: w for t, w in weights.items() if not any(weights.get(t[:k], -9) > w - 0.7 for k in range(1 + SHORTEST, len(t)))}


class Matcher:
    """The lexicon as an Aho-Corasick automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: frozenset[str] = frozenset()):
        import ahocorasick

        self.exceptions, self.lexicon = exceptions, lexicon
        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.machine.add_word(term, (len(term), weight))
        self.machine.make_automaton()

    def matches(self, folded: str) -> dict[int, tuple[float, str, str]]:
        """By the place of a matched word: its heaviest term's weight, the word, and the word with the one before it."""
        out: dict[int, tuple[float, str, str]] = {}
        if not self.lexicon:
            return out
        for end, (size, weight) in self.machine.iter(folded):
            at = end - size + 2
            if at in out and out[at][0] >= weight:
                continue
            word = folded[at : folded.index(" ", at)]
            last = at - 1
            while last > 0 and folded[last - 1] == " ":
                last -= 1
            phrase = f"{folded[folded.rfind(' ', 0, last) + 1 : last]} {word}"
            if word not in self.exceptions and phrase not in self.exceptions:
                out[at] = weight, word, phrase
        return out

    def features(self, text: str | None) -> tuple[float, float, list[tuple[int, float]]]:
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0, []
        total = sum(w for w, _, _ in found.values())
        return max(w for w, _, _ in found.values()), total / np.log2(2 + folded.count(" ")), [(at, w) for at, (w, _, _) in sorted(found.items())]


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float]) -> frozenset[str]:
    """Words and two-word phrases around matches that clean training rows hold and toxic ones hardly do.

    An exception needs CLEAN_SUPPORT clean rows, and four for each toxic one.
    """

    def rows_of(count):
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in count], pa.string()), pa.array([t for _, t in count], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["phrase", "toxic", "n"])

    def run(batches):
        matcher, count = Matcher(lexicon), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = matcher.matches(fold(text)).values()
                count.update((p, toxic) for p in {x for _, word, phrase in found for x in (word, phrase)})
                if len(count) > HELD_TERMS:
                    yield rows_of(count)
                    count = Counter()
        yield rows_of(count)

    n = rows.mapInArrow(run, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") != 0, F.col("n")).otherwise(0)).alias("bad"))
    return frozenset(r.phrase for r in n.where((F.col("clean") >= CLEAN_SUPPORT) & (F.col("bad") * 4 <= F.col("clean"))).collect())


def fit_curve(rows: DataFrame, lexicon: dict[str, float], exceptions: frozenset[str]) -> np.ndarray:
    """Weights of 1, the heaviest term and the log of the normalised sum: ridge logistic regression on binned rows."""

    def run(batches):
        matcher, count = Matcher(lexicon, exceptions), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top, total, _ = matcher.features(text)
                count[min(int(top * 8), 127), min(int(np.log1p(total) * 16), 127), int(toxic != 0)] += 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array(list(count.values()), pa.int64())], names=["a", "b", "toxic", "n"])

    bins = rows.mapInArrow(run, "a int, b int, toxic int, n long").groupBy("a", "b", "toxic").agg(F.sum("n").alias("n")).collect()  # 2**15 rows at most
    if not bins:
        return np.array([-3.0, 1.0, 0.0])
    data = np.array([tuple(r) for r in bins], float)
    x, y, n = np.column_stack([np.ones(len(data)), data[:, 0] / 8, data[:, 1] / 16]), data[:, 2], data[:, 3]
    weights = np.array([-1.0, 0.5, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - y)) + np.array([0.01, 1, 1]) * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1, 1])
        step = np.linalg.solve(curve, slope)
        weights = weights - step * min(1, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.array([weights[0], max(weights[1], 0), max(weights[2], 0)])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], frozenset[str], np.ndarray]:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels)
    lexicon = learn_lexicon(rows)
    exceptions = learn_exceptions(rows, lexicon)
    return lexicon, exceptions, fit_curve(rows, lexicon, exceptions)


def score(docs: DataFrame, model: tuple[dict[str, float], frozenset[str], np.ndarray]) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on) and n_matches added or replaced.

    Null and empty texts match nothing and get the curve's lowest value; repeated rows get equal scores; without
    labels nothing is known to be toxic, and every score is low.
    """
    small_batches(docs.sparkSession)
    docs, back = plain_names(docs, ("text",), ("score", "predicted", "n_matches"))
    kept = docs.columns
    lexicon, exceptions, weights = model

    def run(batches):
        matcher = Matcher(lexicon, exceptions)
        for batch in slices(batches):
            found = [matcher.features(t) for t in batch.column("text").to_pylist()]
            z = weights[0] + weights[1] * np.array([f[0] for f in found]) + weights[2] * np.log1p([f[1] for f in found])
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(f[2]) for f in found], pa.int64())], names=[*kept, "score", "predicted", "n_matches"])

    return back(docs.mapInArrow(run, extended(docs, "score double, predicted int, n_matches long")))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; columns named like those of score() keep their values."""
    docs, back = plain_names(docs, ("doc_id", "text"), ())
    return back(score(docs, learn(docs, labels)).where("predicted = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), learn(docs, labels))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return out.select("doc_id", held_out, "score", "predicted")
