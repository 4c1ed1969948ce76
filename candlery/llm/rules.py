"""Quality rules: counts that each text gives by itself, and lines that too many documents of a host share.

A line's hash ignores case, digits and blanks. For each host the distinct documents with a line are counted; lines
above the limit are removed, and documents of which too little is left are rejected. Only hashes travel, not texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import LOWER, SPACE, broadcast_if_small, mix, plain_names, slices, small_batches, span_hashes, stored, table, text_buffer, window_hashes, words

WINDOW = 8
#: A line goes if more than this many distinct documents of its host, and more than this share of them, hold it.
MIN_DOCS, MAX_PERCENT = 10, 1
#: A document of whose words less than this share is left is rejected.
LEFT_PERCENT = 30
#: Fixed: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: A line as it is compared: A-Z lowered, each digit 0.
_NORMAL = LOWER.copy()
_NORMAL[48:58] = 48
#: Bytes of text that a task works on at a time; its arrays take some 50 times as much.
SLICE = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*LONGS, "base_failed", "n_cut", "kept")
_LINES = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())]))


def _copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys come more than once, and which of them are not the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = many[order[:-1][same]] = True
    return many, later


class Texts:
    """Words and lines of a batch of texts. A line is what stands between \\n; those without a word are left out."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffer(column)
        self.starts, self.ends, self.hashes, self.first = words(self.data, self.offsets, lower=False)
        data, offsets, texts = self.data, self.offsets, np.arange(len(self.offsets) - 1)
        breaks = np.flatnonzero(data == 10)
        of = np.concatenate([texts, np.searchsorted(offsets, breaks, "right") - 1])
        begin = np.concatenate([offsets[:-1], breaks + 1])
        end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[of + 1])
        word, after = np.searchsorted(self.starts, begin), np.searchsorted(self.starts, end)
        order = np.flatnonzero(after > word)
        order = order[np.argsort(word[order])]
        self.line_of, self.begin, self.end, self.word, self.size = of[order], begin[order], end[order], word[order], (after - word)[order]

    def counted(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.offsets])

    def counts(self) -> list[np.ndarray]:
        """LONGS."""
        inside = ~SPACE[self.data]
        salt = mix(np.arange(len(self.offsets) - 1, dtype=np.uint64) + _BASE)  # equal ones of different texts are apart
        _, later = _copies(mix(span_hashes(self.data, self.begin, self.end) ^ salt[self.line_of]))
        n = np.diff(self.first)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(np.arange(len(owner)) + WINDOW <= self.first[owner + 1])
        many, _ = _copies(mix(window_hashes(self.hashes, WINDOW)[at] ^ salt[owner[at]])) if len(at) else (np.zeros(0, bool), None)
        steps = np.bincount(at[many], minlength=len(owner) + 1) - np.bincount(at[many] + WINDOW, minlength=len(owner) + 1)
        repeated = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(steps)[: len(owner)] > 0)])[self.first])
        return [n, self.counted(inside & (self.data & 0xC0 != 0x80)), self.counted(_SYMBOL[self.data]), np.bincount(self.line_of[later], minlength=len(n)), repeated]

    def lines(self) -> np.ndarray:
        """Hash of each line as it is compared."""
        if not len(self.word):
            return np.zeros(0, np.int64)
        place = np.arange(len(self.starts)) - np.repeat(self.word, self.size)
        power = np.cumprod(np.full(int(self.size.max()), _BASE, np.uint64), dtype=np.uint64)
        sums = np.add.reduceat(span_hashes(_NORMAL[self.data], self.starts, self.ends) * power[place], self.word)
        return mix(sums + self.size.astype(np.uint64)).view(np.int64)


def measured(docs: DataFrame, carried: list[str]) -> DataFrame:
    """carried columns, LONGS, and lines: each distinct line's hash with its words in the text."""

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            texts = Texts(batch.column("text"))
            hashes, size = texts.lines(), texts.size
            order = np.lexsort((hashes, texts.line_of))
            of, hashes, size = texts.line_of[order], hashes[order], size[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])]) if len(of) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            total = np.add.reduceat(size, at) if len(at) else np.zeros(0, np.int64)
            offsets = np.searchsorted(of[at], np.arange(len(texts.offsets)))
            lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(hashes[at], pa.int64()), pa.array(total, pa.int64())], names=["line", "words"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(c, pa.int64()) for c in texts.counts()), lines], names=[*carried, *LONGS, "lines"])

    schema = T.StructType([*docs.select(*carried).schema.fields, *(T.StructField(c, T.LongType()) for c in LONGS), T.StructField("lines", _LINES)])
    return docs.mapInArrow(run, schema)


def shared_lines(texts: DataFrame, min_docs: int, max_percent: int) -> DataFrame:
    """host, digest, line and words of the lines above the limits; texts (host, digest, lines) are distinct documents."""
    lines = texts.select("host", "digest", F.inline("lines"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    sizes = texts.groupBy("host").agg(F.count("*").alias("docs"))
    limits = stored(often.join(broadcast_if_small(sizes), "host").where(F.col("n") * 100 > F.col("docs") * max_percent).select("host", "line"))
    return lines.join(broadcast_if_small(limits), ["host", "line"])


def _marked(docs: DataFrame, host: str, results: tuple[str, ...]):
    docs, back = plain_names(docs, ("text", host), results)
    small_batches(docs.sparkSession)
    return docs.withColumns({"host": F.coalesce(F.col(host).cast("string"), F.lit("")), "digest": F.md5(F.coalesce("text", F.lit("")))}), back


def _verdict(rows: DataFrame, left_percent: int) -> DataFrame:
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rows = rows.withColumn("n_cut", F.coalesce("n_cut", F.lit(0))).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & ((F.col("n_words") - F.col("n_cut")) * 100 >= F.col("n_words") * left_percent))


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """docs without text but with RESULTS, which replace columns of such names in any case.

    Words stand between ASCII blanks. word_chars: characters in words; n_symbols: characters of SYMBOLS; n_dup_lines:
    lines with a word that equal an earlier one; n_repeat_words: words in windows of 8 that the text holds more than
    once; base_failed: under 20 words, or more than 30 % of them repeated so; n_cut: words in lines that more than
    min_docs documents, and more than max_percent of them, of the host hold; kept: not base_failed, and at least
    left_percent of the words are left.

    Documents are a host's distinct texts, so that copies, and rows repeated or without doc_id, count once and get
    equal results. A null host is a host (''); null and empty texts have no words and fail.
    """
    rows, back = _marked(docs, host, RESULTS)
    rows = stored(measured(rows, [c for c in rows.columns if c != "text"]))
    texts = stored(rows.groupBy("host", "digest").agg(F.first("lines").alias("lines")))
    cut = shared_lines(texts, min_docs, max_percent).groupBy("host", "digest").agg(F.sum("words").alias("n_cut"))
    return back(_verdict(rows.drop("lines").join(cut, ["host", "digest"], "left"), left_percent), RESULTS, without=("text",))


def clean(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The documents that judge() keeps, with its columns, and with text without the lines above the limits.

    A text without such lines stays as it is; of others the remaining lines are joined by \\n.
    """
    rows, back = _marked(docs, host, RESULTS)
    texts = stored(measured(rows, ["host", "digest"]).groupBy("host", "digest").agg(*(F.first(c).alias(c) for c in (*LONGS, "lines"))))
    cut = shared_lines(texts, min_docs, max_percent).groupBy("host", "digest").agg(F.sum("words").alias("n_cut"), F.collect_list("line").alias("gone"))
    kept = _verdict(texts.drop("lines").join(cut, ["host", "digest"], "left"), left_percent).where("kept")
    rows = rows.join(kept, ["host", "digest"])
    names, schema = rows.columns, rows.schema

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            texts, gone = Texts(batch.column("text")), batch.column("gone").to_pylist()
            hashes, out = texts.lines(), batch.column("text").to_pylist()
            for k in (k for k, lines in enumerate(gone) if lines):
                a, b = np.searchsorted(texts.line_of, (k, k + 1))
                use = [texts.data[x:y].tobytes() for x, y, h in zip(texts.begin[a:b], texts.end[a:b], hashes[a:b].tolist()) if h not in set(gone[k])]
                out[k] = b"\n".join(use).decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return back(rows.mapInArrow(run, schema), RESULTS)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")
