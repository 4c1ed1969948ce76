"""Substring dedup by seed and extend: words of 13-word windows that a lesser document holds too are removed.

Documents meet at winnowed anchors of five words (the seeds, see winnow). The occurrences of an anchor extend side by
side, a word at a time to the right and to the left, and stay together while their words agree, so a maximal repeat
costs its length and not a comparison for each pair of occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extended, plain_names, slices, small_batches, table, text_buffer, words
from .winnow import covered, repeated_runs, with_runs

WIDTH, ANCHOR = 13, 5


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    _, _, hashed, first = words(data, offsets, lower=False)
    return data, hashed, first


def _classes(kind: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs."""
    order = np.lexsort((symbol, kind))
    a, b = kind[order], symbol[order]
    out = np.empty(len(kind), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(kind) else 0
    return out


def compare(doc, anchor, start, count, off, data, width) -> np.ndarray:
    """For each window of the segments whether a lesser document holds an equal one."""
    size = count + (width - 1)
    begin = np.cumsum(size) - size
    seed = begin + off  # the anchor's first word
    reach = width - ANCHOR
    seeds = _classes(np.zeros(len(doc), np.int64), anchor)
    sides = []
    for step in (1, -1):  # right from the anchor's end, left from its start
        edge = seed + ANCHOR if step == 1 else seed - 1
        room = begin + size - seed - ANCHOR if step == 1 else off
        kinds = [seeds]
        for k in range(reach):
            inside = room > k
            symbol = np.where(inside, data[np.clip(edge + step * k, 0, len(data) - 1)], np.uint64(0))
            # Those that end here go on alone; they hold no window that reaches further.
            kinds.append(_classes(kinds[-1] * 2 + ~inside, symbol))
        sides.append((kinds, room))
    (right, right_room), (left, left_room) = sides
    out = np.zeros(int(count.sum()), bool)
    first = np.cumsum(count) - count
    for back in range(reach + 1):
        rows = np.flatnonzero((left_room >= back) & (right_room >= reach - back))
        if not len(rows):
            continue
        same = _classes(left[back][rows], right[reach - back][rows].astype(np.uint64))
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc[rows])
        out[first[rows] + off[rows] - back] = doc[rows] > least[same]
    return out


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start and count (in words) of the runs of windows that lesser documents hold."""
    return repeated_runs(docs, symbols_of, compare, WIDTH, ANCHOR, False, np.uint64)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text as the kept words joined by one space, and n_words, n_removed and kept_sha256.

    Null has no words and stays null; texts under 13 words keep them all. Rows without a doc_id keep their words;
    repeated rows of one doc_id count as one document, each cut alike.
    """
    small_batches(docs.sparkSession)
    docs, back = plain_names(docs, ("doc_id", "text"), ("n_words", "n_removed", "kept_sha256"))
    kept = docs.columns
    rows, runs = with_runs(docs, repeated(docs.select("doc_id", "text")))

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            split = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            first = np.concatenate([[0], np.cumsum(n)])
            gone = covered(batch.column(runs), first, WIDTH)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            bodies = [b" ".join(ws if not r else [w for w, g in zip(ws, gone[a:b].tolist()) if not g]) for ws, r, a, b in zip(split, removed.tolist(), first[:-1].tolist(), first[1:].tolist())]
            texts = pa.array([b.decode() for b in bodies], pa.string(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
            columns = [texts if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(removed), pa.array([hashlib.sha256(b).hexdigest() for b in bodies])], names=[*kept, "n_words", "n_removed", "kept_sha256"])

    return back(rows.mapInArrow(run, extended(docs, "n_words long, n_removed long, kept_sha256 string")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
