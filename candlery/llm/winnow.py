"""Repeated windows across documents, found through winnowed anchors.

Each window of `width` symbols holds an anchor: the run of `anchor` symbols with the least hash in it. Neighbouring
windows mostly share it, and such a run of windows is a segment, so equal windows of any documents lie in segments of
the same anchor. Segments are dealt out by anchor, not by document:

1. Segments that are equal as a whole settle at once: all but the earliest are repeats from end to end. Equal segments
   of one slice of input settle before the shuffle, which thins out groups of copies where they are largest.
2. Only the earliest of segments that share an anchor but differ are sent out with their symbols, and a `compare`
   function finds their common windows.

Segments can be split further without losing a window: of the symbols around an anchor, a window holds at least half
either before or after it, so segments part into windows of the one kind and of the other, and each goes by that longer
run of symbols in place of the anchor. An anchor with more than HOT differing segments is split so before they are sent
out, and what a task gets is split so once more, since a part whose run nobody shares needs no comparison.

What comes back are runs of repeated windows, which the caller joins with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import PACKED, bucket_of, buckets_for, fresh, mix, packed, slices, stored, to_buckets, unpacked, window_hashes

#: seg: hash of the segment; start: its first symbol in the document; count: its windows; off: its anchor's place.
SEGMENT = np.dtype([("seg", "<u8"), ("start", "<u4"), ("count", "<u2"), ("off", "u1"), ("settled", "u1")])
#: A hash for each byte, which stands for it as a symbol.
SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
RUNS = "doc_id long, start long, count long"
HOT = 4096
#: Bytes of segments that are compared at once; one anchor's are not cut.
COLLECTION = 4 << 20


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each run of `width` neighbours; values count by their upper 40 bits."""
    reach, out = 1 << 24, []
    for a in range(0, max(1, len(values) - width + 1), reach - width + 1):
        part = values[a : a + reach]
        least = part & ~np.uint64(reach - 1) | np.arange(len(part), dtype=np.uint64)  # the place decides between equal ones
        have = 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        rest = width - have
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        out.append((least & np.uint64(reach - 1)).astype(np.int64) + a)
    return np.concatenate(out)


def segments(symbols: np.ndarray, first: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that are symbols[first[i]:first[i + 1]]: text of each segment, its anchor's hash, and its SEGMENT."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, SEGMENT)
    if len(symbols) < width:
        return empty
    hashes = mix(window_hashes(symbols, anchor))
    at = least_positions(hashes, width - anchor + 1)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)[: len(at)]
    valid = np.arange(len(at)) + width <= first[doc + 1]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return empty
    length = np.add.reduceat(valid.astype(np.int64), start)
    whole = window_hashes(symbols, width, np.uint64(0xC2B2AE3D27D4EB4F))
    out = np.zeros(len(start), SEGMENT)
    off = at[start] - start
    # The first and the last window cover the segment.
    out["seg"] = mix(whole[start] ^ mix(whole[start + length - 1] + (length * 256 + off).astype(np.uint64)))
    out["start"], out["count"], out["off"] = start - first[doc[start]], length, off
    return doc[start], hashes[at[start]], out


def _earliest(doc: np.ndarray, start: np.ndarray, group: np.ndarray, same_doc: bool) -> np.ndarray:
    """Rows sorted by group, doc and start: whether a row is its group's earliest (or, not same_doc, of its earliest document)."""
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    back = np.repeat(begin, np.diff(np.append(begin, len(group))))
    same = doc == doc[back]
    return same & (start == start[back]) if same_doc else same


def _settle(doc: np.ndarray, anchor: np.ndarray, seg: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, segment, doc, start); which rows in that order are earliest; how many different segments their anchors have."""
    order = np.lexsort((seg["start"], doc, seg["seg"], anchor))
    doc, anchor, seg = doc[order], anchor[order], seg[order]
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, np.int64)
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], seg["seg"][1:] != seg["seg"][:-1]])
    first = _earliest(doc, seg["start"], np.cumsum(new), same_doc)
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))
    return order, first, kinds[np.cumsum(new_anchor) - 1]


def split(symbols: np.ndarray, base: np.ndarray, anchors: np.ndarray, seg: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of segments (base: where their texts begin in symbols) by their windows' longer side: which segment, key and SEGMENT."""
    half = (width - anchor + 1) // 2
    off, count = seg["off"].astype(np.int64), seg["count"].astype(np.int64)
    longer = mix(window_hashes(symbols, anchor + half, np.uint64(0xA0761D6478BD642F)))
    place = base + seg["start"] + off
    cut = np.clip(off - half, 0, count)  # windows before it have at least half of the rest in front of the anchor
    which, keys, parts = [], [], []
    for begin, end, at in ((np.zeros_like(cut), cut, place - half), (cut, count, place)):
        i = np.flatnonzero(end > begin)
        part = seg[i].copy()
        part["start"] += begin[i].astype(np.uint32)
        part["count"], part["off"] = end[i] - begin[i], off[i] - begin[i]
        which.append(i)
        keys.append(mix(anchors[i] ^ longer[at[i]] + np.uint64(len(which))))
        parts.append(part)
    return np.concatenate(which), np.concatenate(keys), np.concatenate(parts)


def repeated_runs(docs: DataFrame, symbols_of, compare, width: int, anchor: int, same_doc: bool, symbol: type) -> DataFrame:
    """RUNS: for each document the runs of windows that start earlier too.

    symbols_of(column) -> symbols, first: all texts of a batch as hashed symbols, and each one's first.
    symbol: what a differing segment is sent as, np.uint8 (the text's bytes) or np.uint64 (the hashed symbols).
    compare(doc, anchor, start, count, off, data, width) -> flags, for windows one after the other.
    same_doc: whether a window repeats if it starts earlier in its own document; else in a lesser doc_id only.
    """
    buckets = buckets_for(docs)
    limit = (2 if symbol is np.uint8 else 8) << 20  # a symbol a byte takes more memory than one a word
    docs = docs.where("doc_id is not null").select("doc_id", "text")

    def cut(batches):
        for batch in slices(batches, limit=limit):
            _, symbols, first = symbols_of(batch.column("text"))
            text, anchors, seg = segments(symbols, first, width, anchor)
            doc = batch.column("doc_id").to_numpy()[text]
            order, early, _ = _settle(doc, anchors, seg, same_doc)
            doc, anchors, seg = doc[order], anchors[order], seg[order]
            seg["settled"] = ~early
            bucket = np.where(early, bucket_of(mix(anchors), buckets), bucket_of(mix(doc.view(np.uint64)), buckets))
            order = np.lexsort((seg["start"], doc, bucket))
            yield packed(doc[order], anchors[order], bucket[order], seg[order])

    def gather(batches):
        doc, anchors, seg = unpacked(batches, np.int64, SEGMENT)
        known = seg["settled"] == 1
        out = [(doc[known], anchors[known], seg[known], np.zeros(known.sum(), bool), np.zeros(known.sum(), bool))]
        doc, anchors, seg = doc[~known], anchors[~known], seg[~known]
        order, early, kinds = _settle(doc, anchors, seg, same_doc)
        doc, anchors, seg = doc[order], anchors[order], seg[order]
        use = ~early | (kinds > 1)
        out.append((doc[use], anchors[use], seg[use], early[use], kinds[use] > HOT))
        for doc, anchors, seg, ask, hot in out:
            order = np.lexsort((seg["start"], doc))
            for a in range(0, len(order), 1 << 17):
                i = order[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(seg["start"][i].astype(np.int64)), pa.array(seg["count"][i].astype(np.int64)), pa.array(ask[i]), pa.array(anchors[i].view(np.int64)), pa.array(seg["off"][i].astype(np.int32)), pa.array(hot[i])],
                                                 names=["doc_id", "start", "count", "ask", "anchor", "off", "hot"])

    found = stored(to_buckets(docs.mapInArrow(cut, PACKED), gather, f"{RUNS}, ask boolean, anchor long, off int, hot boolean", buckets))
    asked = found.where("ask").groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "off", "anchor", "hot")).alias("asked"))
    schema = "bucket int, docs binary, anchors binary, segs binary, data binary"

    def send(batches):
        for batch in slices(batches, limit=limit):
            data, symbols, first = symbols_of(batch.column("text"))
            source = data if symbol is np.uint8 else symbols
            asked = batch.column("asked").combine_chunks() if isinstance(batch.column("asked"), pa.ChunkedArray) else batch.column("asked")
            per = np.diff(asked.offsets.to_numpy())
            start, count, off, anchors = (asked.flatten().field(i).to_numpy() for i in range(4))
            hot = asked.flatten().field(4).to_numpy(zero_copy_only=False)
            text, anchors = np.repeat(np.arange(len(per)), per), anchors.view(np.uint64)
            seg = np.zeros(len(text), SEGMENT)
            seg["start"], seg["count"], seg["off"] = start, count, off
            if hot.any():
                i = np.flatnonzero(hot)
                which, keys, parts = split(symbols, first[text[i]], anchors[i], seg[i], width, anchor)
                text, anchors, seg = (np.concatenate([x[~hot], y]) for x, y in ((text, text[i][which]), (anchors, keys), (seg, parts)))
                order = np.lexsort((seg["start"], text))
                text, anchors, seg = text[order], anchors[order], seg[order]
            doc = batch.column("doc_id").to_numpy()[text]
            begin, size = first[text] + seg["start"], seg["count"].astype(np.int64) + (width - 1)
            bucket = bucket_of(mix(anchors), buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            rows = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                i = order[a:b]
                at = np.repeat(begin[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(int(size[i].sum()))
                rows.append((int(bucket[i[0]]), doc[i].tobytes(), anchors[i].tobytes(), seg[i].tobytes(), source[at].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "docs", "anchors", "segs", "data"])

    def match(batches):
        spread = SPREAD.__getitem__ if symbol is np.uint8 else lambda x: x
        docs_, anchors, segs, data = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, SEGMENT)], [np.zeros(0, symbol)]
        for batch in batches:
            for own, anchor_, seg, raw in zip(*(batch.column(c).to_pylist() for c in ("docs", "anchors", "segs", "data"))):
                docs_.append(np.frombuffer(own, np.int64))
                anchors.append(np.frombuffer(anchor_, np.uint64))
                segs.append(np.frombuffer(seg, SEGMENT))
                data.append(np.frombuffer(raw, symbol))
        doc, anchors_, seg, data = (np.concatenate(x) for x in (docs_, anchors, segs, data))
        del docs_, anchors, segs
        size = seg["count"].astype(np.int64) + (width - 1)
        begin = np.cumsum(size) - size
        if len(seg):
            which, keys, parts = split(spread(data), begin - seg["start"], anchors_, seg, width, anchor)
            _, kind, often = np.unique(keys, return_inverse=True, return_counts=True)
            shared = often[kind] > 1
            which, anchors_, parts = which[shared], keys[shared], parts[shared]
            begin, doc = begin[which] + parts["start"] - seg["start"][which], doc[which]
            seg, size = parts, parts["count"].astype(np.int64) + (width - 1)
        order = np.lexsort((seg["start"], doc, anchors_))
        edges = np.flatnonzero(np.concatenate([[True], anchors_[order][1:] != anchors_[order][:-1]])) if len(order) else np.zeros(0, int)
        filled = np.concatenate([[0], np.cumsum(size[order])])
        chunk = np.unique(np.searchsorted(filled[edges], np.arange(0, filled[-1] + 1, max(1, COLLECTION // data.itemsize))))
        cuts = edges[np.minimum(chunk, len(edges) - 1)] if len(edges) else edges
        cuts = np.unique(np.concatenate([[0], cuts, [len(order)]])).astype(np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i = order[a:b]
            at = np.repeat(begin[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(int(size[i].sum()))
            count = seg["count"][i].astype(np.int64)
            flags = compare(doc[i], anchors_[i], seg["start"][i].astype(np.int64), count, seg["off"][i].astype(np.int64), data[at], width)
            owner = np.repeat(np.arange(len(i)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            new = flags.copy()
            new[1:] &= ~(flags[:-1] & (owner[1:] == owner[:-1]))
            runs = np.flatnonzero(new)
            if len(runs):
                length = np.add.reduceat(flags.astype(np.int64), runs)
                yield pa.RecordBatch.from_arrays([pa.array(doc[i][owner[runs]]), pa.array(seg["start"][i][owner[runs]].astype(np.int64) + place[runs]), pa.array(length)], names=["doc_id", "start", "count"])

    sent = docs.join(asked, "doc_id").mapInArrow(send, schema)
    return found.where("not ask").select("doc_id", "start", "count").unionByName(to_buckets(sent, match, RUNS, buckets))


def with_runs(docs: DataFrame, runs: DataFrame) -> tuple[DataFrame, str]:
    """docs with their runs as a list, and that column's name; a document's own list is bounded by its text."""
    name, key = fresh("runs", docs.columns), fresh("of", docs.columns)
    lists = runs.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "count")).alias(name))
    return docs.join(lists, docs["doc_id"] == lists[key], "left").drop(key), name


def covered(runs: pa.Array, first: np.ndarray, width: int) -> np.ndarray:
    """Whether each symbol of a batch lies in a window of its text's runs."""
    runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
    per = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = runs.flatten()
    begin = first[np.repeat(np.arange(len(per)), per)] + flat.field(0).to_numpy()
    steps = np.bincount(begin, minlength=first[-1] + 1).astype(np.int64)
    steps -= np.bincount(begin + flat.field(1).to_numpy() + (width - 1), minlength=first[-1] + 1)
    return np.cumsum(steps)[: first[-1]] > 0
