"""Exact byte-level dedup: bytes of windows that start earlier, in this or a lesser document, are removed.

Windows are dealt out by winnowed anchor (see winnow), which only partitions the input: equal windows always come to the
same task, and segments that are copies of each other as a whole come once, as do copies before any shuffle. What a task
gets is ordered column by column: each round puts one more symbol of every segment in front of its last suffix, and
updates the collection's Burrows-Wheeler transform and common prefixes. Both lie in a file of the shared folder; a round
reads that of the round before and writes its own, block by block and in order, so memory holds a block and some numbers
for each segment. Windows are equal where the common prefixes of neighbouring suffixes reach their width.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extended, plain_names, scratch, slices, small_batches, table, text_buffer
from .files import make_folder, opened
from .winnow import SPREAD, covered, repeated_runs, with_runs

WIDTH, ANCHOR = 100, 48
#: Suffixes in a block of the transform's files; up to twice as many before a block is cut.
BLOCK = 1 << 16


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    return data, SPREAD[data], offsets


class Ranks:
    """What a round needs to know of the transform, gathered block by block: for each place asked for, how often its
    symbol came before, and the least common prefix since it came last and until it comes next."""

    def __init__(self, asked: np.ndarray):
        """asked: ascending places."""
        n = len(asked)
        self.asked, self.done, self.base = asked, 0, 0
        self.rank, self.before, self.after = np.zeros(n, np.int64), np.zeros(n, np.int16), np.full(n, -1, np.int16)
        self.count, self.least = np.zeros(256, np.int64), np.full(256, 255, np.uint8)  # by symbol; least: since its last place
        self.waiting = np.full(256, -1)  # the question at a symbol's last place, if it is one

    def block(self, symbols: np.ndarray, common: np.ndarray) -> None:
        size = len(symbols)
        end = self.done + int(np.searchsorted(self.asked[self.done :], self.base + size))
        places = self.asked[self.done : end] - self.base
        order = np.argsort(symbols, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=256))])
        first, last = edge[:-1], edge[1:] - 1
        here = np.flatnonzero(last >= first)
        asked = np.zeros(size + 1, bool)
        asked[places] = True
        at = np.flatnonzero(asked[order])
        place = order[at]
        sym, own = symbols[place], self.done + np.searchsorted(places, place)
        self.rank[own] = self.count[sym] + at - first[sym]
        # Between neighbours of one symbol within the block.
        left, right = at > first[sym], at < last[sym]
        right[right] = ~asked[order[at[right] + 1]]
        low = np.concatenate([order[at[left] - 1], place[right]]) + 1
        high = np.concatenate([place[left], order[at[right] + 1]]) + 1
        if len(low):
            least = np.minimum.reduceat(np.append(common, np.uint8(255)), np.column_stack([low, high]).ravel())[::2].astype(np.int16) + 1
            n = int(left.sum())
            self.before[own[left]], self.after[own[right]] = least[:n], least[n:]
        # From a symbol's last place in earlier blocks to its first one here, and on from its last one here.
        begins, ends = np.sort(order[first[here]]), np.sort(order[last[here]])
        low = np.minimum.accumulate(np.minimum.reduceat(common[: begins[-1] + 1], np.concatenate([[0], begins[:-1] + 1])))
        high = np.minimum.accumulate(np.minimum.reduceat(np.append(common, np.uint8(255)), ends + 1)[::-1])[::-1]
        until, since = np.full(256, 255, np.uint8), self.least
        until[here] = low[np.searchsorted(begins, order[first[here]])]
        opening = ~left & (self.count[sym] > 0)
        self.before[own[opening]] = np.minimum(since[sym[opening]], until[sym[opening]]).astype(np.int16) + 1
        met = here[(self.waiting[here] >= 0) & ~asked[order[first[here]]]]
        self.after[self.waiting[met]] = np.minimum(since[met], until[met]).astype(np.int16) + 1
        self.waiting[here] = -1
        final = at == last[sym]
        self.waiting[sym[final]] = own[final]
        self.least = np.minimum(since, common.min())
        self.least[here] = high[np.searchsorted(ends, order[last[here]])]
        self.count += edge[1:] - edge[:-1]
        self.base, self.done = self.base + size, end


def _blocks(path: str, sizes: list[int]):
    """A round's file, block by block: each suffix's symbol, and its common prefix in the upper eight bits."""
    system, local = opened(path)
    with system.open_input_stream(local, compression=None) as file:
        for n in sizes:
            yield np.frombuffer(file.read(2 * n), "<u2")


def collection_order(data: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The transform (0: no symbol before) and the common prefixes of all suffixes of a collection of strings.

    Strings are of bytes below 255 and no longer than 254; their ends count as different from each other and less than
    any symbol. folder: for the rounds' files, each of which goes when the next one is written.
    """
    m, stop = len(size), np.cumsum(size)
    system, local = opened(folder)
    system.create_dir(local, recursive=True)

    def symbol(i: np.ndarray, turn: int) -> np.ndarray:
        """What stands before the suffix of `turn` symbols."""
        out = np.zeros(len(i), "<u2")
        more = size[i] > turn
        out[more] = data[stop[i[more]] - turn - 1] + np.uint16(1)
        return out

    live, turn = np.arange(m), 0
    at, new, after = live, symbol(live, 0), np.full(m, -1, np.int16)
    totals, sizes, path = np.zeros(256, np.int64), [], None
    while True:
        ranks, written, new_path = Ranks(at[size[live] > turn]), [], f"{folder}/{turn}"
        with system.open_output_stream(opened(new_path)[1], compression=None) as out:

            def put(rows):
                edges = [len(rows) * k // max(1, len(rows) // BLOCK) for k in range(max(1, len(rows) // BLOCK) + 1)]
                for a, b in zip(edges[:-1], edges[1:]):
                    out.write(rows[a:b].tobytes())
                    written.append(b - a)
                    ranks.block(*np.ascontiguousarray(rows[a:b].view(np.uint8).reshape(-1, 2).T))

            done, base = 0, 0
            before = at - np.arange(len(at))  # the old suffix that each new one is put before
            for rows in _blocks(path, sizes) if path else ():
                old = len(rows)
                end = done + int(np.searchsorted(before[done:], base + old))
                if end > done:
                    put_at, least = before[done:end] - base, after[done:end]
                    follows = least >= 0
                    rows = rows.copy()
                    rows[put_at[follows]] = rows[put_at[follows]] & 255 | least[follows].astype("<u2") << 8
                    rows = np.insert(rows, put_at, new[done:end])
                put(rows)
                done, base = end, base + old
            if done < len(at):
                put(new[done:])
        if path:
            system.delete_file(opened(path)[1])
        path, sizes = new_path, written
        totals += np.bincount(new & 255, minlength=256)
        live, turn = live[size[live] > turn], turn + 1
        if not len(live):
            break
        # Where the longer suffixes come: after all of lesser symbols, and those of their own that came before.
        smaller = m + np.concatenate([[0], np.cumsum(totals[1:])])[:-1]
        come = smaller[symbol(live, turn - 1).astype(np.int64) - 1] + ranks.rank
        order = np.argsort(come)
        live, at, after = live[order], come[order], ranks.after[order]
        new = symbol(live, turn) | ranks.before[order].astype("<u2") << 8
    found = np.concatenate([np.zeros(0, "<u2"), *_blocks(path, sizes)])
    system.delete_dir(local)
    return (found & 255).astype(np.uint8), (found >> 8).astype(np.uint8)


def suffixes_of(before: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and length of each suffix in order, by walking back from the strings' ends through the transform."""
    place = np.empty(len(before), np.int32)
    ends = int((before == 0).sum())
    place[np.argsort(before, kind="stable")] = np.arange(len(before), dtype=np.int32)
    place += len(size) - ends  # suffix -> the one with its symbol in front; the empty suffixes come first
    owner, length = np.zeros(len(before), np.int32), np.zeros(len(before), np.int16)
    live, at = np.arange(len(size)), np.arange(len(size))
    owner[at] = live
    for turn in range(1, int(size.max(initial=0)) + 1):
        keep = size[live] >= turn
        live, at = live[keep], place[at[keep]]
        owner[at], length[at] = live, turn
    return owner, length


def compare(folder: str, doc, anchor, start, count, off, data, width) -> np.ndarray:
    """For each window of the segments whether an equal one starts earlier."""
    first, out = np.cumsum(count) - count, np.zeros(int(count.sum()), bool)
    size = count + (width - 1)
    before, common = collection_order(data, size, f"{folder}/{uuid.uuid4().hex}")
    owner, length = suffixes_of(before, size)
    far = common >= width
    use = np.flatnonzero(far | np.append(far[1:], False))  # suffixes with an equal window beside them
    group, owner, at = np.cumsum(~far)[use], owner[use], size[owner[use]] - length[use]
    doc, start = doc[owner], start[owner] + at
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    back = np.repeat(lead, np.diff(np.append(lead, len(group))))
    out[(first[owner] + at)[order]] = (doc != doc[back]) | (start != start[back])
    return out


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start and count of the runs of 100-byte windows that start earlier too."""
    folder = scratch(docs.sparkSession)
    make_folder(folder)
    return repeated_runs(docs, symbols_of, partial(compare, folder), WIDTH, ANCHOR, True, np.uint8)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text cut to the bytes kept, and n_bytes, n_removed, n_spans and kept_sha256 of the bytes.

    Bytes left over from a cut character become U+FFFD in text; the digest is of the bytes. Null counts as empty and
    stays null; texts under 100 bytes stay whole. doc_id is the order: rows without one stay whole, and repeated rows
    of one doc_id count as one document, each cut alike.
    """
    small_batches(docs.sparkSession)
    docs, back = plain_names(docs, ("doc_id", "text"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    kept = docs.columns
    rows, runs = with_runs(docs, repeated(docs.select("doc_id", "text")))

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            data, first = text_buffer(batch.column("text"))
            gone = covered(batch.column(runs), first, WIDTH)
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            begins[first[:-1][first[:-1] < len(gone)]] |= gone[first[:-1][first[:-1] < len(gone)]]
            spans = np.concatenate([[0], np.cumsum(begins)])
            left = data[~gone].tobytes()
            at = (first - total[first]).tolist()
            bodies = [left[a:b] for a, b in zip(at[:-1], at[1:])]
            removed = np.diff(total[first])
            texts = pa.array([b.decode("utf-8", "replace") for b in bodies], pa.string(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
            columns = [texts if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), pa.array(removed), pa.array(np.diff(spans[first])), pa.array([hashlib.sha256(b).hexdigest() for b in bodies])], names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return back(rows.mapInArrow(run, extended(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
