"""Byte-level BPE by speculation: longest matches propose tokens, a test of neighbours keeps or rejects them.

A word's proposed tokens are its BPE encoding exactly if no merge ever crosses a border between two of them.
Whether one does depends on the two tokens alone, so the test runs over arrays of neighbouring pairs; only words
with a pair that fails are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import extended, plain_names, slices, small_batches, table

#: Fixed: how byte-level tokenizers of this kind split a text into words.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces that the pattern never joins, if a text's only white space is space and line feed.
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
#: The same with any white space: a word never goes on from another character into white space.
WIDE = regex.compile(r"\s*\S+|\s+")
#: Distinct pieces, and characters of them, that a worker remembers before it starts anew; bytes of text at a time.
REMEMBERED, REMEMBERED_CHARACTERS, SLICE = 200_000, 8 << 20, 2 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE tokenizer, from the JSON text of its file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.size = size
        self.single = np.zeros(256, np.int64)
        for b in range(256):
            self.single[b] = ids[next(c for c, x in letters.items() if x == b)]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.never = len(merges)
        self._hash()
        self._spines()
        self._tree(ids)
        flat = b"".join(self.bytes)
        self.flat = np.frombuffer(flat, np.uint8)
        self.flat_at = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes])])

    def _hash(self) -> None:
        """The merges by pair in an open table of 2**19 slots, for look-ups by array."""
        self.slots, self.odd = (1 << 19) - 1, 0x9E3779B97F4A7C1
        self.slot_key, self.slot_rank = np.full(self.slots + 1, -1, np.int64), np.full(self.slots + 1, self.never, np.int64)
        self.made = np.array([t for _, t in self.merge.values()], np.int64)  # by rank
        for (a, b), (rank, _) in self.merge.items():
            key = a * self.size + b
            slot = ((key * self.odd & (1 << 64) - 1) >> 20) & self.slots
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & self.slots
            self.slot_key[slot], self.slot_rank[slot] = key, rank

    def _spines(self) -> None:
        """right[d][t], left[d][t]: the d-th piece down the right (left) edge of t's merge tree, and the rank at which it is merged away."""
        first, second, born = (np.full(self.size, -1, np.int64) for _ in range(3))
        for (a, b), (rank, t) in self.merge.items():
            if born[t] < 0:
                first[t], second[t], born[t] = a, b, rank
        self.parts = first, second, born
        self.right, self.left = [], []
        for out, part in ((self.right, second), (self.left, first)):
            piece, gone = np.arange(self.size), np.full(self.size, self.never, np.int64)
            while (piece >= 0).any():
                out.append((piece, gone))
                gone = np.where(piece >= 0, born[piece], -1)
                piece = np.where(piece >= 0, part[piece], -1)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or never."""
        key = a * self.size + b
        slot = (key * self.odd >> 20) & self.slots
        found = self.slot_key[slot]
        rank = np.where(found == key, self.slot_rank[slot], self.never)
        live = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[live]
        while len(live):
            slot = (slot + 1) & self.slots
            found = self.slot_key[slot]
            hit = found == key[live]
            rank[live[hit]] = self.slot_rank[slot[hit]]
            more = ~hit & (found >= 0)
            live, slot = live[more], slot[more]
        return rank

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For arrays of neighbours: whether no merge ever crosses their border (before: nor any with a rank below).

        A piece x on a's right edge and y on b's left edge meet until one is merged into its own token. A merge of
        x and y wins if its rank is lower; at equal rank the one further left wins.
        """
        good = np.ones(len(a), bool)
        limit = np.full(len(a), self.never) if before is None else before
        for right, right_gone in self.right:
            x = right[a]
            rows = np.flatnonzero((x >= 0) & good)
            if not len(rows):
                break
            for left, left_gone in self.left:
                y = left[b[rows]]
                rows, y = rows[y >= 0], y[y >= 0]
                if not len(rows):
                    break
                rank = self.rank_of(x[rows], y)
                good[rows[(rank < limit[rows]) & (rank < right_gone[a[rows]]) & (rank <= left_gone[b[rows]])]] = False
        return good

    def _tree(self, ids: dict[str, int]) -> None:
        """A byte tree of the tokens that a word can end up with, as sorted (node, byte) keys."""
        first, second, born = self.parts
        merged = np.flatnonzero(born >= 0)
        usable = np.zeros(self.size, bool)
        usable[self.single] = True
        usable[merged[self.compatible(first[merged], second[merged], born[merged])]] = True
        keys, child, token, nodes = {}, [0], [-1], 1
        for i in ids.values():
            if not usable[i]:
                continue
            node = 0
            for byte in self.bytes[i]:
                key = node * 256 + byte
                if key not in keys:
                    keys[key] = nodes
                    nodes += 1
                    token.append(-1)
                node = keys[key]
            token[node] = i
        self.keys = np.array(sorted(keys), np.int64)
        self.child = np.array([keys[k] for k in self.keys.tolist()], np.int64)
        self.token = np.array(token, np.int64)

    def merged(self, word: bytes) -> list[int]:
        """The encoding of one word, merge by merge: lowest rank first, then furthest left."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        if len(ids) < 2:
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte position the longest token that starts there and ends by stop, and its length."""
        best, length = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        live, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(live):
            key = node * 256 + data[live + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, node = live[hit], self.child[at[hit]]
            depth += 1
            ends = self.token[node] >= 0
            best[live[ends]], length[live[ends]] = self.token[node[ends]], depth
            more = live + depth < stop[live]
            live, node = live[more], node[more]
        return best, length

    def encode_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words, concatenated, and how many each has."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(found), np.uint8)
        best, length = self.longest(data, np.repeat(ends, size))
        live, at, steps = np.arange(len(found)), ends - size, []
        while len(live):  # each step takes one token of every word that has some left
            steps.append((live, best[at]))
            at = at + length[at]
            more = at < ends[live]
            live, at = live[more], at[more]
        word = np.concatenate([w for w, _ in steps]) if steps else np.zeros(0, np.int64)
        ids = np.concatenate([t for _, t in steps]) if steps else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order]
        next_to = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[next_to] * self.size + ids[next_to + 1], return_inverse=True)
        wrong = ~self.compatible(pairs // self.size, pairs % self.size)[which]
        bad = np.unique(word[next_to[wrong]])
        if not len(bad):
            return ids, np.bincount(word, minlength=len(found))
        keep = np.ones(len(found), bool)
        keep[bad] = False
        exact, count = self.merge_words([found[i] for i in bad.tolist()])
        ids = np.concatenate([ids[keep[word]], exact])
        word = np.concatenate([word[keep[word]], np.repeat(bad, count)])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(found))

    def merge_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of many words, all merged side by side; long ones one by one."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        long = np.flatnonzero(size > 64).tolist()
        short = np.flatnonzero(size <= 64)
        ids = self.single[np.frombuffer(b"".join(found[i] for i in short.tolist()), np.uint8)]
        word, done = np.repeat(short, size[short]), []
        rank = self._ranks(ids, word)
        while len(ids):
            begin = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.concatenate([begin, [len(ids)]]))
            over = np.repeat(least == self.never, length)
            if over.any():
                done.append((word[over], ids[over]))
                word, ids, rank, least, length = word[~over], ids[~over], rank[~over], least[least < self.never], length[least < self.never]
                continue
            take = rank == np.repeat(least, length)
            # Of overlapping equal pairs (a run of one token) the 1st, 3rd, ... count from the left.
            if (both := take[1:] & take[:-1]).any():
                at = np.arange(len(take))
                start = np.maximum.accumulate(np.where(take & ~np.concatenate([[False], both]), at, 0))
                take &= (at - start) % 2 == 0
            where = np.flatnonzero(take)
            ids = ids.copy()
            ids[where] = self.made[rank[where]]
            stay = np.ones(len(ids), bool)
            stay[where + 1] = False
            changed = take.copy()  # the pair to the right of a merge, and the one that now ends in it
            left = where - 1
            left = np.where((left >= 0) & ~stay[left], left - 1, left)
            changed[left[left >= 0]] = True
            ids, word, rank, redo = ids[stay], word[stay], rank[stay], np.flatnonzero(changed[stay])
            rank[redo] = self._ranks(ids, word, redo)
        for i in long:
            one = np.array(self.merged(found[i]), np.int64)
            done.append((np.full(len(one), i), one))
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([t for _, t in done])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(found))

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the merge of each id (or those at `at`) with its right neighbour in the same word."""
        at = np.arange(len(ids)) if at is None else at
        out = np.full(len(at), self.never)
        inner = np.flatnonzero(at + 1 < len(ids))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        out[inner] = self.rank_of(ids[at[inner]], ids[at[inner] + 1])
        return out


class Codes(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes and decodes whole texts; remembers the pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.known, self.characters = Codes(), 0
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        split = [PATTERN.findall(p) if p not in self.v.special else [p] for p in pieces]
        words = dict.fromkeys(chain.from_iterable(split))
        for i, w in enumerate(words):
            words[w] = i
        ids, count = self.v.encode_words([w.encode() for w in words])
        for s, t in self.v.special.items():
            if s in words:  # a special token's own text
                at = int(count[: words[s]].sum())
                ids = np.concatenate([ids[:at], [t], ids[at + count[words[s]] :]])
                count[words[s]] = 1
        start = np.cumsum(count) - count
        code = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64)
        per = np.fromiter(map(len, split), np.int64, len(split))
        flat, total = gather(ids, start[code], count[code])
        piece = np.bincount(np.repeat(np.arange(len(split)), per), count[code], len(split)).astype(np.int64)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(piece) - piece])
        self.count, self.ids = np.concatenate([self.count, piece]), np.concatenate([self.ids, flat])

    def pieces(self, text: str) -> list[str]:
        for s in self.v.special:
            if s in text:
                return [y for k, x in enumerate(text.split(s)) for y in [s] * (k > 0) + self.pieces(x)]
        return (WIDE if OTHER_SPACE.search(text) else PIECES).findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and the offsets between them."""
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.reset()
        split = [self.pieces(t) for t in texts]
        have = len(self.known)
        known = self.known
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        if len(known) > have:
            new = list(islice(known, have, None))
            self.characters += sum(map(len, new))
            self._learn(new)
        ids, total = gather(self.ids, self.at[code], self.count[code])
        per = np.fromiter(map(len, split), np.int64, len(split))
        sums = np.concatenate([[0], np.cumsum(self.count[code])])
        return ids, sums[np.concatenate([[0], np.cumsum(per)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts that the ids stand for; bytes that aren't UTF-8 become U+FFFD, as text has to."""
        size = self.v.flat_at[ids + 1] - self.v.flat_at[ids]
        data, _ = gather(self.v.flat, self.v.flat_at[ids], size)
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=1)
def vocabulary(text: str) -> Vocabulary:
    """The tables of a vocabulary file, which a worker keeps from task to task."""
    return Vocabulary(text)


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
    """values[start:start+count] of all rows, concatenated."""
    total = int(count.sum())
    if not total:
        return values[:0], 0
    step = np.repeat(start - (np.cumsum(count) - count), count)
    return values[step + np.arange(total)], total


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and token_ids (array<int>), added, or replaced in any case.

    Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    docs, back = plain_names(docs, (text,), ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids"))
    kept = docs.columns
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the input's size

    def run(batches):
        encoder = Encoder(vocabulary(spec.value))
        for batch in slices(batches, text, SLICE):
            ids, at = encoder.encode(batch.column(text).fill_null("").to_pylist())
            little = ids.astype("<u4").tobytes()
            sha = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            decoded = [hashlib.sha256(x).hexdigest() for x in encoder.decode(ids, at)]
            columns = [*batch.columns, pa.array(np.diff(at)), pa.array(sha), pa.array(decoded), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"])

    return back(docs.mapInArrow(run, extended(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
