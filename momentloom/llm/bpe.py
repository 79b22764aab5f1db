"""Byte-level BPE by ranks: whole texts to ids and back.

Each match of the split pattern is merged on its own. A segment tree over its byte positions holds, at each leaf,
the rank of the pair that starts there and the position, and at each node the least of its two children: the root
is the leftmost pair of the lowest rank. A merge kills one position, takes it out of the list of live neighbours,
and updates three leaves, each with a path to the root. Distinct matches of like length are merged together, one
tree per row of an array.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm.memo import Memo, cut_byte_level, is_loose, packed, plain_words, slices

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = np.int64(2**62)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ranks:
    """Lookup tables of one vocabulary; ranks are the ids and must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of, self.size = ranks, max(ranks.values()) + 1
        self.token = dict(map(reversed, ranks.items()))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``_NONE`` where they don't merge; an id of -1 never does."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)


def merge_rows(words: list[bytes], ranks: Ranks, leaves: int) -> list[list[int]]:
    """Ids of words of at most ``leaves`` bytes (a power of two), all merged side by side."""
    rows = len(words)
    length = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(rows, leaves)
    place = np.arange(leaves)
    ids = np.where(place < length[:, None], ranks.byte[flat], -1)
    # Neighbours of a live position; ``leaves`` is a dead place beyond the end, with id -1.
    ids = np.concatenate([ids, np.full((rows, 1), -1)], 1)
    after = np.broadcast_to(np.minimum(place + 1, leaves), (rows, leaves)).copy()
    before = np.broadcast_to(place - 1, (rows, leaves)).copy()

    def key(rank, at):
        return np.where(rank < _NONE, rank * leaves + at, _NONE)

    tree = np.full((rows, 2 * leaves), _NONE)
    tree[:, leaves:] = key(ranks.pair(ids[:, :-1], ids[:, 1:]), place)
    for n in range(leaves - 1, 0, -1):
        tree[:, n] = np.minimum(tree[:, 2 * n], tree[:, 2 * n + 1])
    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        top = tree[live, 1]
        at, rank = top % leaves, top // leaves
        gone = after[live, at]
        nxt = after[live, gone]
        ids[live, at], ids[live, gone], after[live, at] = rank, -1, nxt
        inner = nxt < leaves
        before[live[inner], nxt[inner]] = at[inner]
        prev = before[live, at]
        led = prev >= 0
        r = np.concatenate([live, live, live[led]])
        p = np.concatenate([at, gone, prev[led]])
        value = np.concatenate([key(ranks.pair(rank, ids[live, nxt]), at), np.full(len(live), _NONE),
                                key(ranks.pair(ids[live[led], prev[led]], rank[led]), prev[led])])
        node = leaves + p
        tree[r, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        live = live[tree[live, 1] < _NONE]
    ids = ids[:, :leaves]
    kept = ids >= 0
    ends = np.cumsum(kept.sum(1))[:-1]
    return [x.tolist() for x in np.split(ids[kept], ends)]


def merge_long(word: bytes, ranks: Ranks) -> list[int]:
    """Ids of one long word: the same tree, walked position by position."""
    n = len(word)
    leaves = 1 << (n - 1).bit_length()
    ids = ranks.byte[np.frombuffer(word, np.uint8)]
    none = int(_NONE)
    first = ranks.pair(ids[:-1], ids[1:])
    tree = np.full(2 * leaves, _NONE)
    tree[leaves : leaves + n - 1] = np.where(first < _NONE, first * leaves + np.arange(n - 1), _NONE)
    half = leaves
    while half > 1:
        half //= 2
        tree[half : 2 * half] = tree[2 * half : 4 * half].reshape(half, 2).min(1)
    tree, ids = tree.tolist(), ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    token, of = ranks.token, ranks.of

    def put(at: int, value: int) -> None:
        node = leaves + at
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    def value(a: int, b: int) -> int:
        r = of.get(token[ids[a]] + token[ids[b]])
        return none if r is None else r * leaves + a

    while (top := tree[1]) < none:
        rank, at = divmod(top, leaves)
        gone = after[at]
        nxt, prev = after[gone], before[at]
        ids[at], ids[gone], after[at] = rank, -1, nxt
        put(gone, none)
        if nxt < n:
            before[nxt] = at
        put(at, value(at, nxt) if nxt < n else none)
        if prev >= 0:
            put(prev, value(prev, at))
    return [i for i in ids if i >= 0]


def merge_words(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Ids of each word. A word that is a token by itself is that token."""
    out: list[list[int]] = [[] for _ in words]
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w in ranks.of:
            out[i] = [ranks.of[w]]
        elif len(w) > 256:
            out[i] = merge_long(w, ranks)
        elif w:
            by.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
    for leaves, at in by.items():
        for k in range(0, len(at), 1 << 14):
            part = at[k : k + (1 << 14)]
            for i, ids in zip(part, merge_rows([words[i] for i in part], ranks, leaves), strict=True):
                out[i] = ids
    return out


class Coder:
    """Encoder and decoder of one worker; distinct matches of a batch are merged together, then remembered."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(read_ranks(path))
        found = regex.compile(pattern).findall
        self.memo = Memo(cut_byte_level, lambda p: plain_words(p) or found(p), self._learn, is_loose)
        self.bytes = [self.ranks.token.get(i, b"") for i in range(self.ranks.size)]

    def _learn(self, words: list[str]) -> list[bytes]:
        return list(map(packed, merge_words([w.encode() for w in words], self.ranks)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.memo.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder of a vocabulary."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Coder(path, pattern)
    return _MADE[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit integers) of every whole text.

    Each row by itself: null text counts as empty and gives no ids, a null ``doc_id`` stays null, repeated rows
    repeat, other columns are ignored.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            done = [x for texts in slices(batch.column("text"), 512) for x in c.encode(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(done, pa.binary())})

    return _rows(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes`` of rows with ``ids`` as ``encode`` gives them; null ids give null."""

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            done = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(done, pa.binary())})

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text and decode its ids: number of ids and digests of both, one row per document."""

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for texts in slices(batch.column("text"), 512):
                for x in c.encode(texts):
                    n.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest())
                    back.append(hashlib.sha256(c.decode(x)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return _rows(docs).mapInArrow(run, CODED)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
