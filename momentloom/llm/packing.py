"""Packing documents into training sequences of a fixed length.

A group is a run of documents of one partition with a bounded number of tokens and of pieces times windows. Whole windows are cut off its long
documents; what remains is cut into pieces and dealt to k windows by multiway differencing: every piece starts as
a partial partition of its own, and the two partial partitions with the widest gap between fullest and emptiest
window are merged, fullest against emptiest, until one is left. k starts at tokens / capacity, rounded up, and
rises by one while the fullest window is over capacity. Nothing is shuffled, and a repeated task gives equal rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm.memo import library_memo, slices

#: Pieces times windows of a group at most: differencing holds two 64-bit numbers for each of them at its start, 128 MB.
MOST_CELLS = 1 << 23
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to ``k`` windows with near-equal sums: the item numbers of each window."""
    if not sizes:
        return [[] for _ in range(k)]
    # A window's content is a node: an item, or a pair of nodes; -1 is empty.
    left, right, n = [], [], len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], node[-1] = s, i
        heap.append((-int(s), i, sums, node))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, x, y = a + b[::-1], x, y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        node = np.maximum(x, y)
        node[both] = n + len(left) + np.arange(len(both))
        left += x[both].tolist()
        right += y[both].tolist()
        up = np.argsort(sums, kind="stable")
        sums, node = sums[up], node[up]
        sums_gap = int(sums[-1] - sums[0])
        heapq.heappush(heap, (-sums_gap, order, sums, node))
        order += 1
    out = []
    for top in heap[0][3].tolist():
        items, stack = [], [top] if top >= 0 else []
        while stack:
            v = stack.pop()
            if v < n:
                items.append(v)
            else:
                stack += (right[v - n], left[v - n])
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Deal items of at most ``capacity`` to as few near-equal windows as differencing finds to fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = [w for w in difference(sizes, k) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        k += 1


def groups(held: Iterable[tuple[int | None, np.ndarray]], capacity: int, piece: int, group: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Runs of documents with ``group`` tokens, or fewer where their pieces times their windows reach ``MOST_CELLS``."""
    out, tokens, pieces, rest = [], 0, 0, 0
    for d, ids in held:
        over = len(ids) % capacity
        out.append((d, ids))
        tokens, pieces, rest = tokens + len(ids), pieces - (-over // piece), rest + over
        if tokens >= group or pieces * (rest // capacity + 1) >= MOST_CELLS:
            yield out
            out, tokens, pieces, rest = [], 0, 0, 0
    if out:
        yield out


def pack(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 1, capacity: int = 2048, piece: int = 256,
         group: int = 1 << 20, with_ids: bool = True) -> DataFrame:
    """Pack every document (ids and ``end_id``) into sequences of at most ``capacity`` tokens: one row per piece.

    ``offset`` is the place in the sequence, gapless from 0; ``start`` the place in the document. ``ids`` holds the
    tokens as little-endian unsigned 32-bit integers where ``with_ids`` is set. Cuts cost nothing, so what is left
    of a document after its whole windows is cut into pieces of at most ``piece`` tokens. Null text counts as empty and still gives its
    end token; null ``doc_id`` stays null; other columns are ignored; an empty table gives no rows. ``sequence_id`` holds the
    partition in its upper half and a running number in its lower one.
    """

    def emit(held, counter):
        """Rows of one group; ``held``: pairs of document id and ids."""
        at, sizes, dealt = [], [], []
        for d, (_, ids) in enumerate(held):
            whole = len(ids) // capacity * capacity
            for s in range(0, whole, capacity):
                dealt.append([len(at)])
                at.append((d, s, capacity))
                sizes.append(capacity)
        first = len(at)
        for d, (_, ids) in enumerate(held):
            for s in range(len(ids) // capacity * capacity, len(ids), piece):
                at.append((d, s, min(piece, len(ids) - s)))
                sizes.append(at[-1][2])
        if len(at) > first:
            dealt += [[first + i for i in sorted(w)] for w in windows(sizes[first:], capacity)]
        rows = []
        for w in dealt:
            offset = 0
            for i in w:
                d, s, n = at[i]
                rows.append((d, s, n, counter[0], offset))
                offset += n
            counter[0] += 1
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            cut = [held[d][1][s : s + n] for d, s, n, *_ in part]
            out = {
                "doc_id": pa.array([held[r[0]][0] for r in part], pa.int64()), "start": [r[1] for r in part], "length": [r[2] for r in part],
                "ids_crc32": pa.array([zlib.crc32(c.data) for c in cut], pa.int64()), "doc_tokens": [len(held[r[0]][1]) for r in part],
                "sequence_id": [r[3] for r in part], "offset": [r[4] for r in part],
            }
            if with_ids:
                out["ids"] = pa.array([c.tobytes() for c in cut], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    def run(batches):
        memo, end = library_memo(vocabulary, kind), np.uint32(end_id).tobytes()
        counter = [TaskContext.get().partitionId() << 32]

        def held():
            for batch in batches:
                names, at = batch.column("doc_id").to_pylist(), 0
                for texts in slices(batch.column("text"), 512):
                    for x in memo.encode(texts):
                        yield names[at], np.frombuffer(x + end, "<u4")
                        at += 1

        for found in groups(held(), capacity, piece, group):
            yield from emit(found, counter)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
