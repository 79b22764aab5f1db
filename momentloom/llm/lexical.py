"""Ranked lexical search of whole documents with term-pair bounds.

Documents are read once: each task turns runs of them into blocks, one row each, with the postings of the terms
that the items ask for. With the counts of the whole corpus a second pass makes every block's index: a list of
documents and impacts per term, and per pair of terms an intersection list, each with its greatest impact; for a pair that is
the greatest joint impact. A search gives every term or pair of an item one of three places: all its documents are
candidates; only those that hold both terms; none. What is not a candidate can reach no more than the sum of the bounds left out, and
a pair that never, or only weakly, occurs together is bounded by far less than its two terms apart. As long as this
sum is below a score that is sure to be reached by ``k`` documents, nothing is lost. No step but the last shuffles.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.memo import slices
from momentloom.operators.stored import settle

#: Documents, and postings, with which a block is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20

#: Bytes of distinct terms that one search sends to every task; items with more are searched in several rounds.
TERM_BYTES = 32 << 20

_BLOCKS = "ids array<long>, sizes array<int>, terms array<int>, ends array<int>, slots array<int>, tfs array<int>, docs long, length long"
_INDEX = (
    "ids array<long>, terms array<int>, ends array<int>, slots array<int>, impacts array<long>, most array<long>, floor array<long>,"
    " pairs array<int>, pair_ends array<int>, pair_slots array<int>, pair_most array<long>"
)

_BREAKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_LOWER = _BREAKS.lower()


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A to Z in lower case."""
    return text.encode().translate(_LOWER).split(b" ")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, size: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Score of a term that occurs ``tf`` times in a document with ``size`` terms."""
    m = 75 + (25 * size * docs) // max(length, 1)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def read_items(items: DataFrame) -> dict:
    """Of each item its terms with their occurrences. Equal texts under one id count once, different ones together; without a term there is no entry."""
    out: dict = {}
    for r in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        found = Counter(filter(None, terms(r.text)))
        if found:
            out.setdefault(r.item_id, Counter()).update(found)
    return out


def _ranges(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends])


def blocks(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Postings of the terms in ``numbers``, and sizes in terms of all documents, in rows of many documents each."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        number = shared.value
        asked = number.keys()

        def out():
            t = np.array(flat[0], np.int64)
            order = np.argsort(t, kind="stable")
            t, slot, tf = t[order], np.array(flat[1], np.int64)[order], np.array(flat[2], np.int64)[order]
            held, ends = np.unique(t, return_counts=True)
            full = [s for s in sizes if s]
            row = dict(ids=ids, sizes=sizes, terms=held, ends=np.cumsum(ends), slots=slot, tfs=tf)
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.int64() if k == "ids" else pa.int32())) for k, v in row.items()}
                                              | {"docs": [len(full)], "length": [sum(full)]})

        ids, sizes, flat = [], [], ([], [], [])
        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            for texts in slices(batch.column("text")):
                for t in texts:
                    counts = Counter(terms(t))
                    counts.pop(b"", None)
                    for w in counts.keys() & asked:
                        flat[0].append(number[w])
                        flat[1].append(len(ids))
                        flat[2].append(counts[w])
                    ids.append(names[at])
                    sizes.append(counts.total())
                    at += 1
                    if len(ids) >= BLOCK_DOCS or len(flat[0]) >= BLOCK_POSTINGS:
                        yield out()
                        ids, sizes, flat = [], [], ([], [], [])
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCKS)


def _kth(values: np.ndarray, k: int) -> int:
    """The ``k``-th greatest value, 0 if there are fewer: so many documents score at least that."""
    return int(np.partition(values, -k)[-k]) if len(values) >= k else 0


def index(counted: DataFrame, weights: np.ndarray, pairs: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """The lists of every block: of each term, and of each of ``pairs`` (numbers of two terms) that a block holds together."""
    shared = counted.sparkSession.sparkContext.broadcast((weights, pairs))

    def run(batches):
        w, wanted = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("sizes", "terms", "ends", "slots", "tfs")}
                held, at, slots = own["terms"].astype(np.int64), _ranges(own["ends"]), own["slots"]
                worth = impacts(np.repeat(w[held], np.diff(at)), own["tfs"].astype(np.int64), own["sizes"][slots].astype(np.int64), docs, length)
                most = np.maximum.reduceat(worth, at[:-1]) if len(held) else np.zeros(0, np.int64)
                floor = [_kth(worth[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]
                place = np.full(len(w), -1)
                place[held] = np.arange(len(held))
                both = place[wanted]
                met, ends, met_slots, met_most = [], [], [], []
                n = 0
                for i in np.flatnonzero((both >= 0).all(1)).tolist():
                    (a, b), (c, d) = ((at[p], at[p + 1]) for p in both[i])
                    found, x, y = np.intersect1d(slots[a:b], slots[c:d], assume_unique=True, return_indices=True)
                    if len(found):
                        n += len(found)
                        met.append(i)
                        ends.append(n)
                        met_slots.append(found)
                        met_most.append(int((worth[a:b][x] + worth[c:d][y]).max()))
                lists = {"ids": batch.column("ids")[row].values, "terms": held, "ends": own["ends"], "slots": slots, "impacts": worth, "most": most, "floor": floor,
                         "pairs": met, "pair_ends": ends, "pair_slots": np.concatenate(met_slots) if met_slots else [], "pair_most": met_most}
                kinds = {"ids", "impacts", "most", "floor", "pair_most"}
                yield pa.RecordBatch.from_pydict({c: pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], pa.list_(pa.int64() if c in kinds else pa.int32())) for c, v in lists.items()})

    return counted.select("ids", "sizes", "terms", "ends", "slots", "tfs").mapInArrow(run, _INDEX)


def plan(units: list[tuple], bar: int) -> tuple[list[int], int]:
    """How much of each unit to leave out, and the bound of what that leaves out: 0 nothing, 1 documents with one of its two terms, 2 all.

    A unit is (bound of one term, bound of all, postings saved by the first step, by the second); the sum of the bounds stays below ``bar``.
    The steps that save most for their part of the bound come first.
    """
    steps = []
    for i, (one, all_, few, rest) in enumerate(units):
        steps += [(one / (few + 1), 0, one, i), (max(one / (few + 1), (all_ - one) / (rest + 1)), 1, all_ - one, i)]
    level, left = [0] * len(units), 0
    for _, k, cost, i in sorted(steps):
        if level[i] == k and left + cost < bar:
            level[i], left = k + 1, left + cost
    return level, left


def best_of_block(block: dict, units: list[tuple[int, int, int]], counts: dict[int, int], bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and scores of the documents of a block that can be among the ``k`` best with at least ``bar``; maybe a few more.

    ``units``: pair number and two terms, or -1, a term and -1; ``counts``: the occurrences of each term in the item.
    """
    none = np.zeros(0, np.int64)

    def listed(t):
        p = block["place"].get(t)
        return (none, none, 0) if p is None else (block["slots"][block["at"][p] : block["at"][p + 1]], block["impacts"][block["at"][p] : block["at"][p + 1]], block["most"][p])

    found = {t: listed(t) for t in counts}
    shapes, lists = [], []
    for pair, a, b in units:
        (sa, _, ma), (sb, _, mb) = found[a], found[b] if b >= 0 else (none, none, 0)
        ca, cb = counts[a], counts[b] if b >= 0 else 0
        q = block["pair_place"].get(pair)
        together, joint = (none, 0) if q is None else (block["pair_slots"][block["pair_at"][q] : block["pair_at"][q + 1]], block["pair_most"][q])
        one = max(ca * ma, cb * mb)
        low = min(ca, cb)
        both = max(one, low * joint + (ca - low) * ma + (cb - low) * mb) if len(together) else one
        shapes.append((int(one), int(both), len(sa) + len(sb) - len(together), len(together)))
        lists.append(([sa, sb], [together]))
    bar = max(bar, *(c * block["floor"][block["place"][t]] for t, c in counts.items() if t in block["place"]), 1)
    level, out = plan(shapes, int(bar))
    chosen = [s for n, x in zip(level, lists, strict=True) if n < 2 for s in x[n] if len(s)]
    slots = np.unique(np.concatenate(chosen)) if chosen else none
    scores = np.zeros(len(slots), np.int64)
    # Fill in term by term, the strongest first; a document that cannot reach the bar any more goes.
    order = sorted(counts, key=lambda t: -counts[t] * int(found[t][2]))
    rest = sum(counts[t] * int(found[t][2]) for t in order)
    for t in order:
        s, v, m = found[t]
        if not len(slots):
            break
        if len(s):
            at = np.minimum(np.searchsorted(s, slots), len(s) - 1)
            scores = scores + np.where(s[at] == slots, counts[t] * v[at], 0)
        rest -= counts[t] * int(m)
        keep = scores + rest >= bar
        if not keep.all():
            slots, scores = slots[keep], scores[keep]
    if len(scores) > k:
        keep = scores >= _kth(scores, k)
        slots, scores = slots[keep], scores[keep]
    return slots, scores


def _round(docs: DataFrame, items: dict, k: int) -> DataFrame:
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    counted = settle(blocks(docs, numbers), "blocks")
    total = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    n, length = int(total[0]), int(total[1])
    df = counted.select(F.posexplode("terms").alias("i", "term"), "ends").select(
        "term", (F.expr("ends[i]") - F.when(F.col("i") > 0, F.expr("ends[i - 1]")).otherwise(0)).alias("n")).groupBy("term").agg(F.sum("n").alias("df")).toPandas()
    held = np.zeros(len(numbers), np.int64)
    held[df["term"].to_numpy()] = df["df"].to_numpy()
    weights = np.array([weight(n, int(x)) for x in held], np.int64)
    # Neighbours in order of weight make the pairs of an item: rare terms, whose bounds are greatest, with rare ones.
    pairs: dict[tuple[int, int], int] = {}
    plans = {}
    for name, found in items.items():
        counts = {numbers[t]: c for t, c in found.items()}
        order = sorted((t for t in counts if held[t] and weights[t] > 0), key=lambda t: (-weights[t], t))
        units = [(pairs.setdefault((min(a, b), max(a, b)), len(pairs)), min(a, b), max(a, b)) for a, b in zip(order[::2], order[1::2], strict=False)]
        if len(order) % 2:
            units.append((-1, order[-1], -1))
        if order:
            plans[name] = units, {t: counts[t] for t in order}
    wanted = np.array(list(pairs), np.int64).reshape(-1, 2)
    lists = settle(index(counted, weights, wanted, n, length, k), "index")
    # What k documents of some block are sure to score: no document below it is asked for in any block.
    floors = lists.select(F.posexplode("terms").alias("i", "term"), "floor").select("term", F.expr("floor[i]").alias("v")).groupBy("term").agg(F.max("v").alias("v")).toPandas()
    floor = dict(zip(floors["term"].tolist(), floors["v"].tolist(), strict=True))
    bars = {name: max((c * floor.get(t, 0) for t, c in counts.items()), default=0) for name, (_, counts) in plans.items()}
    shared = spark.sparkContext.broadcast((plans, bars))

    def search(batches):
        plans, bars = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "ids"}
                own |= {"at": _ranges(own["ends"]), "pair_at": _ranges(own["pair_ends"]), "place": {t: i for i, t in enumerate(own["terms"].tolist())},
                        "pair_place": {t: i for i, t in enumerate(own["pairs"].tolist())}}
                ids, out = batch.column("ids")[row].values, ([], [], [])
                for name, (units, counts) in plans.items():
                    slots, scores = best_of_block(own, units, counts, bars[name], k)
                    out[0].extend([name] * len(slots))
                    out[1].append(slots)
                    out[2].append(scores)
                if out[0]:
                    slots = pa.array(np.concatenate(out[1]).astype(np.int64))
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array(out[0], pa.int64()), "doc_id": ids.take(slots), "score": pa.array(np.concatenate(out[2]), pa.int64())})

    return lists.mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of each item with a score above 0; ties by ascending ``doc_id``.

    A null text has no terms. Documents without an id are ranked after equal scores with one; repeated rows are
    documents of their own. Items without an id are not asked for. Terms that no document holds add nothing. The
    items' terms are sent to every task, in rounds of at most ``TERM_BYTES``; documents are read once per round.
    """
    held = read_items(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null"))
    rounds: list[dict] = [{}]
    size = 0
    for name, found in held.items():
        own = sum(100 + len(t) for t in found)
        if size + own > TERM_BYTES and rounds[-1]:
            rounds.append({})
            size = 0
        rounds[-1][name] = found
        size += own
    out = None
    for part in rounds:
        best = _round(docs, part, k)
        out = best if out is None else out.union(best)
    one = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.select("item_id", F.row_number().over(one).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
