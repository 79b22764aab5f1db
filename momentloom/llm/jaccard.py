"""Near-duplicates by the Jaccard similarity of word shingles: SimHash, bands of a MinHash sketch and rare shingles find pairs, whole texts decide.

A pair of similarity s shares a band of ``rows`` minima with a chance of s ** rows, so all ``bands`` miss it with
(1 - s ** rows) ** bands: 3e-6 at 0.8 for 32 bands of 5, less above. Only pairs that reach ``least`` exactly are linked.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm import simhash
from momentloom.llm.components import components
from momentloom.llm.memo import slices
from momentloom.operators.stored import settle

_CHUNK = 2048

#: 64-bit words of the parity marks of a set of shingles.
_MARKS = 32

#: Turns of ``neighbours`` at most, rows of a key that are put in one order, and partners that a node keeps of a turn.
_TURNS, _SLOT, _PARTNERS = 4, 256, 4


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one shingle, an empty one has none."""
    found = text.encode().lower().split()  # bytes: ASCII only, for case as for blanks
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    starts = np.cumsum([0] + [len(w) + 1 for w in found])
    n = max(1, len(found) - words + 1)
    ends = (starts[-1] - 1,) if n == 1 else (starts[words:] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 7) for a, b in zip(starts[:n].tolist(), ends, strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of ``shingles``; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@cache
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return tuple(r.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(low) for low in (1, 0))


def sketch(found: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit key per band."""
    a, b = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _CHUNK):
        np.minimum(least, (found[None, i : i + _CHUNK] * a + b).min(axis=1), out=least)
    own = least.reshape(bands, rows)
    return [xxhash.xxh64_intdigest(own[k].tobytes(), k) - (1 << 63) for k in range(bands)]


def marks(found: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``64 * _MARKS`` bins, as signed 64-bit words.

    A shingle that only one of two sets holds turns one bit, so the sets differ in at least as many shingles as their marks in bits.
    """
    odd = np.bincount((found >> np.uint64(17)) % np.uint64(64 * _MARKS), minlength=64 * _MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``version`` (hash of the text), ``node`` (hash of its set of shingles), its SimHash ``fp`` and its band ``keys`` of every row."""

    def run(batches):
        for batch in batches:
            nodes, keys, fps = [], [], []
            for texts in slices(batch.column("text")):
                for t in texts:
                    found = shingles(t, words)
                    nodes.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True))
                    keys.append(sketch(found, bands, rows))
                    fps.append(simhash.fingerprint(t, words))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "version": batch.column("version"), "node": pa.array(nodes, pa.int64()),
                "fp": np.array(fps, "<u8").view("<i8"), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, node long, fp long, keys array<long>")


def _arrays(texts: DataFrame, words: int) -> DataFrame:
    """``node``, ``size``, ``found`` (its ``shingles``, as signed integers) and their ``marks`` of rows with ``node`` and ``text``."""

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                sets = [shingles(t, words) for t in part]
                found = [f.view(np.int64) for f in sets]
                ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_pydict({"node": batch.column("node")[at : at + len(part)], "size": pa.array(np.diff(ends), pa.int32()), "found": lists,
                                                      "marks": pa.array([marks(f).tolist() for f in sets], pa.list_(pa.int64()))})
                at += len(part)

    return texts.select("node", "text").mapInArrow(run, "node long, size int, found array<long>, marks array<long>")


def _reached(pairs: DataFrame, arrays: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``: nodes) with a similarity of ``least`` or more, by whole sets of shingles."""
    one, two = (arrays.select(F.col("node").alias(c), F.col("found").alias(f"found_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            one, two = batch.column("found_a"), batch.column("found_b")
            yes = [similarity(one[i].values.to_numpy(), two[i].values.to_numpy()) >= least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "found_a", "found_b").mapInArrow(run, "a long, b long")


def rare_keys(arrays: DataFrame, least: float) -> DataFrame:
    """``key`` (a shingle), ``node``, its ``size`` and the ``rank`` of the key in it, such that any two nodes with a similarity of ``least`` or more have a key in common.

    Two sets of which the larger has n shingles share at least ``least`` * n of them, so each holds a shared one among
    its n - ceil(least * n) + 1 rarest, whatever order all sets agree on. Here the order is by the number of nodes that
    hold a shingle: what one node alone holds takes its place among the rarest but is no key, and a passage that
    many nodes share is a key only of nodes that hold hardly anything else.
    """
    rows = arrays.select("node", "size", F.explode("found").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    one = Window.partitionBy("node").orderBy("n", "key")
    ranked = rows.join(held, "key").select(
        "key", "node", "size", F.row_number().over(one).alias("rank"),
        F.count("*").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("shared"))
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-6)) + 1
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("size") - F.col("shared")).cast("int"))
    return ranked.where(F.col("rank") <= prefix).select("key", "node", "size", "rank")


def _can_reach(least: float, a: str, b: str) -> Column:
    """Whether two nodes may reach the similarity, if the rarest shingle that they share has these ranks in them.

    They must share ``least / (1 + least)`` of the sum of their sizes, and all of that stands at these ranks or after.
    """
    share = F.ceil((F.col(f"size_{a}") + F.col(f"size_{b}")) * F.lit(least / (1 + least)) - F.lit(1e-6))
    return (F.col(f"rank_{a}") <= F.col(f"size_{a}") - share + 1) & (F.col(f"rank_{b}") <= F.col(f"size_{b}") - share + 1)


def _apart_at_most(least: float, a: str, b: str) -> Column:
    """Whether the marks of two nodes allow the similarity: sets that reach it differ in (1 - least) / (1 + least) of the sum of their sizes at most."""
    bits = sum(F.bit_count(F.col(f"marks_{a}")[i].bitwiseXOR(F.col(f"marks_{b}")[i])) for i in range(_MARKS))
    return bits <= F.floor((F.col(f"size_{a}") + F.col(f"size_{b}")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6))


def neighbours(at: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs (``a`` > ``b``: nodes) of different ``root`` that stand side by side under a key of ``at`` and whose sizes allow the similarity, of each ``a`` the few that it meets most.

    The rows of a key (``held`` of them) are dealt to slots of ``_SLOT`` rows or so, ordered by size in the first turn and
    at random in others. A row meets one other, so pairs are no more than rows, however many rows a key has.
    """
    chance = F.xxhash64(F.lit(turn), "key", "node")
    slot = F.pmod(F.xxhash64(F.lit(-1 - turn), "node"), F.ceil(F.col("held") / _SLOT))
    line = Window.partitionBy("key", "slot").orderBy(*([F.col("size")] if turn == 0 else []), chance)
    met = at.withColumn("slot", slot).select("node", "root", "size", F.lead(F.struct("node", "root", "size")).over(line).alias("next"))
    met = met.where((F.col("root") != F.col("next.root")) & (F.least("size", "next.size") >= F.greatest("size", "next.size") * F.lit(least) - F.lit(1e-6)))
    often = met.groupBy(F.greatest("node", "next.node").alias("a"), F.least("node", "next.node").alias("b")).agg(F.count("*").alias("n"))
    most = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return often.withColumn("place", most).where(F.col("place") <= _PARTNERS).select("a", "b")


def candidates(at: DataFrame, arrays: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (``a`` > ``b``: nodes) of different ``root`` under one key of ``at`` (``rare_keys`` with a root) that may reach the similarity."""
    marked = at.select("key", "node", "root", "size", "rank").join(arrays.select("node", "marks").hint("merge"), "node")
    one, two = (marked.select("key", F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("root", "size", "rank", "marks")]) for c in "ab")
    met = (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")) & _can_reach(least, "a", "b") & _apart_at_most(least, "a", "b")
    return one.join(two, "key").where(met).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """``doc_id``, ``version`` (hash of the text) and ``stays`` of every row of ``docs``.

    Rows of one component of pairs with a similarity of ``least`` or more have one that stays, by the smallest
    ``doc_id`` and then ``version``; null ids come last. Texts with equal shingles are one node and make no pairs.
    Null and empty texts are copies of each other; so are an empty table's.

    Pairs are looked for in rounds, and what a round has put together makes no more pairs. First each node is
    held against the least node of its SimHash component (fingerprints within 4 bits), and against the node with which
    it shares most bands. Nodes that still share a band with a
    node elsewhere are filed under their ``rare_keys``, and held against the least node of the key that they share with
    most; then, for a few turns or until one finds nothing, against nodes that they stand beside under a key, so that most of a group is put together by as many pairs
    as it has rows. Last, nodes that are still apart under a key are held against each other, where their sizes, the place of the key in them and their ``marks`` allow the similarity. Passages that many texts
    share are no keys, so texts that have only such a passage in common are not compared.
    """
    keyed = _keyed(docs)
    own = settle(_sketches(keyed, words, bands, rows), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    nodes = settle(own.groupBy("node").agg(F.min(F.struct(place.alias("place"), "fp", "keys")).alias("least")).select("node", "least.place", "least.fp", "least.keys"), "nodes")
    filed = nodes.select("node", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    met = settle(filed.join(shared, "key"), "met")
    often = met.where("node > centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    banded = often.groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("b")).select(F.col("node").alias("a"), "b")
    prints = nodes.select("fp").distinct()
    alike = nodes.select("node", "fp").join(components(simhash.links(prints)).withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("component", "fp").alias("print"))
    heads = alike.groupBy("print").agg(F.min("node").alias("b"))
    printed = alike.join(heads, "print").where("node <> b").select(F.col("node").alias("a"), "b")
    nearest = settle(banded.union(printed).distinct(), "nearest")

    asked = met.select("node").union(nearest.select(F.explode(F.array("a", "b")))).distinct()
    firsts = nodes.join(asked, "node", "left_semi").select("node", F.col("place.doc_id").alias("d"), F.col("place.version").alias("v"))
    texts = keyed.join(firsts.hint("merge"), (keyed["version"] == firsts["v"]) & keyed["doc_id"].eqNullSafe(firsts["d"])).select("node", "text").dropDuplicates(["node"])
    arrays = settle(_arrays(texts, words), "arrays")
    tied = components(settle(_reached(nearest, arrays, least), "links"))

    def joined(found: DataFrame) -> DataFrame:
        """The components so far with those links ``found`` since; what hangs together is handed on as one link per node."""
        return components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))

    def placed(keys: DataFrame) -> DataFrame:
        """``keys`` with the ``root`` of their nodes by the components so far, where a key has several; ``low`` is the least of them and ``centre`` its row."""
        at = keys.join(tied, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
        first = F.struct("root", *[c for c in keys.columns if c != "key"])
        apart = at.groupBy("key").agg(F.min(first).alias("centre"), F.max("root").alias("high"), F.count("*").alias("held")).where("centre.root < high")
        return settle(at.join(apart.select("key", "centre", "held"), "key"), "apart")

    left = placed(met.select("key", "node")).select("node").distinct()
    rare = settle(rare_keys(arrays.join(left, "node", "left_semi"), least), "rare")
    at = placed(rare)
    starred = at.where(F.col("root") != F.col("centre.root")).select(
        F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("rank").alias("rank_a"), F.col("centre.node").alias("b"),
        F.col("centre.size").alias("size_b"), F.col("centre.rank").alias("rank_b")).where(_can_reach(least, "a", "b"))
    often = starred.groupBy("a", "b").agg(F.count("*").alias("n"))
    stars = settle(often.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), "stars")
    tied = joined(_reached(stars, arrays, least))
    at = placed(rare)
    for turn in range(_TURNS):
        found = settle(_reached(settle(neighbours(at, least, turn), "beside"), arrays, least), "links")
        if found.isEmpty():
            break
        tied = joined(found)
        at = placed(rare)
    rest = candidates(at, arrays, least).join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    tied = joined(_reached(settle(rest, "rest"), arrays, least))

    rooted = nodes.drop("keys", "fp").join(tied, "node", "left").withColumn("root", F.coalesce("component", "node"))
    first = rooted.groupBy("root").agg(F.min("place").alias("first"))
    by_node = rooted.join(first, "root").select("node", F.col("first.doc_id").alias("fd"), F.col("first.version").alias("fv"))
    stays = F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("version") == F.col("fv"))
    return own.drop("keys", "fp").join(by_node, "node").select("doc_id", "version", stays.alias("stays"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays. A row is named by id and text; its other columns, of whatever names, stay with it."""
    gone = near_duplicates(docs, **how).where(~F.col("stays")).select("doc_id", "version").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("named"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("of"))
    left = whole.join(gone, (whole["of"] == gone["version"]) & whole["named"].eqNullSafe(gone["doc_id"]), "left_anti")
    return left.dropDuplicates(["named", "of"]).select("row.*")
