"""Near-duplicates by SimHash, with multi-index hashing.

A fingerprint has 64 bits; two link at ``radius`` or fewer differing bits. Cut into segments, two linked ones agree
in some segment up to radius // segments bits. So every fingerprint is filed under each of its segments, and looked
up under every value in a small Hamming ball around each of its segments; what meets is compared in full.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.llm.components import components
from momentloom.llm.memo import slices
from momentloom.operators.stored import settle


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text: a bit is set if it is set in over half the hashes of its word shingles, repeats included."""
    found = text.encode().lower().split()  # bytes: ASCII only, for case as for blanks
    if not found:
        return 0
    joined = b" ".join(found)
    starts = np.cumsum([0] + [len(w) + 1 for w in found])
    n = max(1, len(found) - words + 1)
    ends = (starts[-1] - 1,) if n == 1 else (starts[words:] - 1).tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.packbits(counts * 2 > n, bitorder="little").view("<u8"))[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64-bit) of every row. Null text counts as empty: fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, words, seed) for texts in slices(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": np.array(fps, "<u8").view("<i8")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def cuts(segments: int, bits: int = 64) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(fp: Column, segments: int, reach: int) -> Column:
    """A key for every value in the Hamming ball of ``reach`` bits around each segment: segment number and value in one."""
    out = []
    for i, (a, w) in enumerate(cuts(segments)):
        own = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(i << 56))
        flips = [sum(1 << b for b in c) for k in range(reach + 1) for c in combinations(range(w), k)]
        out += [own.bitwiseXOR(F.lit(x).cast("long")) if x else own for x in flips]
    return F.explode(F.array(*out))


def links(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``a`` > ``b`` of the distinct fingerprints in ``fp`` that differ in at most ``radius`` bits, each once.

    Both sides of a pair would find each other, so only what the larger one finds is kept. Only linked pairs leave
    the join; a segment value that many share is split like any skewed join.
    """
    table = fps.select(_keys(F.col("fp"), segments, 0).alias("key"), F.col("fp").alias("b"))
    probes = fps.select(_keys(F.col("fp"), segments, radius // segments).alias("key"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return probes.join(table, (probes.key == table.key) & (F.col("a") > F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4, segments: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach, one row per row of ``docs``.

    Texts are read once. Equal fingerprints are one node, so copies make no pairs. Null and empty texts have
    fingerprint 0 and link like any other; null ids take part but name no component; other columns are ignored.
    """
    own = settle(fingerprints(docs, words, seed), "fingerprints")
    nodes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, segments)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")

