"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.operators.stored import settle

#: Links that a task puts together in memory at once.
_AT_ONCE = 1 << 17


def contracted(links: DataFrame, at_once: int = _AT_ONCE) -> DataFrame:
    """As few links with the same components: by every ``at_once`` links of a task, each node hangs on the smallest one that it reaches."""

    def root(up: dict[int, int], x: int) -> int:
        while (p := up.get(x)) is not None:
            if (q := up.get(p)) is None:
                return p
            up[x] = x = q
        return x

    def stars(up: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(up, x) for x in list(up)], pa.int64())], ["a", "b"])

    def run(batches):
        up, n = {}, 0
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(up, a), root(up, b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            n += batch.num_rows
            if n >= at_once:
                yield stars(up)
                up, n = {}, 0
        if up:
            yield stars(up)

    return links.mapInArrow(run, "a long, b long")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and on none if another hangs on it."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return not nodes.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0)))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of every node with a link in ``a``, ``b``.

    First each task puts together what it can by its own links. Then each round hangs the neighbours of a node on the
    smallest one among them: first the larger neighbours of every node, then the smaller ones. Groups shrink to minima
    by partial aggregation and are joined back, so no neighbourhood is held in memory; the number of links never
    grows. Each round is written to the shared folder, which ends its lineage. The end is reached when every node
    hangs on its root.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = settle(contracted(both), "links")
    for _ in range(most_rounds):
        if _are_stars(held):
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        # Large star: of all neighbours of a node, the larger ones hang on the smallest, or on the node itself.
        arcs = held.select("a", "b").union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = arcs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        held = settle(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError(f"no end after {most_rounds} rounds")
