"""Approximate nearest neighbours by a forest of random-projection trees, reranked exactly.

Equal vectors are one class, so copies cost nothing and share their answers. The forest is grown on a bounded sample
and broadcast; every class is filed under its leaf in each tree; every query class goes to the leaves that its
shared-queue search names first. Leaf by leaf, inner products in double precision give the best classes, and the best
of all leaves are expanded to their members.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.forest import Forest, grow
from momentloom.operators.stored import settle

#: Vectors that the forest is grown on, and queries that the number of visits is tuned on, at most.
SAMPLE, PROBES = 1 << 16, 128
#: Filed vectors, and searches, of one block at most, about.
BLOCK = 32_768
FOUND = "query_id long, rank int, vec_id long, score double"


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _stack(column: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, each summed alike wherever the row stands."""
    return (x * q).sum(1)


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Class ids, and the vectors of a batch as a matrix of doubles."""
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column("cid").to_numpy(), flat.reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def tuned(classes: DataFrame, queries: DataFrame, forest: Forest, k: int, recall: float) -> int:
    """Leaves to visit for a recall of ``recall``, by brute force for up to ``PROBES`` queries against all rows.

    Each task keeps the ``k`` best of its rows per probe; the k best of all tell how far down the search their
    leaves stand.
    """
    probes = queries.orderBy(F.xxhash64("cid"), "cid").limit(PROBES).toPandas()
    if not len(probes):
        return 1
    names, q = probes["cid"].to_numpy(), np.stack(probes["v"].to_list()).astype(np.float64)

    def brute(batches):
        for batch in batches:
            ids, x = _bytes(batch)
            rows = [(p, c, float(s)) for p, v in enumerate(q) for scores in [x @ v] for i in _best(scores, ids, k + 1) for c, s in [(int(i), scores[i])] if ids[i] != names[p]]
            leaves = forest.routed(x[[r[1] for r in rows]]) if rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_pydict({"p": pa.array([r[0] for r in rows], pa.int32()), "s": pa.array([r[2] for r in rows], pa.float64()),
                                              "leaves": pa.array(list(leaves), pa.list_(pa.int64()))})

    best = classes.select("cid", "v").mapInArrow(brute, "p int, s double, leaves array<long>")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("s")))).where(F.col("r") <= k).toPandas()
    depths = []
    order = {p: {leaf: i for i, leaf in enumerate(forest.search(v, forest.leaves))} for p, v in enumerate(q)}
    for p, leaves in zip(best["p"], best["leaves"], strict=True):
        depths.append(min(order[p][x] for x in leaves) + 1)
    return int(np.quantile(depths, recall, method="higher")) if depths else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 8, leaf: int = 512, recall: float = 0.95, seed: int = 11) -> DataFrame:
    """For each query row of ``vectors`` (``vec_id``, ``embedding``) its ``k`` nearest found rows other than its own, by largest inner product.

    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller ``vec_id``. Vectors that are null,
    zero, of another length than most, or hold null or non-finite components take no part; nor do rows without an id. The number of leaves
    visited is tuned to ``recall`` on a sample of queries (``tuned``): vectors without structure need a large share
    of all leaves, clustered ones few. Rows of equal ids are one row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], FOUND)
    width = width["w"]
    rows = rows.where(F.size("v") == width).withColumn("h", F.xxhash64("v"))
    few = Window.partitionBy("h", "v").orderBy("vec_id")
    members = rows.groupBy("h", "v", "vec_id").agg(F.max("asks").alias("asks"))
    # A class needs its smallest k + 1 ids only: more of its members can't be among anyone's k nearest.
    classes = settle(members.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).groupBy("h", "v").agg(
        F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asking = settle(members.where("asks").select(F.col("vec_id").alias("query_id"), "h", "v").join(classes.select("h", "v", "cid"), ["h", "v"]).select("query_id", "cid"), "queries")
    queries = asking.select("cid").distinct().join(classes.select("cid", "v"), "cid")

    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    share = min(1.0, 0.98 * SAMPLE / n)
    taken = classes.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("cid", "v").toPandas().sort_values("cid")
    sample = np.stack(taken["v"].to_list()).astype(np.float64) if len(taken) else np.zeros((0, width))
    forest = grow(sample, trees, max(8, int(leaf * share)), longest * 1.000001, seed)
    visits = tuned(classes, queries, forest, k, recall)
    shared = spark.sparkContext.broadcast(forest)

    # A block is a bin of whole leaves, or part of a large one. Medians fill leaves evenly, so these sizes hold well enough.
    bins = max(1, trees * n // BLOCK)
    parts = max(1, n * trees // max(1, forest.leaves) // BLOCK)
    groups = max(1, visits * queries.count() // min(bins, max(1, forest.leaves)) // (2 * BLOCK))

    def file(batches):
        for batch in batches:
            ids, x = _bytes(batch)
            leaves = shared.value.routed(x)
            raw = [r.tobytes() for r in x]
            for t in range(leaves.shape[1]):
                yield pa.RecordBatch.from_pydict({"leaf": leaves[:, t], "cid": ids, "x": pa.array(raw, pa.binary())})

    def ask(batches):
        for batch in batches:
            ids, x = _bytes(batch)
            for i in range(0, len(ids), 64):
                found = [(leaf, j) for j in range(i, min(i + 64, len(ids))) for leaf in shared.value.search(x[j], visits)]
                at = [j for _, j in found]
                yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf for leaf, _ in found], pa.int64()), "cid": ids[at], "x": pa.array([x[j].tobytes() for j in at], pa.binary())})

    # Keys of both sides must have one type, or equal keys are dealt to different tasks.
    spread = lambda df, own, n_own, other, n_other: df.withColumns({own: F.pmod(F.xxhash64("cid"), F.lit(n_own)).cast("long"), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))})
    schema = "leaf long, cid long, x binary"
    filed = spread(classes.select("cid", "v").mapInArrow(file, schema), "part", parts, "group", groups)
    asked = spread(queries.select("cid", "v").mapInArrow(ask, schema), "group", groups, "part", parts)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best classes of each query among the leaves of one bin; what several trees name counts once."""
        found = {leaf: at for leaf, at in left.groupby("leaf").indices.items()}
        qs, cs, scores = [], [], []
        for leaf, asks in right.groupby("leaf").indices.items():
            at = found.get(leaf)
            if at is None:
                continue
            names, x = left["cid"].to_numpy()[at], _stack(left["x"].iloc[at], width)
            for i in range(0, len(asks), 256):
                part = right.iloc[asks[i : i + 256]]
                q = _stack(part["x"], width)
                for name, v, rough in zip(part["cid"], q, q @ x.T, strict=True):
                    top = _best(rough, names, k + 1)
                    qs.append(np.full(len(top), name))
                    cs.append(names[top])
                    scores.append(_products(v, x[top]))
        if not qs:
            return pd.DataFrame({"q": [], "c": [], "score": []})
        every = pd.DataFrame({"q": np.concatenate(qs), "c": np.concatenate(cs), "score": np.concatenate(scores)}).drop_duplicates(["q", "c"])
        return every.sort_values(["q", "score", "c"], ascending=[True, False, True]).groupby("q", sort=False).head(k + 1)

    keys = ["bin", "part", "group"]
    binned = lambda df: df.withColumn("bin", F.pmod("leaf", F.lit(bins)).cast("long")).groupBy(keys)
    met = binned(filed).cogroup(binned(asked)).applyInPandas(block, "q long, c long, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    top = met.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    each = top.join(classes.select(F.col("cid").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    nearer = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("r", F.row_number().over(nearer)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(best, asking["cid"] == best["q"]).select("query_id", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
