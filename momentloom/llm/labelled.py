"""Labelled rows for fitting a classifier: a bounded, repeatable sample, joined to texts without moving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on at most; their ids are broadcast (16 bytes each).
MOST_ROWS = 100_000
_GRAIN = 1 << 20


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))


def held_out(doc_id: str, by: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, by) == rest, F.lit(False))


def sample(labels: DataFrame, label: str, by: int, rest: int, most: int = MOST_ROWS) -> DataFrame:
    """``doc_id``, ``y`` (0 or 1) and ``fold`` (0 to 4) of at most about ``most`` labelled rows that are not held out.

    Rows with a null id or label are left out; an id with several labels gets their mean, rounded. Which rows are
    taken and their folds follow from a hash of the id.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", by, rest))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("y"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("taken")), F.lit(_GRAIN)) < int(_GRAIN * 0.98 * most / n))
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int"))


def texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """``text``, ``y`` and ``fold`` of the sampled documents; ``taken`` is as bounded as ``sample`` makes it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(taken), "doc_id").select("text", "y", "fold")
