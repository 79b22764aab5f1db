"""Global row numbers, gapless from 0, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentloom.operators.stored import settle

_BITS = 33  # monotonically_increasing_id keeps the row in its partition below, the partition above


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``) and ``row_number`` (from 0) by the order of the columns ``order``.

    Rows equal in all of ``order`` are interchangeable. Rows are dealt out by range, sorted within partitions and
    written once; the number of a row is its place in its partition plus the rows of all partitions before. That
    running sum is over one row per partition of the shuffle, which is also the bound of what is broadcast.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(dealt.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("place")), "numbered")
    placed = placed.withColumn("part", F.shiftright("place", _BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    row = F.col("base") + F.col("place").bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.join(F.broadcast(bases), "part").select("row", row.alias("row_number"))
