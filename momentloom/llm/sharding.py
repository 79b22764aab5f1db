"""Shuffling rows into shards by a Feistel permutation of their global row numbers.

Row x of n goes to place P(x); shard is the place modulo the shards, slot the place divided by them. P is a keyed
bijection of [0, n): a mixed-radix Feistel network over a * b >= n numbers, applied again while the result is n or
more. So both directions need only n and the key: no table of places exists anywhere. Only SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.operators.numbering import numbered

ROUNDS = 8


def radices(n: int) -> tuple[int, int]:
    """The two radices of the network over at least ``n`` numbers; fewer than the first are over ``n``."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, key: int) -> Column:
    """The place of number ``x`` among ``n`` numbers.

    A walk ends after at most a * b - n further rounds of the network, as no more numbers lie outside; only those
    few numbers, fewer than one in the root of n, take it.
    """
    a, b = radices(n)

    def network(v: Column) -> Column:
        low = F.pmod(v, F.lit(a)).cast("long")
        start = F.struct(low.alias("l"), F.call_function("div", v - low, F.lit(a)).alias("r"))

        def step(s: Column, j: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], F.lit(key), j), F.lit(a)), F.lit(a)).cast("long")
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], F.lit(key), j), F.lit(b)), F.lit(b)).cast("long")
            even = F.pmod(j, F.lit(2)) == 0
            return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

        rounds = F.array(*[F.lit(j) for j in range(ROUNDS)])
        return F.aggregate(rounds, start, step, lambda s: s["r"] * F.lit(a) + s["l"])

    first = network(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, a * b - n))), first, lambda p, _: F.when(p < n, p).otherwise(network(p)))
    return F.when(first < n, first).otherwise(walk)


def shard(rows: DataFrame, order: list[str], shards: int, key: int = 0) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard); shard sizes differ by one row at most.

    ``order`` fixes the row numbers and thereby the shuffle: the same rows, order and key give the same places on any
    cluster. Nulls in ``order`` come first; rows equal in it are interchangeable, so repeated rows take different
    slots. An empty table gives no rows; columns named
    ``shard`` or ``slot`` are replaced. Pass narrow rows: they are shuffled and written once; texts can be
    joined to the places later, or read shard by shard.
    """
    held = numbered(rows.drop("shard", "slot"), order)
    n = held.count()
    place = held.select("row", permuted(F.col("row_number"), n, key).alias("place"))
    return place.select("row.*", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
