"""Feistel shards: a bijection for every size, equal shards, the same on any partitioning."""

import pytest
from momentloom.llm import sharding
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_shards(edges, no_docs):
    def places(df):
        return sorted(((r.doc_id if r.doc_id is not None else -99, r.text or "", r.shard, r.slot) for r in sharding.shard(df, ["doc_id", "text"], 4, key=3).collect()))

    got = places(edges)
    assert got == places(edges.repartition(7))
    by = {}
    for *_, shard, slot in got:
        by.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(i, [])) for i in range(4)]
    assert sum(sizes) == edges.count() and max(sizes) - min(sizes) <= 1
    assert sharding.shard(no_docs, ["doc_id"], 4).collect() == []


def test_clashing_columns(spark):
    rows = spark.range(20).selectExpr("id", "id AS row_number", "id AS place", "id AS slot", "1 AS base")
    out = sharding.shard(rows, ["id"], 4)
    assert out.columns == ["id", "row_number", "place", "base", "shard", "slot"]
    assert all(r.id == r.row_number == r.place for r in out.collect())


def test_key_changes_the_shuffle(spark):
    rows = spark.range(500)
    a, b = ({r.id: (r.shard, r.slot) for r in sharding.shard(rows, ["id"], 8, key=k).collect()} for k in (0, 1))
    assert sum(a[i] == b[i] for i in a) < 30
