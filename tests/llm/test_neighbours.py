"""Nearest neighbours against brute force."""

import numpy as np
from momentloom.llm import neighbours
from momentloom.llm.forest import grow
from pyspark.sql import functions as F


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float((v * w).sum()), j) for j, w in ok if j != i))[:k]
    return out


def search(spark, rows, **how):
    floats = [(i, None if v is None else [None if x is None else float(x) for x in v], "q") for i, v in rows]
    df = spark.createDataFrame(floats, "vec_id long, embedding array<float>, cid string").repartition(3)
    found = {}
    for r in neighbours.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, **how).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in found.items()}


def test_edges_and_copies(spark):
    rng = np.random.default_rng(0)
    draw = lambda n: rng.normal(size=(n, 6)).astype(np.float32).tolist()
    same = draw(1)[0]
    rows = list(enumerate(draw(200))) + [(1000 + i, same) for i in range(300)]
    rows += [(3000, None), (3020, [0.0] * 6), (3040, [1.0, None, 0, 0, 0, 0]), (3060, [float("nan")] * 6), (3080, [float("inf")] * 6), (3100, [1.0, 2.0]), (None, same)]
    got, want = search(spark, rows, k=5), brute(rows, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, 6))
        assert [i for _, i, _ in got[q]] == [i for _, i in best]
        assert np.allclose([s for *_, s in got[q]], [-s for s, _ in best], atol=1e-12, rtol=0)


def test_few_rows(spark):
    rows = [(0, [1.0, 0, 0, 0, 0, 0]), (1, [0.5, 0, 0, 0, 0, 0]), (2, [2.0, 1, 0, 0, 0, 0])]
    assert [i for _, i, _ in search(spark, rows, k=20)[0]] == [2, 1]
    assert search(spark, [(20, [1.0] * 6)], k=3) == {}
    assert search(spark, [(1, [1.0] * 6)], k=3) == {}
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate((rng.normal(size=(4000, 6)) * rng.uniform(0.2, 2, size=(4000, 1))).astype(np.float32).tolist()))
    got, want = search(spark, rows, k=10, leaf=64, trees=6), brute(rows, 10)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in best}) for q, best in want.items())
    assert hits / (10 * len(want)) >= 0.9


def test_search_reaches_every_leaf():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    f = grow(x, 3, 20, float(np.linalg.norm(x, axis=1).max()))
    assert sorted(f.search(x[0], f.leaves)) == list(range(f.leaves))
    assert f.search(x[0], 5) == f.search(x[0], f.leaves)[:5]
    assert len(set(f.routed(x).ravel().tolist())) == f.leaves
