"""SimHash near-duplicates against all pairs."""

import random
import re

import xxhash
from llm.conftest import EDGES, prose
from momentloom.llm import components as module
from momentloom.llm import simhash
from momentloom.llm.components import components
from pyspark.sql import functions as F


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for _, t in EDGES:
        if len(t or "") < 100_000:
            assert simhash.fingerprint(t or "") == plain(t)


def test_links_are_complete(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        for _ in range(5):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for segments in (2, 3, 4):
        got = {tuple(sorted(((r.a) % (1 << 64), (r.b) % (1 << 64)))) for r in simhash.links(spark.createDataFrame(signed, "fp long"), 4, segments).collect()}
        assert got == want


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: c for n, c in roots(pairs, {n for p in pairs for n in p}).items() if n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark, edges, no_docs):
    base = prose(9, 3000)
    rows = [(100 + i, base[: -1 - i] + "x") for i in range(20)] + [(200 + i, prose(100 + i, 40)) for i in range(40)]
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = simhash.near_duplicates(docs).collect()
    fps = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got]
    assert len(fps) == docs.count()
    comp = roots([(a, b) for a in {f for _, f, _ in fps} for b in {f for _, f, _ in fps} if (a ^ b).bit_count() <= 4], {f for _, f, _ in fps})
    least = {}
    for i, f, _ in fps:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    assert all(c == least.get(comp[f]) for _, f, c in fps)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_hot_text(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one text that most documents have")).otherwise(F.concat(F.lit("own text number "), F.col("id").cast("string"))).alias("text"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i] == 1 for i in range(2000) if i % 3)


def test_components_take_few_tables(spark, monkeypatch):
    """Links that fit one task are put together as they are written; others, cut small, need rounds and give the same."""
    written, settle = [], module.settle
    monkeypatch.setattr(module, "settle", lambda *a: (written.append(1), settle(*a))[1])
    r = random.Random(8)
    pairs = [(r.randint(0, 900), r.randint(0, 900)) for _ in range(700)] + [(2000 + i, 2001 + i) for i in range(300)]
    links = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    want = roots(pairs, {n for p in pairs if p[0] != p[1] for n in p})
    assert {x.node: x.component for x in components(links).collect()} == want and len(written) == 1
    cut = module.contracted
    monkeypatch.setattr(module, "contracted", lambda links: cut(links.repartition(5), 100))
    assert {x.node: x.component for x in components(links).collect()} == want and len(written) > 2
