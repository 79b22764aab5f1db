"""Ranked search against brute force; bounds against what they bound."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.conftest import EDGES, WORDS
from momentloom.llm import lexical


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def plain(docs, items, k=20):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for place, (i, c, size) in enumerate(held):
            m = 75 + 25 * size * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, place, i))
        out += [(item, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda x: x[:2])


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda x: x[:2])


def corpus(seed, n, most=60):
    r = random.Random(seed)
    rare = [f"rare{i}" for i in range(300)]
    return [(i, " ".join(r.choice(WORDS if r.random() < 0.8 else rare) + r.choice(["", ",", "."]) for _ in range(r.randint(0, most)))) for i in range(n)]


def asked(seed, n):
    return [(i, t.upper() if i % 3 == 0 else t) for i, t in corpus(seed, n, 25)]


@pytest.mark.parametrize(("docs", "block", "k"), [(400, 8192, 20), (900, 50, 5), (600, 7, 1)])
def test_search_is_brute_force(spark, monkeypatch, docs, block, k):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    d, q = corpus(docs, docs), asked(3, 30)
    found = lexical.search(spark.createDataFrame(d, "doc_id long, text string").repartition(3), spark.createDataFrame(q, "item_id long, text string"), k)
    assert got(found) == plain(d, q, k)


def test_rounds_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERM_BYTES", 6000)
    d, q = corpus(1, 100), asked(4, 20)
    assert got(lexical.search(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(q, "item_id long, text string"))) == plain(d, q)


def test_edges(spark, edges, no_docs):
    q = [(1, "The, OF; one"), (2, None), (3, "!!"), (4, "日本語 éá Éá it"), (5, "nowhere"), (6, "the the the x")]
    items = spark.createDataFrame([(*x, "own") for x in [*q, q[0]]] + [(None, "the", "own")], "item_id long, text string, doc_id string")
    assert got(lexical.search(edges, items)) == plain(EDGES, q)
    assert lexical.search(no_docs, items).collect() == [] and lexical.search(edges, items.limit(0)).collect() == []
    assert lexical.search(edges.where("text is null"), items).collect() == []


def test_texts_of_one_id_count_together(spark):
    d = corpus(2, 60)
    items = spark.createDataFrame([(1, "the of"), (1, "rare1 rare2 the"), (1, "the of")], "item_id long, text string")
    assert got(lexical.search(spark.createDataFrame(d, "doc_id long, text string"), items)) == plain(d, [(1, "the of rare1 rare2 the")])


def test_plan_leaves_out_less_than_the_bar():
    r = random.Random(1)
    for _ in range(300):
        units = []
        for _ in range(r.randint(1, 9)):
            one = r.randint(0, 50)
            units.append((one, one + r.choice([0, 0, r.randint(0, 40)]), r.randint(0, 99), r.randint(0, 20)))
        bar = r.randint(1, 200)
        level, left = lexical.plan(units, bar)
        assert left < bar and left == sum((0, u[0], u[1])[n] for n, u in zip(level, units, strict=True))


def test_pair_bounds_leave_out_more_than_term_bounds():
    """Two terms that never meet: their pair is bounded by the greater one, so both lists can go; by sums they could not."""
    apart, sums = (60, 60, 100, 0), [(60, 60, 50, 0), (60, 60, 50, 0)]
    assert lexical.plan([apart], 100)[0] == [2] and 0 in lexical.plan(sums, 100)[0]


def test_kth():
    assert lexical._kth(np.array([5, 1, 9, 7]), 2) == 7 and lexical._kth(np.array([5]), 2) == 0
