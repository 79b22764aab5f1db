"""Quality and toxicity models: held-out accuracy, and their parts by themselves."""

import math
import random

import numpy as np
import pytest
from llm.conftest import EDGES
from momentloom.llm import labelled, quality, toxicity
from momentloom.llm.queries import QUERIES
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "by", "rest", "bar", "least"), [("op2_quality", "quality", 3, 1, 0.5, 0.97), ("op10_toxicity", "toxic", 4, 2, 0.3, 0.85)])
def test_held_out(spark, name, label, by, rest, bar, least):
    rows = QUERIES[name](spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= bar) for r in rows)
    told = [r for r in rows if r.held_out and r[label] is not None]
    assert np.mean([r.predicted == r[label] for r in told]) >= least
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) for r in rows)


def test_edges_are_scored(spark, edges, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 14)] + [(6, 1, None), (None, 1, 1), (99, None, 0)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for fitted in (labels, labels.limit(0)):
            model = module.fit(edges, fitted, label, 3, 1)
            rows = module.scored(edges, model).collect()
            assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
        assert module.scored(no_docs, module.fit(no_docs, labels, label, 3, 1)).collect() == []


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y0"))
    a, b = ({r.doc_id for r in labelled.sample(x, "y0", 3, 1, most=2000).collect()} for x in (labels, labels.repartition(5)))
    assert a == b and 1700 < len(a) < 2150


def test_isotonic():
    x, level = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]), np.ones(6))
    assert level.tolist() == [0, 0.5, 1, 1, 1][: len(level)] or all(a <= b for a, b in zip(level, level[1:], strict=False))
    assert np.isclose(np.interp(1.5, x, level), 0.5)


def _counts(seed, letters="abcd", words=400):
    r, counts = random.Random(seed), {}
    for _ in range(words):
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 7)))
        for g in toxicity.grams(w):
            a, b = counts.get(g, (0, 0))
            y = r.random() < 0.3
            counts[g] = (a + (not y), b + y)
    return counts


def test_kneser_ney_sums_to_one():
    counts = _counts(1)
    shared = toxicity.Shared.of(toxicity.continuations([*counts, *_counts(2, "abcdef")]))
    model = toxicity.KneserNey(counts, shared)
    letters = sorted({g for g in shared.n if len(g) == 1})
    assert set("abcdef") < set(letters)
    for h in [*model.seen, "zz", "\x02z", ""]:  # "?" stands for all characters that were never seen
        for y in (0, 1):
            if h:
                assert sum(model.chance(h + c, y) for c in [*letters, "?"]) == pytest.approx(1)
        assert sum(model.backoff(h + c) for c in [*letters, "?"]) == pytest.approx(1)


def test_kneser_ney_by_the_formula():
    """One context by hand: discounted own counts, the rest to discounted continuation counts."""
    model = toxicity.KneserNey({"ab": (3, 0), "ac": (1, 2), "b": (9, 9), "c": (9, 9)}, toxicity.Shared(dict(b=2, c=1), {"": 3}, {"": 2}, 2))
    low = lambda n: (n - 0.75) / 3 + 0.75 * 2 / 3 / 3
    assert model.chance("ab", 0) == pytest.approx(2.25 / 4 + 0.75 * 2 / 4 * low(2))
    assert model.chance("ac", 0) == pytest.approx(0.25 / 4 + 0.75 * 2 / 4 * low(1))
    assert model.chance("ab", 1) == pytest.approx(0.75 * 1 / 2 * low(2))
    assert model.chance("xb", 1) == pytest.approx(low(2))


def test_unseen_grams_say_what_their_context_says():
    ratios, contexts = toxicity.log_ratios(counts := _counts(1))
    assert set(ratios) == set(counts) and all(map(math.isfinite, [*ratios.values(), *contexts.values()]))
    model = toxicity.Model(ratios, contexts)
    assert model.word("zzzz")[0] == pytest.approx(sum(contexts.get(g[:-1], 0) for g in toxicity.grams("zzzz")))


def test_needed_continuations_are_enough(spark):
    counts, every = _counts(3, "abc", 60), [*_counts(4, "abcdefgh", 900), *_counts(3, "abc", 60)]
    ends = spark.createDataFrame(list(toxicity.continuations(every).items()), "gram string, n long")
    told = spark.createDataFrame([(g,) for g in counts], "gram string")
    few, all_ = toxicity.Shared.needed(ends, told), toxicity.Shared.of(toxicity.continuations(every))
    assert len(few.n) < len(all_.n) / 2
    for one, two in zip(toxicity.log_ratios(counts, few), toxicity.log_ratios(counts, all_), strict=True):
        assert one == pytest.approx(two)


def test_rows_without_an_id_are_counted_where_they_are(spark):
    docs = spark.createDataFrame([(None, "abc abd")] * 50 + [(1, "abc"), (2, "xyz")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", 4, 9)
    assert set(model.ratios) <= {g for w in ("abc", "xyz") for g in toxicity.grams(w)}


def test_rare_stem_is_found():
    counts = {}
    for w, y, n in [("table", 0, 50), ("tailor", 0, 30), ("vexling", 1, 6), ("vexlorn", 1, 6), ("table", 1, 20)]:
        for g in toxicity.grams(w):
            c = counts.setdefault(g, [0, 0])
            c[y] += n
    model = toxicity.Model(*toxicity.log_ratios({g: tuple(c) for g, c in counts.items()}))
    assert model.word("vexlish")[0] > 1 > model.word("table")[0]


def test_counts_grow_with_the_corpus(spark):
    """Every labelled row but those that set the weights is counted, rare grams too; backoff counts cover unlabelled text."""
    word = lambda i, c: c + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + c
    rows = [(i, f"common words here {word(i, 'q' if i % 2 else 'z')}") for i in range(300)] + [(1000 + i, f"unlabelled {word(i, 'x')}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    setting = {r.doc_id for r in labelled.sample(labels, "toxic", 4, 2, 40).where("fold = 0").collect()}
    held = {r.doc_id for r in labels.where(labelled.held_out("doc_id", 4, 2)).collect()}
    assert 0 < len(setting) < 30
    counts = {}
    for i, t in rows[:300]:
        if i not in setting | held:
            for g in (g for w in t.split() for g in toxicity.grams(w)):
                c = counts.setdefault(g, [0, 0])
                c[i % 2] += 1
    seen = {g for _, t in rows for w in t.split() for g in toxicity.grams(w)}
    want = toxicity.log_ratios(counts, toxicity.Shared.of(toxicity.continuations(seen)))
    model = toxicity.fit(docs, labels, "toxic", 4, 2, most=40)
    assert model.ratios == pytest.approx(want[0]) and model.contexts == pytest.approx(want[1])
    assert model.ratios != pytest.approx(toxicity.log_ratios(counts)[0])
