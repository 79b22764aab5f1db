"""Near-duplicates by Jaccard similarity against brute force."""

import random

import corpus_pipeline
import pytest
from llm.conftest import EDGES, prose
from llm.test_simhash import roots
from momentloom.llm import jaccard
from pyspark.sql import functions as F


def plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def survivors(rows):
    """Ids that stay, by all pairs; ids are unique."""
    sets = {i: plain(t) for i, t in rows}
    root = roots([(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], sets)
    return sorted({min(j for j in root if root[j] == root[i]) for i in root})


def edited(text, n, r):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.getrandbits(30)}"
    return " ".join(w)


def test_shingles():
    for _, t in EDGES:
        assert len(jaccard.shingles(t or "")) == len(plain(t))
    a, b = prose(1, 100), edited(prose(1, 100), 3, random.Random(2))
    assert jaccard.similarity(jaccard.shingles(a), jaccard.shingles(b)) == len(plain(a) & plain(b)) / len(plain(a) | plain(b))


def test_stage_is_brute_force(spark):
    r = random.Random(3)
    rows = []
    for g in range(40):
        base = " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(30, 300)))
        rows += [(len(rows) + k, t) for k, t in enumerate([base] + [edited(base, max(1, len(base.split()) * p // 1000), r) for p in (5, 12, 18, 22, 25, 40)])]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == survivors(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    assert sorted(x.doc_id for x in jaccard.one_of_each(docs).collect()) == survivors(rows)


def test_edges(edges, no_docs):
    kept = jaccard.one_of_each(edges)
    assert kept.columns == edges.columns and jaccard.one_of_each(no_docs).collect() == []
    got = sorted((x.doc_id is None, x.doc_id or 0) for x in kept.select("doc_id").collect())
    # Empty texts go with the smallest id among them, copies too; the named text without an id has no relative.
    assert got == sorted([(False, i) for i in (1, 4, 5, 6, 8, 9, 10, 11, 12, -5, 13)] + [(True, 0)])


def test_repeated_ids(spark):
    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    rows = [(1, a), (1, b), (0, b), (2, a), (3, a + " x"), (5, c), (5, c), (None, c), (None, c)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(1, a), (0, b), (5, c)])


@pytest.mark.parametrize("n", [1500])
def test_hot_group(spark, n):
    base = prose(31, 200)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " "), F.col("id").cast("string")).alias("text"))
    assert [x.doc_id for x in jaccard.one_of_each(docs).collect()] == [0]


def test_rare_keys_meet_all_pairs(spark):
    """Any two sets of a similarity of 0.8 or more share a key; a passage that all share is no key of texts with much else."""
    r = random.Random(7)
    texts = []
    for _ in range(25):
        base = " ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(6, 120)))
        texts += [base] + [edited(base, k, r) for k in (1, 1, 2, 3) if len(base.split()) > 5 * k]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    keys = jaccard.rare_keys(jaccard._arrays(rows, 5), 0.8).collect()
    by = {}
    for k in keys:
        by.setdefault(k.node, set()).add(k.key)
    sets = [plain(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
    assert len(pairs) > 50 and all(by[a] & by[b] for a, b in pairs)
    passage = prose(41, 60)
    texts = [f"{' '.join(f'own{i}x{j}' for j in range(40))} {passage}" for i in range(50)]
    assert jaccard.rare_keys(jaccard._arrays(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5), 0.8).count() == 0


def test_many_texts_with_one_passage(spark):
    """Distinct texts that share most of their words but are not linked, and near copies of some of them."""
    r = random.Random(9)
    passage = prose(51, 120)
    rows = []
    for i in range(400):
        text = f"{' '.join(f'own{r.getrandbits(30)}' for _ in range(r.randint(25, 60)))} {passage}"
        rows.append((2 * i, text))
        if i % 10 == 0:
            rows.append((2 * i + 1, edited(text, 1, r)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in jaccard.one_of_each(docs).collect()) == survivors(rows)


def test_candidates_are_close(spark):
    """Texts of one template, all just below the similarity, are no candidates; marks never rule out a pair that reaches it."""
    r = random.Random(13)
    template = prose(71, 200)
    texts = [f"{template} {' '.join(f'own{i}x{j}' for j in range(36))}" for i in range(40)] + [edited(template, 2, r) for _ in range(10)]
    sets = [plain(t) for t in texts]
    near = {(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])}
    assert not any(a < 40 for a, b in near) and near
    arrays = jaccard._arrays(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5)
    at = arrays.select(F.lit(1).alias("key"), "node", F.col("node").alias("root"), "size", F.lit(1).alias("rank"))
    got = {(x.a, x.b) for x in jaccard.candidates(at, arrays, 0.8).collect()}
    assert near <= got and not any(a < 40 for a, b in got)


def test_columns_of_any_name(spark):
    base = prose(61, 80)
    rows = [(1, base, 5, 6, "x"), (2, base + " more", 7, 8, "y"), (3, prose(62, 80), 9, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, _version int, row string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_neighbours_are_no_more_than_rows(spark):
    """One key with three thousand nodes of two thousand roots, half of them twice as large: a partner each at most, of another root and a like size."""
    rows = [(7, i, i % 2000, 100 + 100 * (i % 2)) for i in range(3000)] + [(8, i, i, 100) for i in range(0, 10, 2)]
    held = {7: 3000, 8: 5}
    at = spark.createDataFrame([(*r, held[r[0]]) for r in rows], "key long, node long, root long, size int, held long")
    for turn in range(3):
        got = [tuple(r) for r in jaccard.neighbours(at, 0.8, turn).collect()]
        assert 500 < len(got) < 3000 and all(a > b and (a - b) % 2 == 0 and a - b != 2000 for a, b in got)


def test_groups_are_put_together_by_neighbours(spark, monkeypatch):
    """Near copies of one text that are not all near each other: few pairs are left to compare, and the result is that of all pairs."""
    r = random.Random(17)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(f"x{r.randrange(10**6)}" if k in edits else w for k, w in enumerate(base)) for edits in ({r.randrange(300) for _ in range(r.randint(3, 6))} for _ in range(70))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, left, all_pairs = [], [], jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a: (left.append(all_pairs(*a).count()), all_pairs(*a))[1])
    for turns in (0, jaccard._TURNS):
        monkeypatch.setattr(jaccard, "_TURNS", turns)
        kept.append(sorted(x.doc_id for x in jaccard.near_duplicates(docs).where("stays").collect()))
    sets, root = [jaccard.shingles(t) for t in texts], list(range(70))
    for a in range(70):
        for b in range(a):
            if jaccard.similarity(sets[a], sets[b]) >= 0.8:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert kept[0] == kept[1] == sorted(set(root))
    assert left[0] > 20 and left[1] * 4 < left[0]
