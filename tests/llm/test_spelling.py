"""Spelling variants: the index against its definition, near words and the query against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import EDGES
from momentloom.llm import spelling
from momentloom.llm.fm_index import CLOSE, BiIndex, joined, suffix_ranks
from momentloom.llm.queries import QUERIES
from pyspark.sql import functions as F


def edited(w, letters):
    """All words at exactly one edit."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in letters}
    return out - {w}


def near(words):
    letters = sorted(set("".join(words)))
    return {(w, v) for w in words for v in edited(w, letters) & set(words)}


def plain(rows, slip=199, letters=6, least=5, times=5):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    by = defaultdict(list)
    for w, v in near(counts):
        by[w].append(v)
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-counts[v], v))
        if counts[best] >= times * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(by[w]), counts.get(form.get(w))) for w, n in counts.items())


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def words_of(seed, n, letters="abÿ", most=7):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(2, most))) for _ in range(n)})


def test_suffix_ranks():
    text, _ = joined(words_of(1, 40))
    whole = bytes(text)
    order = suffix_ranks(text, CLOSE).tolist()
    assert order == sorted(range(len(whole)), key=lambda i: (whole[i : whole.index(CLOSE, i) + 1], i))


@pytest.mark.parametrize("seed", range(8))
def test_both_intervals_count_occurrences(seed):
    words = words_of(seed, 30)
    index, r = BiIndex(words), random.Random(seed)
    text = bytes(index.text)
    from momentloom.llm.fm_index import States

    one = lambda x: np.array([x])
    for _ in range(30):
        s, pattern = States(one(0), one(0), one(False), one(0), one(0), one(index.n)), b""
        for _ in range(r.randint(1, 5)):
            c, right = r.choice(text.replace(b"\1", b"").replace(b"\2", b"")), r.random() < 0.5
            pattern = pattern + bytes([c]) if right else bytes([c]) + pattern
            s = index.extend(s, one(c), right)
            n = sum(text.startswith(pattern, i) for i in range(len(text)))
            assert (int(s.size[0]) if len(s.size) else 0) == n
            if not n:
                break


@pytest.mark.parametrize("first", [True, False])
def test_search_extends_across_either_half(first):
    for seed in range(10):
        words = words_of(seed, 70)
        half = {w: len(w) // 2 for w in words}
        cut = np.array([half[w] if first else len(w) - half[w] for w in words])
        q, f = BiIndex(words).near(words, cut, np.full(len(words), first))
        share = lambda a, b: a[: half[a]] == b[: half[a]] if first else a[len(a) - half[a] :] == b[max(0, len(b) - half[a]) :]
        found = {(words[a], words[b]) for a, b in zip(q, f, strict=True)}
        assert len(found) == len(q) and found <= near(words)
        assert {(a, b) for a, b in near(words) if share(a, b) and len(b) >= len(a)} <= found


@pytest.mark.parametrize(("block", "most"), [(20_000, 20_000), (40, 20_000), (60, 7)])
def test_near_words(spark, block, most):
    words = words_of(5, 400, "abcé", 9)
    rows = spark.createDataFrame([(w, 1 + k) for k, w in enumerate(words)], "word string, n long")
    found = spelling.near_words(rows, block, most).collect()
    n = {w: 1 + k for k, w in enumerate(words)}
    assert len(found) == len(near(words)) and {(r.word, r.near) for r in found} == near(words) and all(r.near_n == n[r.near] for r in found)


def test_a_half_of_most_words_is_cut_into_blocks(spark):
    words = ["abc" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(900)] + words_of(2, 200, "xyz", 8)
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = {(r.word, r.near) for r in spelling.near_words(rows, 200, 100).collect()}
    assert found == near(words)


def test_edges(spark, edges, no_docs):
    assert got(spelling.variants(edges, slip=3, letters=2, least=2, times=2)) == plain(EDGES, 3, 2, 2, 2)
    assert spelling.variants(no_docs).collect() == []
    assert spelling.variants(edges.where("text is null")).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = [("variant", 5), ("varianta", 30), ("variantan", 160), ("variantang", 900)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    found = got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), slip=10**12))
    assert [x[2] for x in found] == ["variantang"] * 4 and found == plain(rows, 10**12)
    tied = [(0, "planet " * 5 + "planets " * 25 + "plaiet " * 2 + "planett " * 25)]
    assert ("planet", "planets") in [x[:2] for x in got(spelling.variants(spark.createDataFrame(tied, "doc_id long, text string"), slip=10**12))]


def test_query_is_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op13_spelling"](spark, d)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(df) == plain(rows)


def test_long_words(spark):
    rows = [(i, "a" * 5000 + "b" * (i % 2) + " " + "xyzxyz" * 300) for i in range(10)]
    found = got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")), slip=10**12))
    assert [x[4] for x in found] == [1, 1, 0]
