"""Language identification: the network against plain loops and numeric slopes, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from llm.conftest import EDGES
from momentloom.llm import language
from momentloom.llm.language import Network, gradients, train, windows
from momentloom.llm.queries import QUERIES
from pyspark.sql import functions as F


def plain_chances(net, row):
    """One window, filter by filter and byte by byte."""
    responses, wide = [], max(map(len, net.filters))
    padded = [*row.tolist(), *[256] * (wide - 1)]
    for f in net.filters:
        for k in range(f.shape[2]):
            seen = [sum(float(net.embed[padded[t + j]] @ f[j, :, k]) for j in range(len(f))) for t in range(len(row))]
            responses.append(max(seen))
    top = np.maximum(np.array(responses) + net.bias, 0)
    z = np.exp(top @ net.top[:-1] + net.top[-1])
    return z / z.sum()


def test_windows_hold_all_bytes():
    for t in ("", "a", "É" * 100, "x" * 96, "y" * 97):
        rows = windows(t)
        assert bytes(rows[rows != 256].astype(np.uint8)) == t.encode().lower() and rows.shape == (-(-len(t.encode()) // 96), 96)


def test_chances_by_plain_loops():
    net = Network.new(["a", "b", "c"], seed=1)
    net.bias += 0.1
    rows = np.concatenate([windows("The net, été ß " * 9), windows("x")])
    for row, p in zip(rows, net.chances(rows), strict=True):
        assert p == pytest.approx(plain_chances(net, row), abs=1e-4) and p.sum() == pytest.approx(1, abs=1e-5)


def test_slopes_are_numeric_ones():
    net = Network.new(["a", "b", "c"], seed=2)
    for name in ("embed", "bias", "top"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += 0.05  # away from the corner of filters that only see padding
    net.filters = [f.astype(np.float64) for f in net.filters]
    rows = np.concatenate([windows("der die das " * 10), windows("le la les " * 10), windows("one")])
    y, weight = np.arange(len(rows)) % 3, np.linspace(0.5, 1, len(rows))
    _, g = gradients(net, rows, y, weight)
    r = np.random.default_rng(1)
    for p, d in [(net.embed, g["embed"]), (net.bias, g["bias"]), (net.top, g["top"]), *zip(net.filters, g["filters"], strict=True)]:
        live = np.argwhere(d != 0)
        for at in map(tuple, live[r.permutation(len(live))[:12]]):
            old, e = p[at], 1e-6
            p[at] = old + e
            up = gradients(net, rows, y, weight)[0]
            p[at] = old - e
            down = gradients(net, rows, y, weight)[0]
            p[at] = old
            assert d[at] == pytest.approx((up - down) / (2 * e), abs=1e-4, rel=1e-3)


def test_text_is_the_mean_of_its_windows(monkeypatch):
    monkeypatch.setattr(language, "_BATCH", 3)
    net = Network.new(["a", "b"], seed=4)
    texts = ["abc " * 200, None, "q", "1 2 3", "éü " * 70, "", "zz " * 900]
    out, score = net.predict(texts)
    for t, name, s in zip(texts, out, score, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (name, s) == ("und", 0)
        else:
            mean = np.mean([plain_chances(net, row) for row in windows(t)], axis=0)
            assert name == net.languages[int(mean.argmax())] and s == pytest.approx(mean.max(), abs=1e-4)


def test_training_separates():
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcd " if k else "efgh "), 96)) for k in (0, 1) for _ in range(60)]
    rows, y = np.concatenate([windows(t) for t in texts]), np.repeat([0, 1], 60)
    net = train(Network.new(["x", "y"]), rows, y, rounds=3, batch=32)
    assert (net.chances(rows).argmax(1) == y).all()


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    df = QUERIES["op11_language"](spark, d)
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = df.collect()
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    told = [r for r in rows if r.held_out and lang[r.doc_id][0] is not None and any(c.isalpha() for c in lang[r.doc_id][1])]
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in told]) >= 0.97


def test_edges(spark, edges, no_docs):
    named = edges.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y")).withColumn("lang_pred", F.lit(7))
    rows = language.identified(named, language.fit(named, 4, 2)).collect()
    assert len(rows) == len(EDGES) and set(named.columns) == set(rows[0].asDict())
    for r in rows:
        assert (r.lang_pred == "und" and r.score == 0) if not any(c.isalpha() for c in r.text or "") else r.lang_pred in ("x", "y") and 0 < r.score <= 1
    for none in (named.withColumn("lang", F.lit(None).cast("string")), named.limit(0)):
        assert {r.lang_pred for r in language.identified(named, language.fit(none, 4, 2)).collect()} == {"und"}
    empty = no_docs.withColumn("lang", F.lit("x"))
    assert language.identified(empty, language.fit(empty, 4, 2)).collect() == []


def test_only_rows_that_are_not_held_out_teach(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.expr("crc32(cast(cast(id as string) as binary)) % 4 = 2"), "secret").otherwise("told").alias("lang"))
    assert language.fit(docs, 4, 2).languages == ["told"]
