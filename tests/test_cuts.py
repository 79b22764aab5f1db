import random

import numpy as np
import pytest
from make import candidates, signals, table

from pyspark.sql import functions as F

from momentloom.operators import cuts as G
from momentloom.operators import qa as H


def cut(spark, t0, t1):
    return table(spark, [("v", "c0", float(t0), float(t1))], "video_id string, cand_id string, t0 double, t1 double")


def opened(spark, t, **sig):
    return G.snap_open(cut(spark, t, t + 1), signals(spark, **sig)).first().open


def test_snap_open(spark):
    assert opened(spark, 12, words=[("a", 3, 3.5)], silence=[(8, 9)]) == 9.0
    assert opened(spark, 12, words=[("a", 3, 3.5), ("b", 7, 7.5)], silence=[(1, 1.4)]) == 7.0
    assert opened(spark, 19.9, words=[("a", 18.3, 18.5)], silence=[(17.4, 18.4)]) == 18.3
    assert opened(spark, 12, words=[("a", 3, 3.5)], silence=[(8, 8.2)]) == 3.0
    assert opened(spark, 7.7, words=[("Earlier.", 5, 5.6), ("So", 7, 7.3), ("it", 7.4, 7.9)]) == 7.0
    assert opened(spark, 5) == 5.0


def test_strip_fillers(spark):
    words = [("um", 5.0, 5.2), ("uh", 5.3, 5.5), ("hello", 5.6, 6.0)]
    sig = signals(spark, words=words, filler=[(5.0, 5.2), (5.3, 5.5)])
    rows = table(spark, [("v", "c0", 5.0), ("v", "c1", 5.6), ("v", "c2", 3.5), ("v", "c3", 20.0)], "video_id string, cand_id string, open double")
    assert {r.cand_id: r.open for r in G.strip_fillers(rows, sig).collect()} == {"c0": 5.6, "c1": 5.6, "c2": 5.6, "c3": 20.0}
    only = signals(spark, words=words[:2], filler=[(5.0, 5.2), (5.3, 5.5)])
    assert G.strip_fillers(rows.where("cand_id = 'c0'"), only).first().open == 5.5


@pytest.mark.parametrize("words,t1,want", [
    ([("hi", 10, 10.5), ("bye", 20, 20.5)], 10.2, 11.3), ([("hi", 10, 10.5), ("bye", 10.7, 11)], 10.2, 10.7),
    ([("a", 10, 10.4), ("b", 10.4, 10.8), ("c", 30, 30.5)], 10.5, 11.6), ([("a", 1, 2)], 50.0, 50.0),
])
def test_snap_close(spark, words, t1, want):
    assert abs(G.snap_close(cut(spark, 0, t1), signals(spark, words=words)).first().close - want) < 1e-9


def test_payoff(spark):
    sig = signals(spark, words=[(c, i, i + 0.5) for i, c in enumerate("abcd")])
    c = candidates(spark, [(0, 40, [("energy_peak", 1.5, 1.0, None), ("energy_peak", 3.5, -3.0, None)]), (0, 40, [])])
    assert [r.payoff_word_i for r in G.payoff_word(c, sig).orderBy("pos").collect()] == [3, None]


def test_repair_word_clip(spark):
    a = G.repair_word_clip(cut(spark, 5, 40), signals(spark, 60, words=[("x", 4.5, 5.5)])).first()
    assert (a.t0, a.t1) == (4.5, 40.0)
    b = G.repair_word_clip(cut(spark, 5, 35), signals(spark, 60, words=[("x", 34.5, 35.5)])).first()
    assert b.t0 == 5.0 and abs(b.t1 - 36.3) < 1e-9


def test_repair_looks_at_the_words_twice(spark, monkeypatch):
    """Edges of both sides are asked for together, and pauses are looked through for words once."""
    stored, scans, settle, lookup = [], [], G.settle, G.lookup
    monkeypatch.setattr(G, "settle", lambda df, name="table": (stored.append(name), settle(df, name))[1])
    monkeypatch.setattr(G, "lookup", lambda *a, **k: (scans.append(a), lookup(*a, **k))[1])
    sig = signals(spark, 60, words=[("x", 4.5, 5.5), ("y", 34.5, 35.5)], silence=[(5.5, 34.5)])
    got = G.repair_word_clip(cut(spark, 5, 35), sig).first()
    assert got.t0 == 4.5 and abs(got.t1 - 36.3) < 1e-9
    assert stored.count("pauses") == 1 and stored.count("asked") == 2 and len(scans) == 4


def test_alignment_is_counted(spark):
    """The bar is met by counts: errors are gathered only where their p95 is shown, and both agree."""
    r = random.Random(3)
    words = [(f"w{i}", i * 0.5, i * 0.5 + 0.4) for i in range(600)]
    sig = signals(spark, 400, words=words, errs=[r.choice([10.0, 299.9, 300.0, 300.1, 900.0, float("nan")]) if r.random() < 0.08 else 20.0 for _ in words])
    cuts = table(spark, [("v", f"c{i}", float(i), float(i + r.randint(1, 40))) for i in range(200)], "video_id string, cand_id string, t0 double, t1 double")
    rows = H.cut_alignment(cuts, sig.words, sig.media).collect()
    assert len(rows) == 200 and {x.over for x in rows} == {True, False}
    assert all(x.over == (not x.p95_ms <= 300.0) for x in rows)
    codes = H.check_alignment(cuts, sig.words, sig.media).select("video_id", "cand_id", "code")
    assert "collect_list" not in codes._jdf.queryExecution().optimizedPlan().toString()
    assert codes.count() == sum(x.over for x in rows)


def test_align_repair(spark):
    words = [(f"w{i}", i, i + 0.9) for i in range(45)]
    fails = table(spark, [("v", "c0", "ALIGN")], "video_id string, cand_id string, code string")
    sig = signals(spark, 60, words=words, errs=[50.0] * 32 + [500.0] * 13)
    got = G.repair(cut(spark, 0, 45), fails, sig).first()
    assert got.t1 - got.t0 >= 30 and got.t1 < 45
    assert H.check_alignment(cut(spark, got.t0, got.t1), sig.words, sig.media).count() == 0
    bad = G.repair(cut(spark, 0, 45), fails, signals(spark, 60, words=words, errs=[500.0] * 45)).first()
    assert (bad.t0, bad.t1) == (0.0, 45.0)


def test_best_run_is_the_double_loop():
    r = random.Random(5)
    for k in range(600):
        n, p, long = r.randint(1, 70), r.choice([0.02, 0.05, 0.08, 0.4, 1.0]), r.choice([0, 1, 20])
        a = np.sort(np.array([r.randint(0, n) for _ in range(n)], float))
        b = a + np.array([r.uniform(0, long) if long else 0.375 for _ in range(n)])
        bad = np.array([int(r.random() < p) for _ in range(n)])
        best, span = None, 0.0
        for i in range(n):
            for j in range(i, n):
                if j - i + 1 - bad[i : j + 1].sum() > int(0.95 * (j - i)) and b[j] - a[i] > span:
                    best, span = (a[i], b[j]), b[j] - a[i]
        assert G.best_run(a, b, bad) == best


def test_best_run_of_a_long_cut(spark):
    """Twenty thousand words in one cut, every fifth over the bar, next to a cut without one that passes; both cuts of one timeline and another's."""
    n = 20_000
    words = spark.range(n).select(F.explode(F.array(F.lit("v"), F.lit("w"))).alias("video_id"), F.col("id").alias("pos"), (F.col("id") * 0.5).alias("t0"),
                                  (F.col("id") * 0.5 + 0.375).alias("t1"), F.when(F.col("id") % 5 == 0, 500.0).otherwise(10.0).alias("align_err_ms"))
    cuts = table(spark, [("v", "c0", 0.0, 1e6), ("v", "c1", 2.5, 2.8), ("w", "c0", 0.0, 30.0), ("w", None, 0.0, 30.0)], "video_id string, cand_id string, t0 double, t1 double")
    got = sorted((r.video_id, r.cand_id or "", r.run_t0, r.run_t1) for r in G.best_aligned_run(cuts, words).collect())
    assert got == [("v", "c0", 0.5, 4.875), ("w", "", 0.5, 4.875), ("w", "c0", 0.5, 4.875)]


def test_routes(spark):
    rows = [("v", c, r) for c, r in H.ROUTES.items()]
    out = {r.cand_id: r.route for r in H.repair_route(table(spark, rows, "video_id string, cand_id string, route_to string")).collect()}
    assert out == H.ROUTES
