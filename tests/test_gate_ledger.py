"""Evidence gate and ledger on nulls, ties and shared references."""

import random

import pytest
from momentloom.operators import evidence as E
from momentloom.operators import product as J
from momentloom.operators.text import karaoke_timing
from momentloom.operators.timeline import met_in_one_cell, overlap_seconds
from momentloom.schemas import Signals
from momentloom.streaming import streams as K
from pyspark.sql import functions as F

CLAIM = "video_id string, kind string, t double, value_num double, value_str string, w0 double, w1 double"


def signals(spark, words=None):
    peaks = spark.createDataFrame([("v", 0, 10.0, 3.0), ("v", 1, 50.0, None)], "video_id string, pos bigint, t double, sigma double")
    events = spark.createDataFrame([("v", 0, "laughter", 20.0, 21.0, 0.9)], "video_id string, pos bigint, label string, t0 double, t1 double, conf double")
    spans = spark.createDataFrame([("v", k, i, a, b) for i, (k, a, b) in enumerate([("surge", 5.0, 6.0), ("silence", 30.0, 31.0), ("scene", 0.0, 40.0)])],
                                  "video_id string, kind string, pos bigint, t0 double, t1 double")
    return Signals(media=None, words=words, peaks=peaks, events=events, spans=spans)


def test_gate_rejects_by_default(spark):
    kinds = ["energy_peak", "laughter", "rate_surge", "silence", "scene_stable"]
    rows = [("v", k, None, 3.0, None, 0.0, 100.0) for k in kinds] + [("v", k, t, 3.0, None, None, 100.0) for k, t in zip(kinds, (10.0, 20.0, 5.5, 30.5, 7.0), strict=True)]
    rows += [("v", "energy_peak", 50.0, 3.0, None, 0.0, 100.0), ("v", "energy_peak", 10.0, None, None, 0.0, 100.0), ("v", None, 10.0, 3.0, None, 0.0, 100.0), ("v", "quote", None, None, "hello", 0.0, 100.0)]
    out = E.validate_claims(spark.createDataFrame(rows, CLAIM), signals(spark, spark.createDataFrame([("v", 0, "hello", 10.0, 10.5)], "video_id string, pos int, text string, t0 double, t1 double"))).collect()
    assert len(out) == len(rows) and not any(r.resolved for r in out) and all(r.reason for r in out)


def test_gate_resolves_and_keeps_identical_claims(spark):
    rows = [("v", "energy_peak", 10.2, 3.1, None, 0.0, 100.0)] * 2 + [("v", "scene_stable", 7.0, None, None, 0.0, 100.0), ("v", "laughter", 20.5, None, None, 0.0, 100.0)]
    out = E.validate_claims(spark.createDataFrame(rows, CLAIM), signals(spark)).collect()
    assert len(out) == 4 and all(r.resolved and r.reason is None for r in out)


@pytest.mark.parametrize("said", ["don't", 'say "x"', "it's \"x\"", "back\\slash"])
def test_quote_reason_shows_the_quote_as_text(spark, said):
    (r,) = E.validate_claims(spark.createDataFrame([("v", "quote", 5.0, None, said, 0.0, 100.0)], CLAIM), signals(spark)).collect()
    assert r.reason.startswith(f"quote {said!r} not found in transcript t=[4.0,")


def test_overlap_keeps_windows_with_nulls(spark):
    w = spark.createDataFrame([("v", 0.0, 10.0, None), ("v", 0.0, 10.0, 1.0)], "video_id string, t0 double, t1 double, conf double")
    s = spark.createDataFrame([("v", 2.0, 5.0), ("v", 8.0, 30.0)], "video_id string, s0 double, s1 double")
    assert [r.seconds for r in overlap_seconds(w, s).collect()] == [5.0, 5.0]


def test_caption_backslash(spark):
    line = spark.createDataFrame([("v", "c", 0, 0, "a\\b{c}", 0.0, 1.0)], "video_id string, cand_id string, line_no int, pos int, text string, t0 double, t1 double")
    (r,) = karaoke_timing(line).collect()
    assert r.text.endswith("a\\\\b(c)")


REQ = "id bigint, seq bigint, user_id string, kind string, minutes double, ref string"


def decided(df):
    return {r.id: (r.verdict, r.delta, r.balance_after) for r in df.collect()}


def test_ledger_orders_equal_and_large_seq(spark):
    rows = [(1, 7, "a", "grant", 5.0, "g"), (2, 7, "a", "debit", 5.0, "x"), (3, 2**53, "b", "grant", 3.0, "h"), (4, 2**53 + 1, "b", "debit", 2.0, "y")]
    out = J.apply_ledger(spark.createDataFrame(rows, REQ))
    assert {r.id: r.balance_before for r in out.collect()} == {1: 0, 2: 5, 3: 0, 4: 3}
    assert decided(out) == {1: ("accepted", 5, 5), 2: ("accepted", -5, 0), 3: ("accepted", 3, 3), 4: ("accepted", -2, 1)}


SHARED = [(1, 1, "a", "debit", 5.0, "x"), (2, 2, "b", "grant", 9.0, "g"), (3, 3, "a", "grant", 9.0, "g"), (4, 4, "b", "debit", 5.0, "x"), (5, 5, "b", "debit", 5.0, "x"), (6, 6, "a", "grant", 6.0, "k"),
          (7, 7, "a", "debit", 5.0, "x"), (8, 8, "b", "grant", 1.0, "k")]


def test_rejected_debit_leaves_nothing(spark):
    out = decided(J.apply_ledger(spark.createDataFrame(SHARED, REQ)))
    assert out == {1: ("rejected", 0, 0), 2: ("accepted", 9, 9), 4: ("accepted", -5, 4), 5: ("duplicate", 0, 4), 6: ("accepted", 6, 6), 7: ("accepted", -5, 1)}


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(0, len(SHARED), 3):
        spark.createDataFrame(SHARED[i : i + 3], REQ).coalesce(1).write.mode("append").parquet(src)
        import time

        time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.id: (r.verdict, r.delta, r.balance_after) for r in K.run_available(K.stream_ledger(stream), path=str(tmp_path / "out")).collect()}
    assert got == decided(J.apply_ledger(spark.createDataFrame(SHARED, REQ)))
    assert K.run_available(K.stream_ledger(stream), path=str(tmp_path / "out")).count() == len(got)  # resumed: nothing new


def test_first_agents_never_come_again(spark, tmp_path):
    import datetime

    src, ddl = str(tmp_path / "in"), "job_id string, agent string, created_at timestamp"
    for day in (1, 90):
        spark.createDataFrame([("j", "scout", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day))], ddl).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    assert K.run_available(K.stream_first_agents(stream)).count() == 1


@pytest.mark.parametrize("long", [False, True])
def test_quotes_of_any_length_meet_all_their_words(spark, long):
    """Quotes across cells and longer than a cell, against all words of the timeline; one word may be longer than a cell."""
    r = random.Random(5)
    words = [("v", i, r.choice("abcd"), t, t + r.choice([0.0, 0.3, 5.0])) for i, t in enumerate(sorted(round(r.uniform(0, 400), 1) for _ in range(300)))]
    words += [("v", 900, "x", 10.0, 300.0)] if long else []
    words += [("v", 901, "n", None, 3.0), ("w", 0, "a", 5.0, 5.5)]
    claims = [("v", "quote", float(r.choice([r.randint(0, 400), 63, 64, 65, 127.5])), None, " ".join(r.choice("abcdx") for _ in range(r.choice([1, 2, 3]))) + " " * r.choice([0, 0, 30, 300, 1200]), 0.0, 500.0) for _ in range(150)]
    claims += [("v", "quote", None, None, "a", 0.0, 500.0), ("v", "quote", 5.0, None, None, 0.0, 500.0)]

    def resolves(c):
        if c[2] is None or c[4] is None:
            return False
        hay = " ".join(w[2] for w in words if w[0] == c[0] and w[3] is not None and w[3] < c[2] + len(c[4]) / 4 and w[4] > c[2] - 1)
        return c[4].strip() in hay

    table = spark.createDataFrame(words, "video_id string, pos int, text string, t0 double, t1 double")
    out = E.validate_claims(spark.createDataFrame(claims, CLAIM), signals(spark, table)).collect()
    key = lambda c: (c[0], c[1], c[2] or -1.0, c[4] or "")
    want = sorted((*key(c), resolves(c)) for c in claims)
    assert sorted((*key((x.video_id, x.kind, x.t, None, x.value_str)), x.resolved) for x in out) == want
    assert 20 < sum(w[-1] for w in want) < 140


def test_partners_in_one_cell_are_grouped_without_a_shuffle(spark):
    words = spark.createDataFrame([("v", float(i), i + 0.5) for i in range(300)], "video_id string, s0 double, s1 double").hint("merge")
    claims = spark.createDataFrame([("v", float(i), i + 3.0) for i in range(0, 300, 7)] + [("v", None, 3.0)], "video_id string, q0 double, q1 double")
    met = met_in_one_cell(claims, words, "q0", "q1", "s0", "s1", (F.col("s0") < F.col("q1")) & (F.col("s1") > F.col("q0")))
    got = met.groupBy("video_id", "q0", "q1", "_at", "_b").agg(F.count("s0").alias("n"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted((x.q0 is None, x.q0, x.n) for x in got.collect()) == [(False, float(i), min(3, 300 - i)) for i in range(0, 300, 7)] + [(True, None, 0)]
