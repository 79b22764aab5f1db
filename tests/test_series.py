import math
import random

import numpy as np
from make import signals, table
from pyspark.sql import functions as F

from momentloom.operators import folds, series
from momentloom.schemas import FACES


def spans_of(df):
    return sorted((round(r.t0, 6), round(r.t1, 6)) for r in df.collect())


def test_rms_and_chunks(spark):
    xs = [math.sin(i) for i in range(23)]
    s = table(spark, [("v", i, x) for i, x in enumerate(xs)], "video_id string, n bigint, x double")
    got = {r.i: r.v for r in series.rms_curve(s, 5).collect()}
    padded = [0.0] * 5 + xs + [0.0] * 5
    assert set(got) == set(range(1 + 23 // 5))
    for i, v in got.items():
        assert abs(v - math.sqrt(sum(x * x for x in padded[i * 5:i * 5 + 10]) / 10)) < 1e-12
    m = table(spark, [("a", 90.0), ("b", 1805.0)], "video_id string, duration_s double")
    out = series.overlapping_chunks(m).collect()
    assert [(r.t0, r.t1) for r in out if r.video_id == "a"] == [(0.0, 90.0)]
    b = sorted((r.t0, r.t1) for r in out if r.video_id == "b")
    assert len(b) == 4 and b[0] == (0.0, 600.0) and b[-1][1] == 1805.0


def test_rolling_zscore_over_block_borders(spark):
    rnd = random.Random(1)
    vals = np.array([rnd.random() for _ in range(300)])
    c = table(spark, [("v", i, float(x)) for i, x in enumerate(vals)], "video_id string, i bigint, v double")
    got = {r.i: r.z for r in series.rolling_zscore(c, 21, block=50).collect()}
    for i in range(300):
        w = vals[max(0, i - 10):i + 11]
        assert abs(got[i] - (vals[i] - w.mean()) / w.std()) < 1e-9


def test_fillers(spark):
    words = [("So", 0.1, 0.3), ("um", 0.3, 0.5), ("I", 0.5, 0.7), ("like,", 0.7, 0.9), ("think", 0.9, 1.4), ("you", 1.4, 1.55), ("know", 1.55, 1.7), ("uh", 1.8, 1.9), ("yeah", 1.9, 2.2)]
    assert spans_of(series.filler_spans(signals(spark, words=words).words)) == [(0.3, 0.5), (0.7, 0.9), (1.4, 1.7), (1.8, 1.9)]


def test_runs_and_complement(spark):
    c = table(spark, [("v", i, float(x)) for i, x in enumerate([0, 5, 5, 5, 0, 5, 5, 0, 5])], "video_id string, i bigint, v double")
    assert spans_of(series.runs_where(c, F.col("v") > 1, 1.0, 2.0)) == [(1.0, 4.0), (5.0, 7.0)]
    sig = signals(spark, 10, speech=[(1, 3), (2, 2.5), (3, 4), (6, 7)])
    assert spans_of(series.interval_complement(sig.kind("speech"), sig.media)) == [(0.0, 1.0), (4.0, 6.0), (7.0, 10.0)]
    assert spans_of(series.interval_complement(signals(spark, 10).kind("speech"), sig.media)) == [(0.0, 10.0)]


def test_span_batches_brute_force(spark):
    rnd = random.Random(2)
    t, words = 0.0, []
    for i in range(300):
        t += rnd.choice([0.5, 1.0, 3.0, 70.0] if i % 40 == 0 else [0.5, 1.0, 3.0])
        words.append((f"w{i}", t, t + 0.4))
    got = sorted((r.first_pos, r.n_words) for r in series.span_batches(signals(spark, 1e6, words=words).words).collect())
    want, i = [], 0
    while i < len(words):
        j = i + 1
        while j < len(words) and words[j][2] - words[i][1] <= 60.0:
            j += 1
        want.append((i, j - i))
        i = j
    assert got == want


def test_dominant_box():
    box = lambda x, y, w, h, c: {"x": x, "y": y, "w": w, "h": h, "conf": c}
    prev = box(0.1, 0.1, 0.2, 0.2, 0.9)
    big = box(0.6, 0.6, 0.4, 0.4, 0.9)
    assert folds.choose_box([box(0.1, 0.1, 0.2, 0.2, 0.9), big], prev, 0.5, 0.3) == 0
    assert folds.choose_box([box(0.1, 0.1, 0.2, 0.2, 0.3)], prev, 0.5, 0.3) is None
    assert folds.choose_box([box(0.5, 0.1, 0.1, 0.1, 0.9), big], prev, 0.5, 0.3) == 1
    assert folds.choose_box([box(0.14, 0.1, 0.2, 0.2, 0.9), box(0.11, 0.1, 0.2, 0.2, 0.9)], prev, 0.5, 0.3) == 1


def test_dominant_track_resets(spark):
    a, b = (0.1, 0.1, 0.2, 0.2, 0.9), (0.5, 0.5, 0.4, 0.4, 0.9)
    rows = [("v", 0.0, [a], None), ("v", 1.0, [b, a], None), ("v", 2.0, [], None), ("v", 3.0, [b, a], None)]
    got = {r.t: r.dominant for r in series.dominant_track(spark.createDataFrame(rows, FACES)).collect()}
    assert got == {0.0: 0, 1.0: 1, 2.0: None, 3.0: 0}


def test_one_deviation_from_the_mean_is_not_beyond_it(spark):
    """Buckets exactly one deviation below the mean, whose last digits depend on the order of the others, and a constant curve."""
    rnd = random.Random(5)
    n, curves = 18, {}
    for j in range(60):
        values = [0.0] * 2 + [1.0] * 2 + [2.0] * 14
        rnd.shuffle(values)
        curves[f"t{j}"] = values
    s, q = sum(values), sum(x * x for x in values)
    assert (s - n) ** 2 == n * q - s * s  # one is the mean less the deviation
    rows = [(v, i, x) for v, xs in curves.items() for i, x in enumerate(xs)] + [("c", i, 0.1) for i in range(10)]
    c = table(spark, rows, "video_id string, i bigint, v double").coalesce(1)
    low = series.monotone(c, min_duration_s=0.0).collect()
    zeros = {(v, i) for v, xs in curves.items() for i, x in enumerate(xs) if x == 0}
    assert {(r.video_id, i) for r in low for i in range(int(r.t0), int(r.t1))} == zeros and all(r.peak == 0 for r in low)
    assert series.surges(c, min_duration_s=0.0).where("video_id = 'c'").count() == 0


def test_words_part_at_the_white_space_of_sql(spark, tmp_path):
    from momentloom.plans import derive

    rows = [(1, 0, "a\x0bb c\fd"), (1, 1, "\x0b")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r.pos, r.text) for r in derive.words(spark, str(tmp_path)).collect()) == [(0, "a\x0bb"), (1, "c"), (2, "d"), (3, "\x0b")]
