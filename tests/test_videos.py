"""Which videos the resumable main job takes; the clips themselves are made by operators that have tests of their own."""

import pytest
from make import table
from pyspark.sql import functions as F

from momentloom.operators import videos
from momentloom.operators.stored import scratch
from momentloom.schemas import Signals


@pytest.fixture
def made(monkeypatch):
    """Stands for the operators: one clip per word of each video that it is given; keeps the names of these."""
    seen = []

    def clip_videos(sig, rules, scorer, k, width):
        seen.append(sorted(r.video_id for r in sig.words.select("video_id").distinct().collect()))
        assert sig.media is not None and sig.peaks is None
        return sig.words.select("video_id", F.col("pos").alias("clip_index"), "t0", "t1", F.lit(None).cast("int").alias("payoff_word_i"), F.lit(30).alias("total"),
                                F.lit("borderline").alias("verdict"), F.lit("rule").alias("source"), F.lit(True).alias("passed"), F.lit(None).cast("string").alias("dropped_reason"))

    monkeypatch.setattr(videos, "clip_videos", clip_videos)
    return seen


def _signals(spark, names, silent=()):
    words = [(v, i, float(i), i + 0.5) for v in names if v not in silent for i in range(2)]
    return Signals(media=table(spark, [(v, 9.0, "en") for v in names], "video_id string, duration_s double, language string"),
                   words=table(spark, words, "video_id string, pos int, t0 double, t1 double"))


def _inputs(spark, rows):
    return table(spark, [(v, f"s3/{v}", f) for v, f in rows], "video_id string, source string, fingerprint string")


def _runs(df):
    return sorted((r.video_id, r.clip_index, r.run) for r in df.collect())


def test_resume(spark, made):
    folder = scratch(spark, "videos")
    names = ["a", "b", "quiet"]
    sig = _signals(spark, names, silent=("quiet",))
    first = _runs(videos.run_videos(_inputs(spark, [(v, "1") for v in names]), sig, folder))
    assert first == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1)] and made == [["a", "b"]]
    assert {(r.video_id, r.spoken) for r in videos.done(spark, folder).collect()} == {("a", True), ("b", True), ("quiet", False)}
    # Nothing changed: no word is read, not even one that would fail to be.
    broken = sig.words.withColumn("video_id", F.when(F.col("pos") >= 0, F.raise_error(F.lit("read"))).cast("string"))
    assert _runs(videos.run_videos(_inputs(spark, [(v, "1") for v in names]), Signals(media=sig.media, words=broken), folder)) == first and len(made) == 1
    # One changed and one is new; the other keeps its clips.
    third = _runs(videos.run_videos(_inputs(spark, [("a", "1"), ("b", "2"), ("new", "1")]), _signals(spark, ["a", "b", "new"]), folder))
    assert third == [("a", 0, 1), ("a", 1, 1), ("b", 0, 2), ("b", 1, 2), ("new", 0, 2), ("new", 1, 2)] and made[1] == ["b", "new"]
    # A run that died before its last table counts for nothing, and the next one takes its place.
    spark.read.parquet(f"{folder}/clips/run=2").write.parquet(f"{folder}/clips/run=3")
    assert _runs(videos.clips(spark, folder).where("run = 3")) == []
    last = _runs(videos.run_videos(_inputs(spark, [("a", "1")]), sig, folder, version=2))
    assert last == [("a", 0, 3), ("a", 1, 3)] and made[2] == ["a"]


@pytest.mark.parametrize("rows", [[], [("quiet", "1")]])
def test_nothing_to_cut(spark, made, rows):
    folder = scratch(spark, "videos")
    assert videos.run_videos(_inputs(spark, rows), _signals(spark, ["quiet"], silent=("quiet",)), folder).collect() == []
    assert videos.done(spark, folder).count() == len(rows) and made == []
