"""The main job over many videos, resumable: from measured signals to checked clips.

A folder holds what is done: ``clips`` and ``videos``, one part per run. A video counts as done once its row is in
``videos``, which is written last; so a run that dies leaves nothing that the next one takes for whole. A rerun takes
only videos whose source is new, or whose content fingerprint or version changed; signals of all others are left
out before any of them is read into an operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.operators import qa
from momentloom.operators.candidates import propose, rule_energy_rate, rule_event_leadup, rule_scene_variance
from momentloom.operators.cuts import refine
from momentloom.operators.scoring import best_effort, evidence_score, keepers_in_order, run_rounds, select_clips
from momentloom.operators.stored import settle
from momentloom.schemas import Signals
from momentloom.sources.tables import pending_work

DONE = "video_id string, source string, fingerprint string, version int, spoken boolean, run int"
CLIPS = (
    "video_id string, clip_index int, t0 double, t1 double, payoff_word_i int, total int, verdict string, source string, passed boolean, dropped_reason string, run int"
)


def _stored(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at ``path``, empty if nothing was written yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def done(spark: SparkSession, folder: str) -> DataFrame:
    """Of every video the last run that finished it."""
    rows = _stored(spark, f"{folder}/videos", DONE)
    names = [c for c in rows.columns if c != "video_id"]
    return rows.groupBy("video_id").agg(F.max_by(F.struct(*names), "run").alias("x")).select("video_id", "x.*")


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """Clips of the last run of every video; a video without words has none."""
    return _stored(spark, f"{folder}/clips", CLIPS).join(done(spark, folder).select("video_id", "run"), ["video_id", "run"], "left_semi")


def only(sig: Signals, videos: DataFrame) -> Signals:
    """The signals of some videos."""
    keep = videos.select("video_id")
    return Signals(**{f.name: None if getattr(sig, f.name) is None else getattr(sig, f.name).join(keep, "video_id", "left_semi") for f in fields(Signals)})


def clip_videos(sig: Signals, rules, scorer: Callable[[DataFrame], DataFrame], k: int, width: float) -> DataFrame:
    """Checked clips of all videos of ``sig``: proposed, scored, chosen, cut, repaired and checked again."""
    _, every = run_rounds(settle(propose(sig, rules), "windows"), scorer)
    every = settle(every, "every")
    chosen = keepers_in_order(every).unionByName(best_effort(every, sig))
    chosen = settle(select_clips(chosen, k), "chosen")
    cut = settle(refine(chosen, sig, width=width), "cuts")
    fixed, bad = qa.repair_pass(cut.select("video_id", "cand_id", "t0", "t1"), sig, width, settle=lambda df: settle(df, "repaired"))
    report = qa.qa_report(fixed, bad)
    told = chosen.select("video_id", "cand_id", F.col("clip_index").cast("int").alias("clip_index"), F.col("total").cast("int").alias("total"), "verdict", "source")
    ids = ["video_id", "cand_id"]
    return told.join(fixed.select(*ids, "t0", "t1"), ids).join(cut.select(*ids, "payoff_word_i"), ids).join(report.select(*ids, "passed", "dropped_reason"), ids)


def run_videos(inputs: DataFrame, sig: Signals, folder: str, version: int = 1, rules=(rule_energy_rate, rule_event_leadup, rule_scene_variance),
               scorer: Callable[[DataFrame], DataFrame] = evidence_score, k: int = 8, width: float = 64.0) -> DataFrame:
    """Bring ``folder`` up to ``inputs`` (``video_id``, ``source``, ``fingerprint``) and return the clips of these videos.

    A video without words is done without clips. Rows of ``inputs`` are distinct videos; null fingerprints are never done.
    """
    spark = inputs.sparkSession
    wanted = inputs.select("video_id", "source", F.col("fingerprint").cast("string").alias("fingerprint"))
    before = done(spark, folder)
    todo = settle(pending_work(wanted, before.select("source", "fingerprint", "version"), version), "todo")
    if not todo.isEmpty():
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        spoken = settle(sig.words.select("video_id").join(todo, "video_id", "left_semi").distinct(), "spoken")
        if not spoken.isEmpty():
            rows = clip_videos(only(sig, spoken), rules, scorer, k, width)
            columns = [c.split()[0] for c in CLIPS.split(", ")][:-1]
            rows.select(*columns).write.mode("overwrite").parquet(f"{folder}/clips/run={run}")
        marked = todo.join(spoken.withColumn("spoken", F.lit(True)), "video_id", "left")
        marked = marked.select("video_id", "source", "fingerprint", F.lit(version).alias("version"), F.coalesce("spoken", F.lit(False)).alias("spoken"))
        marked.write.mode("overwrite").parquet(f"{folder}/videos/run={run}")
    return clips(spark, folder).join(wanted.select("video_id"), "video_id", "left_semi")
