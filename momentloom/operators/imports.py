"""The import of finished runs as one job: results and logs in, clips, events, job states and ledger entries out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.operators.product import reconcile, refunds_for
from momentloom.operators.stored import settle
from momentloom.sources.tables import (
    clip_rows, job_facts, judge_run_results, parse_agent_events, replace_events, rows_schema, split_run_results, upsert_clips,
)


def run_import(raw: DataFrame, lines: DataFrame, jobs: DataFrame, clips: DataFrame, events: DataFrame, ledger: DataFrame, opening: DataFrame) -> dict[str, DataFrame]:
    """New tables ``clips``, ``events``, ``jobs`` and the ledger requests decided: ``corrections`` and ``refunds``.

    ``raw``: ``job_id, raw``; ``lines``: ``job_id, value``; ``jobs``: ``seq, job_id, user_id``.  A good run replaces its
    clips and events and is done; its charge is corrected to the minutes processed, none counting as 0.  A bad one
    fails with its error and what it was charged comes back.  Results of unknown jobs change nothing.  Write ``jobs``
    last, so that no reader sees a finished job without its clips.
    """
    judged = judge_run_results(raw.join(jobs.select("job_id"), "job_id", "left_semi"), rows_schema(clips.columns))
    good_run = F.when(F.col("error").isNull(), F.col("run")).alias("run")
    judged = settle(judged.select("job_id", good_run, "error"), "runs")  # documents are read once, for good runs and bad ones
    ok, bad = split_run_results(judged)
    good = ok.select("job_id")
    facts = job_facts(ok)
    state = facts.select("job_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), "cost_cents", "duration_min").unionByName(
        bad, allowMissingColumns=True)
    usage = jobs.join(facts, "job_id").select(F.col("seq").alias("id"), "seq", "user_id", "job_id", F.coalesce("duration_min", F.lit(0.0)).alias("actual_min"))
    fresh = parse_agent_events(lines).join(good, "job_id", "left_semi")
    return {
        "clips": upsert_clips(clips, clip_rows(ok, clips.columns)),
        "events": replace_events(events, fresh.select(*events.columns), good),
        "jobs": jobs.join(state, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("processing"))),
        "corrections": reconcile(usage, ledger, opening),
        "refunds": refunds_for(bad.join(jobs, "job_id").select("job_id", "user_id"), ledger),
    }
