"""Queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from momentloom.functions.expr import half_up
from momentloom.operators.stored import scratch
from momentloom.plans import derive as D
from momentloom.plans import q_product as P
from momentloom.plans.registry import query, with_
from momentloom.streaming import streams as K

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, d, name="events", ddl=EVENTS):
    return spark.readStream.schema(ddl).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _log(spark, d):
    e = _stream(spark, d)
    return e.select(F.col("user_id").cast("string").alias("job_id"), D.agent_of(F.col("event_type")).alias("agent"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("seq"))


@query(f"WITH s AS ({P._STAGED}) SELECT job_id, CASE r WHEN 4 THEN 'render' ELSE 'crew' END AS stage, CASE r WHEN 4 THEN 1.0 ELSE 0.7 END AS progress FROM s")
def stream_progress(spark, d):
    out = K.run_available(K.stream_progress(P.daily(_log(spark, d))), "update")
    return out.groupBy("job_id").agg(F.max_by("stage", "batch").alias("stage"), F.max_by("progress", "batch").alias("progress"))


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'click' THEN 'scout' WHEN 'view' THEN 'critic' WHEN 'purchase' THEN 'surgeon'
    WHEN 'signup' THEN 'qa' ELSE 'orchestrator' END AS agent FROM events""")
def stream_first_agents(spark, d):
    return K.run_available(K.stream_first_agents(_log(spark, d))).drop("batch")


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'click' THEN 'scout' WHEN 'view' THEN 'critic' WHEN 'purchase' THEN 'surgeon'
    WHEN 'signup' THEN 'qa' ELSE 'orchestrator' END AS agent, event_type AS action, event_id AS n FROM events""")
def stream_log_tail(spark, d):
    """A log per user; the stream runs when three fifths of its bytes are there, which ends within a line, and again when all are."""
    base = scratch(spark, "logs")
    e = D.read(spark, d, "events").where(F.col("user_id").isNotNull())
    line = F.to_json(F.struct(D.agent_of(F.col("event_type")).alias("agent"), F.col("event_type").alias("action"), F.struct(F.col("event_id").alias("n")).alias("payload")))
    log = e.select(F.col("user_id").cast("string").alias("job_id"), "event_id", line.alias("line"))

    def written(share):
        def put(job, rows):
            text = "".join(x + "\n" for x in rows.sort_values("event_id")["line"]).encode()
            os.makedirs(f"{base}/{job[0]}", exist_ok=True)
            with open(f"{base}/{job[0]}/agent_events.jsonl", "wb") as f:
                f.write(text[: int(len(text) * share)])
            return rows[["job_id"]].head(1)

        return log.groupBy("job_id").applyInPandas(put, "job_id string")

    out = None
    for share in (0.6, 1.0):
        written(share).write.format("noop").mode("overwrite").save()
        out = K.run_available(K.tail_agent_events(spark, base), path=f"{base}-run")
    return out.select("job_id", "agent", "action", F.get_json_object("payload", "$.n").cast("bigint").alias("n"))


@query("""SELECT CAST(user_id AS VARCHAR) AS video_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_rates(spark, d):
    e = _stream(spark, d).select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = K.run_available(K.stream_rates(e, "1 hour", "1 hour"), "update")
    return out.groupBy("video_id", "start").agg(F.max("n").alias("n"))


@query("""SELECT CAST(user_id AS VARCHAR) AS video_id, s AS start, count(*) AS n, round(sqrt(avg(value * value)), 6) AS v
    FROM (SELECT user_id, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def stream_activity_windows(spark, d):
    e = _stream(spark, d).select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))
    out = K.run_available(K.stream_activity_windows(e, "1 hour", "2 hours", "1 hour"), "update")
    last = out.groupBy("video_id", "start").agg(F.max_by(F.struct("n", "v"), "batch").alias("x"))
    return last.select("video_id", "start", "x.n", F.round("x.v", 6).alias("v"))


@query(with_(**P.SQL).rstrip() + "," + P._BILL)
def stream_billing(spark, d):
    """Events come in two files; the stream is stopped after the first and resumed with the second. Stored payments are known from the start."""
    base = scratch(spark, "billing")
    e = D.read(spark, d, "events")
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    for second in (False, True):
        e.where((F.col("event_id") > half) == F.lit(second)).write.mode("append").parquet(f"{base}/in")
        events = P.billing_events(spark.readStream.schema(EVENTS).parquet(f"{base}/in"))
        stream = K.stream_billing(events, D.users(spark, d), P.payments(spark, d))
        K.run_available(stream, sink=K.billing_sink(f"{base}/payments", f"{base}/ledger"), path=f"{base}/run")
    paid = spark.read.schema("user_id string, event_id string, amount_cents int").parquet(f"{base}/payments")
    credit = spark.read.schema("delta_minutes double, reason string, ref string").parquet(f"{base}/ledger")
    return paid.join(credit.withColumnRenamed("ref", "event_id"), "event_id").select("user_id", "event_id", "amount_cents", "delta_minutes", "reason")


@query("""WITH e AS (SELECT user_id AS job, arg_max(event_type, ts) AS last_type, max(ts) AS last FROM events GROUP BY 1)
    SELECT CAST(job AS VARCHAR) AS job_id, 'o' || job AS user_id, 'failed' AS status, 'timed out' AS error FROM e
    WHERE last_type IN ('click', 'view') AND epoch_ms(last) + 1800000 < (SELECT epoch_ms(max(ts)) - 60000 FROM events)""")
def stream_stale_jobs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "click", "queued").when(kind == "view", "processing").otherwise("done")
    e = _stream(spark, d).select(F.col("user_id").cast("string").alias("job_id"), F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("user_id"), status.alias("status"),
                                 F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"))
    return K.run_available(K.stream_stale_jobs(e)).drop("batch")


_STALE = """SELECT job, 'o' || job AS user_id FROM (SELECT user_id AS job, arg_max(event_type, ts) AS last_type, max(ts) AS last FROM events GROUP BY 1)
    WHERE last_type IN ('click', 'view') AND epoch_ms(last) + 1800000 < (SELECT epoch_ms(max(ts)) - 60000 FROM events)"""


@query(f"""SELECT CAST(job AS VARCHAR) AS ref, user_id, 'job_refund' AS reason, CAST(job % 20 AS DOUBLE) AS delta_minutes FROM ({_STALE}) WHERE job % 20 > 0 AND job % 8 <> 1""")
def stream_stale_refunds(spark, d):
    """Refunds of jobs found stale: every job was charged its number modulo 20, one in eight is refunded already."""
    job = F.col("user_id")
    jobs = D.read(spark, d, "events").select("user_id").distinct()
    row = lambda df, minutes, reason: df.select(
        F.concat(F.lit("o"), job.cast("string")).alias("user_id"), minutes.cast("double").alias("delta_minutes"), F.lit(reason).alias("reason"),
        job.cast("string").alias("ref"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    entries = row(jobs, -(job % 20), "job_debit").unionByName(row(jobs.where(job % 8 == 1), job % 20, "job_refund"))
    kind = F.col("event_type")
    status = F.when(kind == "click", "queued").when(kind == "view", "processing").otherwise("done")
    e = _stream(spark, d).select(job.cast("string").alias("job_id"), F.concat(F.lit("o"), job.cast("string")).alias("user_id"), status.alias("status"),
                                 F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"))
    base = scratch(spark, "sweep")
    K.run_available(K.stream_stale_jobs(e), sink=K.sweep_sink(lambda: entries, f"{base}/swept", f"{base}/refunds"))
    return spark.read.schema("user_id string, delta_minutes double, reason string, ref string").parquet(f"{base}/refunds").select("ref", "user_id", "reason", "delta_minutes")


@query("""WITH e AS (SELECT *, event_id % 5 = 0 AS second FROM events), w AS (SELECT max(epoch_ms(ts)) - 7 * 86400000 AS mark FROM e WHERE NOT second)
    SELECT count(*) AS arrived, count(*) - count(*) FILTER (second AND epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark) AS counted,
           count(*) FILTER (second AND epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark) AS late FROM e, w""")
def stream_late_rows(spark, d):
    """Every fifth event comes in a second file; those whose hour closed a week before the newest event are late, and counted."""
    base = scratch(spark, "arrivals")
    e = D.read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    out, path = None, f"{base}/out"
    for second in (False, True):
        e.where((F.col("event_id") % 5 == 0) == F.lit(second)).drop("event_id").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("video_id string, ts timestamp").parquet(f"{base}/in")
        out = K.run_available(K.stream_rates(stream, "1 hour", "7 days"), "update", path=path)
    last = out.groupBy("video_id", "start").agg(F.max("n").alias("n"))
    return K.late_rows(spark.read.parquet(f"{base}/in"), last)


@query("WITH RECURSIVE " + P._WALK)
def stream_ledger(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "signup", "signup_grant").when(kind == "purchase", "purchase").when(kind == "click", "debit").otherwise("refund")
    minutes = F.when(kind == "signup", 60.0).when(kind == "purchase", F.col("value") / 4).otherwise(F.col("value"))
    req = _stream(spark, d).where(kind != "view").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_id"), name.alias("kind"), half_up(minutes).cast("bigint").alias("minutes"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("ref"))
    return K.run_available(K.stream_ledger(req)).drop("batch")
