"""Queries over cost, overview, status, ledger and billing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from momentloom.operators import product as J
from momentloom.plans import derive as D
from momentloom.plans.registry import LINES, query, with_

NOW = datetime(1998, 8, 2, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '1998-08-02 00:00:00'"

SQL = dict(
    usr="""SELECT CAST(c_custkey AS VARCHAR) AS id, 'u' || c_custkey || '@example.com' AS email, CAST(floor(c_acctbal / 100) AS INT) AS minutes_balance,
           make_timestamp((1704067200 + c_custkey % 1000 * 3600) * 1000000) AS created_at FROM customer""",
    jobs="""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'processing' END END AS status, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error,
            CAST(floor(o_totalprice / 1000) AS INT) AS cost_cents, o_orderdate AS created_at, o_orderdate + to_minutes(CAST(o_orderkey % 120 AS INT)) AS updated_at FROM orders""",
    led="""SELECT CAST(o_custkey AS VARCHAR) AS user_id, -floor(o_totalprice / 20000) AS delta_minutes, 'job_debit' AS reason, CAST(o_orderkey AS VARCHAR) AS ref FROM orders WHERE o_orderkey % 5 <> 0
           UNION ALL SELECT CAST(o_custkey AS VARCHAR), floor(o_totalprice / 20000), 'job_refund', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 8 = 1
           UNION ALL SELECT CAST(c_custkey AS VARCHAR), 60.0, 'signup_grant', CAST(c_custkey AS VARCHAR) FROM customer""",
    pay="SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'e' || c_custkey AS event_id, CAST(1000 + c_custkey % 50 AS INT) AS amount_cents FROM customer WHERE c_custkey % 4 = 0",
)


def ledger(spark, d):
    o = D.read(spark, d, "orders")
    k, m = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 20000).cast("double")
    row = lambda df, user, delta, reason, ref: df.select(
        user.cast("string").alias("user_id"), delta.alias("delta_minutes"), F.lit(reason).alias("reason"), ref.cast("string").alias("ref"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    debit = row(o.where(k % 5 != 0), F.col("o_custkey"), -m, "job_debit", k)
    back = row(o.where(k % 8 == 1), F.col("o_custkey"), m, "job_refund", k)
    c = D.read(spark, d, "customer")
    return debit.unionByName(back).unionByName(row(c, F.col("c_custkey"), F.lit(60.0), "signup_grant", F.col("c_custkey")))


def payments(spark, d):
    k = F.col("c_custkey")
    return D.read(spark, d, "customer").where(k % 4 == 0).select(
        k.cast("string").alias("user_id"), F.concat(F.lit("e"), k.cast("string")).alias("event_id"), (1000 + k % 50).cast("int").alias("amount_cents"))


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'scout' WHEN 'view' THEN 'critic' WHEN 'purchase' THEN 'surgeon' WHEN 'signup' THEN 'qa' ELSE 'orchestrator' END AS agent,
        CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS cheap FROM events)
    SELECT agent, sum(k)::BIGINT AS tokens_in, sum(k * 2)::BIGINT AS tokens_out, round(sum(CASE WHEN cheap THEN k * 1e-4 + 2 * k * 5e-4 ELSE k * 3e-4 + 2 * k * 1.5e-3 END), 6) AS cost_cents FROM e GROUP BY 1""")
def agent_totals(spark, d):
    return J.agent_totals(D.agent_events(spark, d)).withColumn("cost_cents", F.round("cost_cents", 6))


@query(with_(**SQL) + f"""SELECT (SELECT count(*) FROM usr) AS total_users, (SELECT count(*) FROM usr WHERE created_at >= {NOW_SQL} - INTERVAL 7 DAY) AS signups_7d,
    (SELECT sum(minutes_balance)::BIGINT FROM usr) AS outstanding_minutes, j.*, (SELECT count(*) FROM lineitem) AS total_clips,
    (SELECT sum(delta_minutes)::DOUBLE FROM led WHERE delta_minutes > 0) AS minutes_granted, (SELECT -sum(delta_minutes)::DOUBLE FROM led WHERE delta_minutes < 0) AS minutes_spent,
    (SELECT sum(amount_cents)::BIGINT FROM pay) AS revenue_cents, (SELECT count(DISTINCT user_id) FROM pay) AS paying_users
    FROM (SELECT count(*) AS total_jobs, count(*) FILTER (status = 'queued') AS jobs_queued, count(*) FILTER (status = 'processing') AS jobs_processing, count(*) FILTER (status = 'done') AS jobs_done,
          count(*) FILTER (status = 'failed') AS jobs_failed, sum(cost_cents)::BIGINT AS total_cost_cents, coalesce(sum(cost_cents) FILTER (created_at >= {NOW_SQL} - INTERVAL 7 DAY), 0)::BIGINT AS cost_cents_7d FROM jobs) j""")
def overview(spark, d):
    return J.overview(D.users(spark, d), D.jobs(spark, d), D.clips(spark, d), ledger(spark, d), payments(spark, d), NOW)


@query(with_(**SQL) + "SELECT s AS status, count(j.status) AS n_jobs FROM (SELECT unnest(['queued', 'processing', 'done', 'failed']) AS s) x LEFT JOIN jobs j ON j.status = x.s GROUP BY 1")
def jobs_by_status(spark, d):
    return J.jobs_by_status(D.jobs(spark, d))


_JOINED = "SELECT j.id, u.email, j.status, j.error, j.created_at FROM jobs j JOIN usr u ON u.id = j.user_id"


@query(with_(**SQL) + f"{_JOINED} ORDER BY j.created_at DESC, j.id DESC LIMIT 25")
def recent_jobs(spark, d):
    return J.recent_jobs(D.jobs(spark, d), D.users(spark, d))


@query(with_(**SQL) + f"{_JOINED} WHERE j.status = 'failed' ORDER BY j.created_at DESC, j.id DESC LIMIT 25")
def recent_failures(spark, d):
    return J.recent_failures(D.jobs(spark, d), D.users(spark, d))


@query(with_(**SQL) + "SELECT id, email, created_at FROM usr ORDER BY created_at DESC, id DESC LIMIT 25")
def recent_signups(spark, d):
    return J.recent_signups(D.users(spark, d))


@query(with_(**SQL) + "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs QUALIFY rn <= 5")
def jobs_per_user(spark, d):
    return J.jobs_per_user(D.jobs(spark, d), 5).select("user_id", "id", "rn")


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber AS i, l_returnflag AS f FROM {LINES}),
    a AS (SELECT l_orderkey, string_agg(i || CASE WHEN f = 'R' THEN ':-' ELSE ':u/' || l_orderkey || '/clip_' || i || '.mp4' END, ',' ORDER BY i) AS clips FROM c GROUP BY 1),
    e AS (SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS events FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS job_id, a.clips, e.events FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN e ON e.user_id = o_orderkey""")
def job_status(spark, d):
    out = J.job_status(D.jobs(spark, d), D.clips(spark, d), D.agent_events(spark, d))
    clip = F.transform("clips", lambda c: F.concat(c.clip_index.cast("string"), F.lit(":"), F.coalesce(c.media_key, F.lit("-"))))
    return out.select("job_id", F.array_join(clip, ",").alias("clips"), F.array_join(F.transform("events", lambda e: e.seq.cast("string")), ",").alias("events"))


# One job per user and day, so that not every job gets to the last stage.
_STAGED = """SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id, max(CASE WHEN event_type IN ('purchase', 'signup') THEN 4 ELSE 3 END) AS r FROM events GROUP BY 1"""


def daily(log):
    return log.withColumn("job_id", F.concat_ws("-", "job_id", F.to_date("created_at").cast("string")))


@query(f"WITH s AS ({_STAGED}) SELECT job_id, CASE r WHEN 4 THEN 'render' ELSE 'crew' END AS stage, CASE r WHEN 4 THEN 1.0 ELSE 0.7 END AS progress FROM s")
def stage_progress(spark, d):
    return J.stage_progress(daily(D.agent_events(spark, d)))


_SAMPLES = "SELECT CAST(user_id AS VARCHAR) AS job_id, epoch_us(ts) // 1000000 AS s, max(value / 500) AS p FROM events GROUP BY 1, 2"


@query(f"""WITH s AS ({_SAMPLES}), r AS (SELECT *, max(p) OVER (PARTITION BY job_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s),
    k AS (SELECT * FROM r WHERE top IS NULL OR p > top QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY s DESC) <= 6),
    e AS (SELECT job_id, count(*) AS n, min(s) AS s0, max(s) AS s1, arg_min(p, s) AS p0, arg_max(p, s) AS p1 FROM k GROUP BY 1)
    SELECT job_id, CASE WHEN n >= 2 AND p1 > 0 AND p1 < 1 AND p1 > p0 THEN round((1 - p1) / ((p1 - p0) / greatest(1, s1 - s0)), 3) END AS eta_s FROM e""")
def eta(spark, d):
    e = D.read(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"), (F.col("value") / 500).alias("p"))
    return J.eta(e).withColumn("eta_s", F.round("eta_s", 3))


_WALK = """
    req AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, CASE event_type WHEN 'signup' THEN 'signup_grant' WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'debit' ELSE 'refund' END AS kind,
            CAST(floor(CASE event_type WHEN 'signup' THEN 60 WHEN 'purchase' THEN value / 4 ELSE value END + 0.5) AS BIGINT) AS m, user_id || '-' || event_id % 7 AS ref FROM events WHERE event_type <> 'view'),
    fst AS (SELECT * FROM req WHERE kind = 'debit' UNION ALL SELECT * FROM req WHERE kind <> 'debit' QUALIFY row_number() OVER (PARTITION BY kind, ref ORDER BY id) = 1),
    num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM fst),
    walk AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS id, '' AS verdict, 0::BIGINT AS delta, 0::BIGINT AS bal, []::VARCHAR[] AS seen FROM (SELECT DISTINCT user_id FROM num)
        UNION ALL SELECT user_id, n, id, verdict, delta, bal + delta, CASE WHEN kind = 'debit' AND verdict = 'accepted' THEN list_append(seen, ref) ELSE seen END FROM (
            SELECT x.user_id, x.n, x.id, x.kind, x.ref, w.bal, w.seen, CASE WHEN x.kind <> 'debit' THEN 'accepted' WHEN list_contains(w.seen, x.ref) THEN 'duplicate' WHEN w.bal < x.m THEN 'rejected' ELSE 'accepted' END AS verdict,
                   CASE WHEN x.kind <> 'debit' THEN x.m WHEN list_contains(w.seen, x.ref) OR w.bal < x.m THEN 0 ELSE -x.m END AS delta FROM walk w JOIN num x ON x.user_id = w.user_id AND x.n = w.n + 1))
    SELECT id, user_id, verdict, delta, bal AS balance_after FROM walk WHERE n > 0"""


@query("WITH RECURSIVE " + _WALK)
def apply_ledger(spark, d):
    return J.apply_ledger(D.ledger_requests(spark, d)).select("id", "user_id", "verdict", "delta", "balance_after")


_USE = """
    num AS (SELECT j.user_id, j.k AS id, j.id AS job_id, CAST(coalesce(-l.delta_minutes, 0) AS BIGINT) - CAST(floor((j.k % 40) / 1.5::DOUBLE + 0.5) AS BIGINT) AS diff FROM jobs j
            LEFT JOIN led l ON l.reason = 'job_debit' AND l.ref = j.id WHERE j.status = 'done'),
    nn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM num WHERE diff <> 0),
    walk AS (SELECT user_id, 0::BIGINT AS n, '' AS job_id, 0::BIGINT AS delta, greatest(coalesce((SELECT minutes_balance FROM usr u WHERE u.id = q.user_id), 0), 0)::BIGINT AS bal FROM (SELECT DISTINCT user_id FROM nn) q
        UNION ALL SELECT user_id, n, job_id, d, bal + d FROM (SELECT x.user_id, x.n, x.job_id, w.bal, CASE WHEN x.diff >= 0 THEN x.diff ELSE -least(w.bal, -x.diff) END AS d FROM walk w JOIN nn x ON x.user_id = w.user_id AND x.n = w.n + 1))
    SELECT user_id, job_id, delta, bal AS balance_after FROM walk WHERE n > 0"""


@query(with_(**SQL).rstrip() + "," + _USE)
def reconcile(spark, d):
    j = D.jobs(spark, d).where(F.col("status") == "done")
    k = F.col("id").cast("bigint")
    usage = j.select(k.alias("id"), k.cast("double").alias("seq"), "user_id", F.col("id").alias("job_id"), (k % 40 / 1.5).alias("actual_min"))
    opening = D.users(spark, d).select(F.col("id").alias("user_id"), F.greatest(F.col("minutes_balance"), F.lit(0)).alias("balance"))
    return J.reconcile(usage, ledger(spark, d), opening).select("user_id", F.col("ref").alias("job_id"), "delta", "balance_after")


@query(with_(**SQL) + "SELECT user_id, CAST(floor(sum(delta_minutes) + 0.5) AS BIGINT) AS balance FROM led GROUP BY 1")
def balances(spark, d):
    return J.balances(ledger(spark, d))


@query(with_(**SQL) + """SELECT coalesce(u.id, b.user_id) AS user_id, coalesce(u.minutes_balance, 0)::BIGINT AS cached, coalesce(b.s, 0) AS truth FROM usr u
    FULL JOIN (SELECT user_id, CAST(floor(sum(delta_minutes) + 0.5) AS BIGINT) AS s FROM led GROUP BY 1) b ON b.user_id = u.id WHERE coalesce(u.minutes_balance, 0) <> coalesce(b.s, 0)""")
def ledger_audit(spark, d):
    return J.ledger_audit(D.users(spark, d), ledger(spark, d))


def billing_events(e):
    """Events as provider messages: repeated ids, unknown types and users, bad amounts."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "payment.succeeded").when(F.col("event_type") == "signup", "subscription.renewed").otherwise("invoice.created")
    return e.select(
        k.alias("seq"), F.concat(F.lit("e"), (k % 3000).cast("string")).alias("event_id"), kind.alias("type"), (F.col("user_id") * 12).cast("string").alias("user_id"),
        F.when(k % 17 == 0, -1).otherwise(F.floor(F.col("value") * 100)).cast("int").alias("amount_cents"), F.lit("usd").alias("currency"), (F.col("value") - 1).alias("minutes"))


_BILL = """bill AS (SELECT 'e' || event_id % 3000 AS event_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'purchase' ELSE 'subscription_renewal' END AS reason, CAST(user_id * 12 AS VARCHAR) AS user_id,
        CAST(floor(value * 100) AS INT) AS amount_cents, value - 1 AS minutes FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 17 <> 0 AND value > 1 AND user_id * 12 IN (SELECT c_custkey FROM customer)
        AND 'e' || event_id % 3000 NOT IN (SELECT event_id FROM pay)),
    one AS (SELECT * FROM bill QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1)
    SELECT user_id, event_id, amount_cents, CAST(floor(minutes + 0.5) AS DOUBLE) AS delta_minutes, reason FROM one"""


@query(with_(**SQL).rstrip() + "," + _BILL)
def billing_credits(spark, d):
    paid, credit = J.billing_credits(billing_events(D.read(spark, d, "events")), D.users(spark, d), payments(spark, d))
    credit = credit.select(F.col("ref").alias("event_id"), "delta_minutes", "reason")
    return paid.select("user_id", "event_id", "amount_cents").join(credit, "event_id").select("user_id", "event_id", "amount_cents", "delta_minutes", "reason")


_OWED = """(SELECT -l.delta_minutes FROM led l WHERE l.reason = 'job_debit' AND l.ref = j.id AND l.delta_minutes < 0 AND NOT EXISTS (SELECT 1 FROM led r WHERE r.reason = 'job_refund' AND r.ref = j.id))"""


@query(with_(**SQL) + f"SELECT j.id AS job_id, j.user_id, 'failed' AS status, {_OWED} AS refund FROM jobs j WHERE j.status IN ('queued', 'processing') AND j.updated_at < {NOW_SQL} - INTERVAL 30 MINUTE")
def sweep_stale(spark, d):
    swept, refunds = J.sweep_stale(D.jobs(spark, d), ledger(spark, d), NOW)
    back = refunds.select(F.col("ref").alias("job_id"), F.col("delta_minutes").alias("refund"))
    return swept.join(back, "job_id", "left").select("job_id", "user_id", "status", "refund")


@query(with_(**SQL) + f"SELECT user_id, ref, refund FROM (SELECT j.user_id, j.id AS ref, {_OWED} AS refund FROM jobs j WHERE j.status = 'failed') WHERE refund IS NOT NULL")
def failed_refunds(spark, d):
    return J.failed_refunds(D.jobs(spark, d), ledger(spark, d)).select("user_id", "ref", F.col("delta_minutes").alias("refund"))


@query(with_(**SQL) + """SELECT 'users' AS tab, count(*) AS n FROM usr WHERE CAST(id AS BIGINT) % 10 <> 3 UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE CAST(user_id AS BIGINT) % 10 <> 3
    UNION ALL SELECT 'ledger', count(*) FROM led WHERE CAST(user_id AS BIGINT) % 10 <> 3 UNION ALL SELECT 'payments', count(*) FROM pay WHERE CAST(user_id AS BIGINT) % 10 <> 3
    UNION ALL SELECT 'clips', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3))""")
def erase_user(spark, d):
    tables = {"users": D.users(spark, d), "jobs": D.jobs(spark, d), "ledger": ledger(spark, d), "payments": payments(spark, d), "clips": D.clips(spark, d)}
    gone = D.read(spark, d, "customer").where(F.col("c_custkey") % 10 == 3).select(F.col("c_custkey").cast("string").alias("user_id"))
    out = None
    for name, df in J.erase_user(tables, gone).items():
        n = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_DUE = """
    use0 AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS user_id, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 900 + 1) / 60::DOUBLE ELSE 0 END AS used FROM orders WHERE o_orderkey % 10 > 3),
    num AS (SELECT k AS id, use0.user_id, CAST(coalesce(-l.delta_minutes, 0) AS BIGINT) - CAST(floor(used + 0.5) AS BIGINT) AS diff FROM use0
            LEFT JOIN led l ON l.reason = 'job_debit' AND l.ref = CAST(k AS VARCHAR)),
    nn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM num WHERE diff <> 0),
    walk AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS delta, greatest(coalesce((SELECT minutes_balance FROM usr u WHERE u.id = q.user_id), 0), 0)::BIGINT AS bal FROM (SELECT DISTINCT user_id FROM nn) q
        UNION ALL SELECT user_id, n, id, d, bal + d FROM (SELECT x.user_id, x.n, x.id, w.bal, CASE WHEN x.diff >= 0 THEN x.diff ELSE -least(w.bal, -x.diff) END AS d FROM walk w JOIN nn x ON x.user_id = w.user_id AND x.n = w.n + 1)),
    nclip AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    nevent AS (SELECT user_id AS k, count(*) AS n, count(*) FILTER (event_id % 5 NOT IN (0, 1)) AS fresh FROM events GROUP BY 1)"""


@query(with_(**SQL).rstrip() + "," + _DUE + """
    SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 10 < 4 THEN 'failed' ELSE 'done' END AS status,
           CASE o_orderkey % 10 WHEN 0 THEN 'Network error' WHEN 1 THEN 'run.json version mismatch: expected 1, got 2' WHEN 2 THEN 'run.json is not valid JSON'
                WHEN 3 THEN 'run.json failed schema validation' END AS error,
           CASE WHEN o_orderkey % 10 > 3 THEN CAST(floor(o_orderkey % 50 * 0.5 + o_orderkey % 30 * 0.25 + 0.5) AS BIGINT) END AS cost_cents,
           CASE WHEN o_orderkey % 10 > 3 THEN coalesce(c.n, 0) ELSE least(coalesce(c.n, 0), 2) END AS n_clips,
           CASE WHEN o_orderkey % 10 > 3 THEN coalesce(e.fresh, 0) ELSE coalesce(e.n, 0) END AS n_events,
           w.delta AS correction, CASE WHEN o_orderkey % 10 < 4 AND o_orderkey % 5 <> 0 AND o_orderkey % 8 <> 1 AND floor(o_totalprice / 20000) > 0 THEN floor(o_totalprice / 20000) END AS refund
    FROM orders LEFT JOIN nclip c ON c.k = o_orderkey LEFT JOIN nevent e ON e.k = o_orderkey LEFT JOIN walk w ON w.n > 0 AND w.id = o_orderkey""")
def run_import(spark, d):
    """All runs are imported over tables that hold two old clips of each job and its old events."""
    from momentloom.operators.imports import run_import as imported
    from momentloom.plans.q_sources import agent_lines, run_docs

    k = F.col("o_orderkey")
    jobs = D.read(spark, d, "orders").select(k.alias("seq"), k.cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("user_id"))
    clips = D.clips(spark, d).where("clip_index <= 2").select("job_id", "clip_index", "score", "hook", "media_key", "status")
    events = D.agent_events(spark, d).select("job_id", "agent", "action")
    opening = D.users(spark, d).select(F.col("id").alias("user_id"), F.greatest(F.col("minutes_balance"), F.lit(0)).alias("balance"))
    new = imported(run_docs(spark, d), agent_lines(spark, d), jobs, clips, events, ledger(spark, d), opening)
    count = lambda name: new[name].groupBy("job_id").agg(F.count("*").alias(f"n_{name}"))
    out = new["jobs"].join(count("clips"), "job_id", "left").join(count("events"), "job_id", "left")
    out = out.join(new["corrections"].select(F.col("ref").alias("job_id"), F.col("delta").alias("correction")), "job_id", "left")
    out = out.join(new["refunds"].select(F.col("ref").alias("job_id"), F.col("delta_minutes").alias("refund")), "job_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("job_id", "status", "error", "cost_cents", none("n_clips"), none("n_events"), "correction", "refund")
