"""Queries over readers, parsers and table maintenance.  Documents and logs are written from the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentloom.functions.expr import held
from momentloom.operators import text as I
from momentloom.plans import derive as D
from momentloom.plans.registry import LINES, query
from momentloom.schemas import RUN_FACTS, RUN_REPORT
from momentloom.sources import tables as A
from momentloom.sources.replies import typed_claims


def _index_docs(spark, d):
    """One signal document per order; every tenth lacks a key, every tenth has another version."""
    k = F.col("o_orderkey")
    n = (k % 4).cast("int")
    span = lambda a, b: F.struct(a.cast("double").alias("t0"), b.cast("double").alias("t1"))
    some = lambda f: F.transform(F.sequence(F.lit(1), n + 1), f)
    spans = some(lambda i: span(i * 10, i * 10 + 5))
    none = F.array().cast("array<struct<t0:double,t1:double>>")
    curve = F.struct(F.lit(0.5).alias("hop_s"), some(lambda i: i * 1.5).alias("values"))
    fields = {
        "version": F.when(k % 10 == 1, 2).otherwise(1), "media": F.struct(F.lit(100.0).alias("duration_s"), F.lit(30.0).alias("fps"), F.lit(854).alias("width"), F.lit(480).alias("height")),
        "language": F.lit("en"), "words": some(lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("text"), (i * 1.0).alias("t0"), (i + 0.5).alias("t1"), F.lit(0.9).alias("conf"))),
        "fillers": none, "speech": spans, "silences": some(lambda i: span(i * 10 + 5, i * 10 + 10)), "energy": curve,
        "peaks": some(lambda i: F.struct((i * 2.0).alias("t"), (i + 0.25).alias("sigma"))), "rate": curve, "pitch": curve, "surges": spans, "monotone": none,
        "events": some(lambda i: F.struct(F.lit("laughter").alias("label"), (i * 3.0).alias("t0"), (i * 3.0 + 1).alias("t1"), F.lit(0.5).alias("conf"))),
        "scenes": spans, "faces": F.array().cast("array<struct<t:double>>"), "motion": curve, "defects_black": none, "defects_frozen": spans}
    full = F.to_json(F.struct(*[c.alias(n_) for n_, c in fields.items()]))
    less = F.to_json(F.struct(*[c.alias(n_) for n_, c in fields.items() if n_ not in ("faces", "motion")]))
    return D.read(spark, d, "orders").select(k.cast("string").alias("video_id"), F.when(k % 10 == 0, less).otherwise(full).alias("raw"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE o_orderkey % 10 WHEN 0 THEN 'signals JSON missing keys: [''faces'', ''motion'']'
    WHEN 1 THEN 'unsupported signals schema version 2' END AS reason FROM orders""")
def read_signal_index(spark, d):
    return A.judge_signal_index(_index_docs(spark, d)).select("video_id", "reason")


@query("""WITH v AS (SELECT o_orderkey AS k, unnest(range(1, o_orderkey % 4 + 2)) AS i FROM orders WHERE o_orderkey % 10 > 1)
    SELECT CAST(k AS VARCHAR) AS video_id, kind, i - 1 AS pos, CASE kind WHEN 'silence' THEN i * 10.0 + 5 ELSE i * 10.0 END AS t0, CASE kind WHEN 'silence' THEN i * 10.0 + 10 ELSE i * 10.0 + 5 END AS t1
    FROM v, (SELECT unnest(['speech', 'silence', 'surge', 'scene', 'frozen']) AS kind)""")
def flatten_signals(spark, d):
    good, _ = A.parse_signal_index(_index_docs(spark, d))
    return A.flatten_signals(good).spans.select("video_id", "kind", "pos", "t0", "t1")


@query("""WITH v AS (SELECT o_orderkey AS k, unnest(range(1, o_orderkey % 4 + 2)) AS i FROM orders WHERE o_orderkey % 10 > 1)
    SELECT CAST(k AS VARCHAR) AS video_id, name, i - 1 AS i, (i - 1) * 0.5::DOUBLE AS t, i * 1.5::DOUBLE AS v FROM v, (SELECT unnest(['energy', 'rate', 'pitch', 'motion']) AS name)""")
def flatten_curves(spark, d):
    good, _ = A.parse_signal_index(_index_docs(spark, d))
    return A.flatten_signals(good).curves


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, CASE event_type WHEN 'click' THEN 'scout' WHEN 'view' THEN 'critic' WHEN 'purchase' THEN 'surgeon' WHEN 'signup' THEN 'qa' ELSE 'orchestrator' END AS agent,
    CASE WHEN event_id % 5 = 2 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS tokens_in, 0::BIGINT AS tokens_out FROM events WHERE event_id % 5 NOT IN (0, 1)""")
def read_agent_events(spark, d):
    out = A.parse_agent_events(agent_lines(spark, d))
    return out.select("job_id", F.get_json_object("payload", "$.id").cast("bigint").alias("event_id"), "agent", "tokens_in", "tokens_out")


def agent_lines(spark, d):
    """Events as log lines of their user's job; some blank, cut short or without token counts."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id")
    agent = D.agent_of(F.col("event_type"))
    head = F.concat(F.lit('{"agent":"'), agent, F.lit('","action":"step","payload":{"id":'), e.cast("string"), F.lit("}"))
    line = F.when(e % 5 == 0, F.lit("   ")).when(e % 5 == 1, F.substring(head, 1, 30)).when(e % 5 == 2, F.concat(head, F.lit("}"))).otherwise(
        F.concat(head, F.lit(',"tokens_in":'), k, F.lit("}")))
    return D.read(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), line.alias("value"))


def run_docs(spark, d):
    """One run result per order: its lines are clips, none for some; some orders carry an error, another version, or no JSON."""
    claim = lambda q: F.struct(F.lit("energy_peak").alias("kind"), F.lit(3.5).alias("t"), (q / 10).alias("value"))
    part = lambda s, q: F.struct(s.cast("int").alias("score"), F.array(claim(q)).alias("evidence"))

    def clip(line, at):
        i, q = at + 1, line["l_quantity"]
        score = F.when(i % 3 != 0, F.struct(F.floor(q).alias("total"), F.lit("keep").alias("verdict"), F.struct(
            part(q / 2, q).alias("hook_strength"), part(q / 3, q).alias("payoff")).alias("components")))
        hook = F.when(i % 2 == 0, F.struct(F.concat(F.lit("Hook "), i.cast("string")).alias("title"), F.struct(F.lit("a").alias("tiktok")).alias("captions")))
        dropped = F.when(line["l_returnflag"] == "R", F.lit("BLACK"))
        return F.struct(
            i.alias("index"), F.struct((q * 1.0).alias("t0"), (q + 40.0).alias("t1"), F.lit("fallback").alias("source"), F.lit("").alias("notes"), F.array(claim(q)).alias("evidence")).alias("candidate"),
            F.struct((q + 0.5).alias("t0"), (q + 30.5).alias("t1"), F.lit(None).cast("int").alias("payoff_word_i")).alias("cut"), score.alias("score"), hook.alias("hook"),
            F.struct(dropped.isNull().alias("passed"), F.when(dropped.isNotNull(), F.array(F.struct(F.lit("BLACK").alias("code"), F.lit("x").alias("detail")))).otherwise(
                F.array().cast("array<struct<code:string,detail:string>>")).alias("failures")).alias("qa"),
            F.when(dropped.isNotNull(), F.array(F.struct(F.lit(1).alias("attempt"), F.array(F.lit("BLACK")).alias("codes"), F.lit("render").alias("route"), F.lit("failed").alias("outcome")))).otherwise(
                F.array().cast("array<struct<attempt:int,codes:array<string>,route:string,outcome:string>>")).alias("repairs"),
            dropped.alias("dropped_reason"), F.struct(F.concat(F.lit("m"), i.cast("string")).alias("mp4"), F.concat(F.lit("j"), i.cast("string")).alias("thumb")).alias("paths"))

    # Lines stay narrow until their order is complete: only three columns and the two that order them are shuffled and sorted, once.
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    every = F.collect_list(F.struct("l_quantity", "l_returnflag")).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = D.read(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("n"), every.alias("lines")).where(F.col("n") == 1).drop("n")
    clips = F.transform(F.coalesce("lines", F.array().cast(per.schema["lines"].dataType)), clip).alias("clips")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    total = lambda c: F.struct(F.lit(10).alias("tokens_in"), F.lit(5).alias("tokens_out"), c.alias("cost_cents"))
    run = F.struct(
        F.when(k % 10 == 1, 2).otherwise(1).alias("version"), F.lit("0.1.0").alias("pipeline_version"),
        F.struct(F.lit("in.mp4").alias("input"), (k % 900 * 1.0).alias("duration_s")).alias("source"), F.when(k % 7 != 0, k % 900 * 1.0 + 1).alias("duration_processed_s"),
        F.struct(total(k % 50 * 0.5).alias("scout"), total(k % 30 * 0.25).alias("critic")).alias("agent_totals"),
        F.struct(F.lit(0.25).alias("ingest"), (k % 40 * 0.5).alias("signals"), (k % 60 * 0.25).alias("render")).alias("timings_s"), clips)
    doc = (F.when(k % 10 == 0, F.lit('{"version":1,"error":{"code":"NETWORK","message":"Network error"}}')).when(k % 10 == 2, F.lit("not json"))
           .when(k % 10 == 3, F.lit('{"version":1,"pipeline_version":"x"}')).otherwise(F.to_json(run)))
    return D.read(spark, d, "orders").join(per, k == F.col("l_orderkey"), "left").select(k.cast("string").alias("job_id"), doc.alias("raw"))


_ONE = f"SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS q, l_returnflag AS f FROM {LINES} WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"
_RUNS = "SELECT o_orderkey AS k FROM orders"


@query(f"""WITH o AS ({_RUNS}) SELECT CAST(k AS VARCHAR) AS job_id, CASE WHEN k % 10 < 4 THEN 'failed' ELSE 'done' END AS status,
    CASE k % 10 WHEN 0 THEN 'Network error' WHEN 1 THEN 'run.json version mismatch: expected 1, got 2' WHEN 2 THEN 'run.json is not valid JSON'
         WHEN 3 THEN 'run.json failed schema validation' END AS error FROM o""")
def read_run_results(spark, d):
    status = F.when(F.col("error").isNull(), "done").otherwise("failed")
    return A.judge_run_results(run_docs(spark, d), RUN_FACTS).select("job_id", status.alias("status"), "error")


@query(f"""WITH o AS ({_ONE}) SELECT CAST(k AS VARCHAR) AS job_id, i AS clip_index, q + 0.5 AS t_start, q + 30.5 AS t_end, CASE WHEN i % 3 <> 0 THEN CAST(floor(q) AS INT) END AS score,
    CASE WHEN i % 2 = 0 THEN 'Hook ' || i END AS hook, CASE WHEN f = 'R' THEN 'dropped' ELSE 'ready' END AS status, CASE WHEN f = 'R' THEN 'BLACK' END AS dropped_reason, 'm' || i AS media_key FROM o WHERE k % 10 > 3""")
def clip_rows(spark, d):
    shown = ["job_id", "clip_index", "t_start", "t_end", "score", "hook", "status", "dropped_reason", "media_key"]
    ok, _ = A.parse_run_results(run_docs(spark, d), A.rows_schema(shown))
    return A.clip_rows(ok, shown)


@query(f"""WITH o AS ({_RUNS}) SELECT CAST(k AS VARCHAR) AS job_id, CASE WHEN k % 7 <> 0 THEN round((k % 900 + 1) / 60::DOUBLE, 6) END AS duration_min,
    CAST(floor(k % 50 * 0.5 + k % 30 * 0.25 + 0.5) AS BIGINT) AS cost_cents FROM o WHERE k % 10 > 3""")
def job_facts(spark, d):
    ok, _ = A.parse_run_results(run_docs(spark, d), RUN_FACTS)
    return A.job_facts(ok).withColumn("duration_min", F.round("duration_min", 6))


@query(f"""WITH o AS ({_RUNS}), t AS (SELECT unnest([struct_pack(stage := 'ingest', s := 0.25::DOUBLE), struct_pack(stage := 'signals', s := k % 40 * 0.5::DOUBLE),
    struct_pack(stage := 'render', s := k % 60 * 0.25::DOUBLE)], recursive := true) FROM o WHERE k % 10 > 3)
    SELECT stage, count(*) AS n_runs, sum(s) AS total_s, quantile_cont(s, 0.5) AS p50_s, max(s) AS max_s FROM t GROUP BY 1""")
def stage_timings(spark, d):
    from momentloom.operators.product import stage_timings as timings

    return timings(A.parse_run_results(run_docs(spark, d), RUN_FACTS)[0])[0]


@query(f"""WITH o AS ({_RUNS}) SELECT CAST(k AS VARCHAR) AS job_id, round((0.25::DOUBLE + k % 40 * 0.5 + k % 60 * 0.25) / (k % 900 + 1), 6) AS realtime_factor
    FROM o WHERE k % 10 > 3 AND k % 7 <> 0""")
def realtime_factors(spark, d):
    from momentloom.operators.product import realtime_factors as factors

    return factors(A.parse_run_results(run_docs(spark, d), RUN_FACTS)[0]).withColumn("realtime_factor", F.round("realtime_factor", 6))


def _readable(spark, d):
    """Run clips with their claims read, as the report wants them."""
    ok, _ = A.parse_run_results(run_docs(spark, d), RUN_REPORT)
    c = ok.select("job_id", F.explode("run.clips").alias("c"))
    return held(c, candidate=A.with_claims(F.col("c.candidate"), typed_claims), score=A.scored_claims(F.col("c.score"), typed_claims)).select(
        "job_id", F.col("c.index").alias("clip_index"), "candidate", "score", F.col("c.repairs").alias("repairs"), F.col("c.qa").alias("qa"))


@query(f"""WITH o AS ({_ONE}), v AS (SELECT CAST(k AS VARCHAR) AS job_id, i AS clip_index, q, f, 'Energy spike +' || regexp_replace(CAST(q / 10 AS VARCHAR), '\\.0$', '') || 'σ at 0:04' AS cl FROM o WHERE k % 10 > 3)
    SELECT job_id, clip_index, 'source' AS section, 0 AS ord, 'Padding (low-signal content)' AS line FROM v UNION ALL SELECT job_id, clip_index, 'claim', 0, cl FROM v
    UNION ALL SELECT job_id, clip_index, 'component', 1000, 'Hook strength: ' || CAST(trunc(q / 2) AS INT) || '/25' FROM v WHERE clip_index % 3 <> 0
    UNION ALL SELECT job_id, clip_index, 'component', 1001, cl FROM v WHERE clip_index % 3 <> 0
    UNION ALL SELECT job_id, clip_index, 'component', 2000, 'Payoff: ' || CAST(trunc(q / 3) AS INT) || '/25' FROM v WHERE clip_index % 3 <> 0
    UNION ALL SELECT job_id, clip_index, 'component', 2001, cl FROM v WHERE clip_index % 3 <> 0
    UNION ALL SELECT job_id, clip_index, 'repair', 0, 'Attempt 1: attempted to fix BLACK via re-render' FROM v WHERE f = 'R' UNION ALL SELECT job_id, clip_index, 'qa', 0, 'Black frame detected' FROM v WHERE f = 'R'""")
def evidence_report(spark, d):
    return I.evidence_report(_readable(spark, d))


# --- maintenance --------------------------------------------------------------------------------------

_CLIPS = f"""SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_linenumber AS clip_index, CAST(floor(l_quantity) AS INT) AS score, CASE WHEN l_returnflag = 'R' THEN 'dropped' ELSE 'ready' END AS status,
    'u/' || l_orderkey || '/clip_' || l_linenumber || '.mp4' AS media_key FROM {LINES}"""


@query(f"WITH c AS ({_CLIPS}) SELECT job_id, clip_index, score + CASE WHEN clip_index >= 3 THEN 100 ELSE 0 END AS score FROM c")
def upsert_clips(spark, d):
    c = D.clips(spark, d)
    new = c.where(F.col("clip_index") >= 3).withColumn("score", (F.col("score") + 100).cast("int"))
    return A.upsert_clips(c.where(F.col("clip_index") <= 4), new).select("job_id", "clip_index", "score")


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, CASE WHEN user_id % 3 = 0 THEN 'again' ELSE 'step' END AS action FROM events
    UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'again' FROM events WHERE user_id % 3 = 0 AND event_type = 'click'""")
def replace_events(spark, d):
    old = D.agent_events(spark, d).select("job_id", "seq", "action", "agent")
    new = old.where(F.col("job_id").cast("bigint") % 3 == 0).withColumn("action", F.lit("again"))
    new = new.unionByName(new.where(F.col("agent") == "scout"))
    return A.replace_events(old, new).select("job_id", "seq", "action")


@query(f"WITH c AS ({_CLIPS}) SELECT job_id, clip_index, CASE WHEN clip_index % 2 = 0 THEN replace(media_key, '.mp4', '_s2.mp4') ELSE media_key END AS media_key, score FROM c")
def swap_media_keys(spark, d):
    c = D.clips(spark, d)
    new = c.where(F.col("clip_index") % 2 == 0).select("job_id", "clip_index", F.replace("media_key", F.lit(".mp4"), F.lit("_s2.mp4")).alias("media_key"), "thumb_key")
    stray = new.select("job_id", (F.col("clip_index") + 100).alias("clip_index"), "media_key", "thumb_key")
    return A.swap_media_keys(c, new.unionByName(stray)).select("job_id", "clip_index", "media_key", "score")


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_orderkey % 100 AS a, o_orderkey % 3 AS n FROM orders)
    SELECT video_id, 'black' AS kind, 0 AS pos, a + 0.5 AS t0, a + 1.25 AS t1 FROM o UNION ALL SELECT video_id, 'frozen', 0, a + 2.0, a + 3.0 FROM o WHERE n >= 1
    UNION ALL SELECT video_id, 'frozen', 1, a + 4.0, a + 5.5 FROM o WHERE n = 2""")
def parse_defect_logs(spark, d):
    a, n = F.col("o_orderkey") % 100, F.col("o_orderkey") % 3
    s = lambda c: c.cast("string")
    start = lambda t: F.concat(F.lit("\n[x] lavfi.freezedetect.freeze_start: "), s(t))
    end = lambda t: F.concat(F.lit("\n[x] lavfi.freezedetect.freeze_end: "), s(t))
    log = F.concat(F.lit("frame=1\n[b @ 0x1] black_start:"), s(a + 0.5), F.lit(" black_end:"), s(a + 1.25), F.lit(" black_duration:0.75"), start(a + 2.0),
                   F.when(n >= 1, end(a + 3.0)).otherwise(""), F.when(n >= 1, start(a + 4.0)).otherwise(""), F.when(n == 2, end(a + 5.5)).otherwise(""))
    return A.parse_defect_logs(D.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), log.alias("log")))


def _loud(spark, d):
    k = F.col("o_orderkey")
    lufs = (-18.0 + k % 80 / 10).cast("decimal(5,1)").cast("string")
    tail = F.when(k % 11 == 0, F.lit("I: -inf LUFS")).otherwise(F.concat(F.lit("  I:         "), lufs, F.lit(" LUFS\n  Threshold: -24.0 LUFS")))
    return A.parse_loudness_logs(D.read(spark, d, "orders").select(
        k.cast("string").alias("video_id"), F.concat(F.lit("t: 1 I: -70.0 LUFS\nSummary:\n I: -1.0 LUFS\nSummary:\n"), tail).alias("log")))


_LOUD = "SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderkey % 11 = 0 THEN '-inf'::DOUBLE ELSE round(-18.0::DOUBLE + (o_orderkey % 80) / 10::DOUBLE, 1) END AS lufs FROM orders"


@query(_LOUD)
def parse_loudness_logs(spark, d):
    return _loud(spark, d)


@query(f"WITH l AS ({_LOUD}) SELECT video_id, lufs, round(-14 - lufs, 6) AS gain_db FROM l WHERE abs(-14.0::DOUBLE - lufs) > 0.5 AND abs(-14.0::DOUBLE - lufs) <= 3")
def loudness_trim_plan(spark, d):
    return A.loudness_trim_plan(_loud(spark, d)).withColumn("gain_db", F.round("gain_db", 6))


_PAT = [p for p, _, _ in A.INGEST_ERRORS]


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c, _) in enumerate(A.INGEST_ERRORS)) + """) v(ord, pat, code)),
    f AS (SELECT doc_id, lower(d.text || CASE WHEN p.pat IS NULL THEN '' ELSE ' ERROR: ' || p.pat END) AS low FROM documents d LEFT JOIN p ON p.ord = d.doc_id % 30)
    SELECT CAST(doc_id AS VARCHAR) AS source, coalesce((SELECT arg_min(p.code, p.ord) FROM p WHERE contains(f.low, p.pat)), 'UNAVAILABLE') AS code FROM f""")
def classify_ingest_errors(spark, d):
    k = (F.col("doc_id") % 30).cast("int")
    said = F.get(F.array(*[F.lit(p.upper()) for p in _PAT]), k)
    docs = D.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.concat("text", F.coalesce(F.concat(F.lit(" ERROR: "), said), F.lit(""))).alias("stderr"))
    return A.classify_ingest_errors(docs).select("source", "code")


@query("""SELECT doc_id, CASE WHEN n_chars * 4 > 10800 AND doc_id % 5 <> 0 THEN 'TOO_LONG' WHEN n_chars::BIGINT * 1000000 > 2147483648 AND doc_id % 7 <> 0 THEN 'TOO_BIG' END AS rejected FROM documents""")
def enforce_caps(spark, d):
    k = F.col("doc_id")
    m = D.read(spark, d, "documents").select(
        "doc_id", F.when(k % 5 != 0, F.col("n_chars") * 4.0).alias("duration_s"), F.when(k % 7 != 0, F.col("n_chars") * 1000000).alias("size_bytes"))
    return A.enforce_caps(m).select("doc_id", "rejected")


@query("SELECT url AS source, length(html) AS fingerprint FROM pages WHERE NOT (page_id % 2 = 0 AND page_id % 6 <> 0 AND page_id % 10 <> 0)")
def pending_work(spark, d):
    p = D.read(spark, d, "pages")
    inputs = p.select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("source"), F.length("html").alias("fingerprint"), "url")
    done = p.where(F.col("page_id") % 2 == 0).select(
        F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("source"), (F.length("html") + F.when(F.col("page_id") % 6 == 0, 1).otherwise(0)).alias("fingerprint"),
        F.when(F.col("page_id") % 10 == 0, 0).otherwise(1).alias("version"))
    return A.pending_work(inputs, done).select(F.col("url").alias("source"), "fingerprint")


@query(f"""WITH c AS ({_CLIPS}) SELECT job_id, clip_index, '2026-01-02_gallery/' || lpad(CAST(clip_index AS VARCHAR), 2, '0') || '_Clip_' || clip_index || '.mp4' AS target FROM c WHERE status = 'ready'""")
def export_manifest(spark, d):
    return A.export_manifest(D.clips(spark, d), "gallery", "2026-01-02").select("job_id", "clip_index", "target")


@query(f"""WITH c AS ({_CLIPS}) SELECT job_id, clip_index, 'T' || clip_index AS title, CASE clip_index % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'private' ELSE 'unlisted' END AS privacy
    FROM c WHERE status = 'ready' AND clip_index <> 5 AND (CAST(job_id AS BIGINT) + clip_index) % 3 <> 0""")
def publish_queue(spark, d):
    c = D.clips(spark, d)
    i = F.col("clip_index")
    meta = c.where(i != 5).select("job_id", "clip_index", F.concat(F.lit("T"), i.cast("string")).alias("title"),
                                  F.when(i % 4 == 0, "public").when(i % 4 == 2, "private").when(i % 4 == 3, "secret").alias("privacy"))
    sent = c.where((F.col("job_id").cast("bigint") + i) % 3 == 0).select("job_id", "clip_index")
    return A.publish_queue(c, meta, sent).select("job_id", "clip_index", "title", "privacy")
