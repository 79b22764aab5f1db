"""Readers over files: signal documents, agent logs, run results; the run import on edge cases."""

import json

from pyspark.sql import functions as F

from momentloom.operators.imports import run_import
from momentloom.plans import q_sources as Q
from momentloom.sources import tables as A

D = "/root/testdata/sf0.001"


def put(root, key, name, text):
    (root / key).mkdir(parents=True, exist_ok=True)
    (root / key / name).write_text(text)


def test_signal_documents(spark, tmp_path):
    docs = {r.video_id: r.raw for r in Q._index_docs(spark, D).orderBy("video_id").limit(25).collect()}
    for key, raw in docs.items():
        put(tmp_path / "in", key, "signals.json", raw)
    sig, bad = A.read_signal_index(spark, str(tmp_path / "in"))
    told = {k: json.loads(v) for k, v in docs.items()}
    rejected = {r.video_id for r in bad.collect()}
    assert rejected == {k for k, v in told.items() if v.get("version") != 1 or "faces" not in v}
    A.write_signals(sig, str(tmp_path / "out"))
    words = spark.read.parquet(str(tmp_path / "out/words"))
    assert words.count() == sum(len(v["words"]) for k, v in told.items() if k not in rejected)
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out/spans")).select("kind").distinct().collect()} >= {"speech", "silence"}


def test_agent_logs(spark, tmp_path):
    put(tmp_path, "j1", "agent_events.jsonl", '{"agent":"scout","action":"x","payload":{},"tokens_in":5}\n\n{"agent":"qa"\n')
    put(tmp_path, "j2", "agent_events.jsonl", '{"agent":"critic","action":"y","payload":{}}\n')
    rows = A.read_agent_events(spark, str(tmp_path)).collect()
    assert sorted((r.job_id, r.agent, r.tokens_in) for r in rows) == [("j1", "scout", 5), ("j2", "critic", 0)]
    strict = A.read_agent_events(spark, str(tmp_path), "strict").collect()
    assert sorted((r.job_id, r.ok) for r in strict) == [("j1", False), ("j1", True), ("j2", True)]


def test_run_results_are_read_once_and_lines_stay_narrow(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    runs = plan(Q.read_run_results(spark, D))
    assert runs.count("FileScan parquet") == 2 and "ObjectHashAggregate" not in runs
    for r in Q.run_docs(spark, D).where("job_id % 10 > 3").collect():
        assert [c["index"] for c in json.loads(r.raw)["clips"]] == list(range(1, len(json.loads(r.raw)["clips"]) + 1))


def test_signal_documents_are_judged_once(spark):
    assert Q.read_signal_index(spark, D)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_run_results_and_import(spark, tmp_path):
    docs = {r.job_id: r.raw for r in Q.run_docs(spark, D).orderBy("job_id").limit(20).collect()}
    for key, raw in docs.items():
        put(tmp_path, key, "run.json", raw)
    ok, bad = A.read_run_results(spark, str(tmp_path))
    assert {r.job_id for r in bad.collect()} == {k for k in docs if int(k) % 10 < 4}
    assert {r.job_id for r in ok.collect()} == {k for k in docs if int(k) % 10 > 3}
    good = next(k for k in docs if int(k) % 10 > 3)
    failed = next(k for k in docs if int(k) % 10 < 4)
    raw = spark.createDataFrame([(good, docs[good]), (failed, docs[failed]), ("stranger", docs[good])], "job_id string, raw string")
    jobs = spark.createDataFrame([(1, good, "u"), (2, failed, "u"), (3, "idle", "u")], "seq bigint, job_id string, user_id string")
    clips = spark.createDataFrame([(failed, 1, "old"), ("idle", 1, "old")], "job_id string, clip_index int, media_key string")
    events = spark.createDataFrame([(good, "old"), (failed, "old")], "job_id string, agent string")
    entries = spark.createDataFrame([("u", -4.0, "job_debit", k, None) for k in (good, failed)], "user_id string, delta_minutes double, reason string, ref string, created_at timestamp")
    opening = spark.createDataFrame([("u", 100)], "user_id string, balance bigint")
    lines = spark.createDataFrame([(good, '{"agent":"qa","action":"x","payload":{}}'), (failed, '{"agent":"qa","action":"x","payload":{}}')], "job_id string, value string")
    new = run_import(raw, lines, jobs, clips, events, entries, opening)
    assert {r.job_id: r.status for r in new["jobs"].collect()} == {good: "done", failed: "failed", "idle": "processing"}
    assert {r.job_id for r in new["clips"].collect()} <= {good, failed, "idle"}
    assert sorted((r.job_id, r.agent) for r in new["events"].collect()) == sorted([(good, "qa"), (failed, "old")])
    assert [(r.ref, r.delta_minutes) for r in new["refunds"].collect()] == [(failed, 4.0)]
    assert [r.ref for r in new["corrections"].collect()] in ([good], [])


def test_factors_of_runs_store_nothing_and_read_clips_no_further_than_needed(spark, monkeypatch):
    from momentloom.operators import product

    monkeypatch.setattr(product, "settle", None)  # not called: the times of stages are not counted for the factors
    plan = Q.realtime_factors(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Generate") == 2


def test_verdicts_on_odd_documents(spark):
    """What is no JSON, another shape, an error or another version, whatever part of the clips is read."""
    good = json.dumps({"version": 1, "pipeline_version": "x", "source": {}, "agent_totals": {}, "timings_s": {"a": 1.5}, "clips": [
        {"index": 1, "candidate": {"t0": 1, "evidence": [{"kind": "quote", "t": 1, "value": "\"error\""}]}, "cut": {"t0": 1.0}}]})
    no_json, shape = "run.json is not valid JSON", "run.json failed schema validation"
    version = "run.json version mismatch: expected 1, got "
    cases = [
        (good, None), (" \n" + good, None), (good.replace('"t0": 1,', '"t0": "odd",'), None), (good[:-1], no_json), (None, no_json), ("", no_json), (good.replace('"', "'"), no_json),
        (good.replace("1.5", "NaN"), no_json), (f"[{good}]", version + "undefined"), (good.replace('"version": 1', '"version": 1.0'), version + "1.0"),
        (good.replace('"version": 1', '"version": "1"'), None), (good[:-1] + ',"error":null}', "run.json error-shape failed validation"),
        (good[:-1] + ',"\\u0065rror":{"message":"m"}}', "m"), (good[:-1] + ',"error":{"message":"m"}}', "m"),
        (good[:-1] + ',"x":{"error":1}}', None), (good.replace('"index": 1', '"index": "a"'), shape), (good.replace('{"t0": 1.0}', "5"), shape), (good.replace('{"a": 1.5}', "[]"), shape)]
    docs = spark.createDataFrame([(str(i), raw) for i, (raw, _) in enumerate(cases)], "job_id string, raw string")
    for schema in (A.RUN_RESULT, Q.RUN_FACTS):
        got = {int(r.job_id): r.error for r in A.judge_run_results(docs, schema).select("job_id", "error").collect()}
        assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_report_lines_come_from_one_read_of_each_clip(spark, monkeypatch):
    from momentloom.operators import text
    from momentloom.plans import derive

    monkeypatch.setattr(derive, "settle", None)  # not called
    assert Q.evidence_report(spark, D)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2

    odd = [
        '{"clips":[{"index":1,"candidate":{"source":"llm","evidence":[{"kind":"quote","t":61,"value":"hi"},{"kind":"energy_peak","t":1,"value":2.0},{"kind":"laughter"}]},'
        '"score":{"components":{"payoff":{"score":3},"other":{"score":1},"emotion":{"score":4,"evidence":[{"kind":"new","t":2}]}}},"qa":{"failures":[{"code":"RES"},{"code":"X"}]},'
        '"repairs":[{"attempt":2,"codes":["RES"],"route":"surgeon","outcome":"fixed"},7]}]}',
        '{"clips":[{"index":2},{"index":3,"candidate":{"source":"z"},"repairs":[]}]}']
    docs = spark.createDataFrame([("j", raw) for raw in odd], "job_id string, raw string")
    want = [
        (1, "claim", 0, 'Quotable: "hi"'), (1, "claim", 1, "Energy spike +2σ at 0:01"), (1, "claim", 2, "Laughter at 0:00"),
        (1, "component", 2000, "Payoff: 3/25"), (1, "component", 3000, "Emotion: 4/25"), (1, "component", 3001, "new at 0:02"),
        (1, "qa", 0, "Wrong resolution"), (1, "qa", 1, "X"),
        (1, "repair", 0, "Attempt 2: fixed RES via re-cut"), (1, "repair", 1, "Attempt ?: attempted to fix an issue via unknown step"),
        (1, "source", 0, "Found by: AI semantic pass"), (3, "source", 0, "Found by: z")]
    for schema, read in ((A.RUN_RESULT, A.read_claims), (Q.RUN_REPORT, Q.typed_claims)):
        c = docs.select("job_id", F.explode(F.from_json("raw", schema)["clips"]).alias("c"))
        clips = c.select("job_id", F.col("c.index").alias("clip_index"), A.with_claims(F.col("c.candidate"), read).alias("candidate"),
                         A.scored_claims(F.col("c.score"), read).alias("score"), F.col("c.repairs").alias("repairs"), F.col("c.qa").alias("qa"))
        assert sorted((r.clip_index, r.section, r.ord, r.line) for r in text.evidence_report(clips).collect()) == want


def test_import_reads_documents_once_and_keeps_whole_rows_where_asked(spark, tmp_path):
    """No table but the stored runs reads the documents; rows of clips have their evidence and QA record if the old ones have."""
    docs = Q.run_docs(spark, D).where("job_id in ('4', '5', '6', '10', '11')")
    docs.write.parquet(f"{tmp_path}/documents")
    raw = spark.read.parquet(f"{tmp_path}/documents")
    jobs = spark.createDataFrame([(int(k), k, "u") for k in ("4", "5", "6", "10", "11")], "seq bigint, job_id string, user_id string")
    events = spark.createDataFrame([], "job_id string, agent string")
    entries = spark.createDataFrame([], "user_id string, delta_minutes double, reason string, ref string, created_at timestamp")
    opening = spark.createDataFrame([("u", 100)], "user_id string, balance bigint")
    lines = spark.createDataFrame([], "job_id string, value string")
    whole = A.clip_rows(A.parse_run_results(docs)[0])
    for columns in (["job_id", "clip_index", "media_key"], whole.columns):
        old = whole.select(*columns).limit(0)
        new = run_import(raw, lines, jobs, old, events, entries, opening)
        assert not any("documents" in f for df in new.values() for f in df.inputFiles())
        shown = lambda df: sorted((str(r.asDict()) for r in df.select(*columns).collect()))
        assert shown(new["clips"]) == shown(whole) != []
        assert {r.job_id: r.status for r in new["jobs"].collect()} == {"4": "done", "5": "done", "6": "done", "10": "failed", "11": "failed"}
