import json
import random
import statistics
from datetime import datetime

import pytest
from make import table
from pyspark.sql import functions as F

from momentloom.functions.expr import fixed, half_even, half_up, title_case, truncate_words
from momentloom.operators import product as J
from momentloom.operators import text as I
from momentloom.sources import tables as A
from momentloom.sources.replies import parse_model_replies


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_rounding_and_case(spark):
    assert [one(spark, half_even(F.lit(v))) for v in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert [one(spark, half_up(F.lit(v))) for v in (0.5, -2.5, 2.4)] == [1, -2, 2]
    assert one(spark, fixed(F.lit(12.25), 1)) == "12.2"
    for s in ("a kind of hope that's, quote", "HELLO wORLD 3rd", "don't", "ßach"):
        assert one(spark, title_case(F.lit(s))) == s.title()
    assert one(spark, truncate_words(F.lit("hello world"), 100)) == "hello world"
    assert one(spark, truncate_words(F.lit("hello world"), 8)) == "hello…"


def test_fallback_title(spark):
    tok = lambda s: F.array(*[F.lit(x) for x in s.split()])
    assert one(spark, I.fallback_title(tok("a kind of hope that's, quote unquote"))) == "A Kind Of Hope That'S, Quote"
    assert one(spark, I.fallback_title(tok("novelist, essayist and philosopher, ronald wright is"))) == "Novelist, Essayist And Philosopher, Rona"
    assert one(spark, I.fallback_title(F.array().cast("array<string>"))) == "Watch This Clip"


def test_agent_cost(spark):
    ddl = "agent string, action string, payload string, tokens_in bigint, tokens_out bigint"
    cost = lambda rows: {r.agent: round(r.cost_cents, 6) for r in J.agent_totals(table(spark, rows, ddl)).collect()}
    assert cost([("scout", "x", "{}", 2_000_000, 2_000_000), ("critic", "x", "{}", 500_000, 0)]) == {"scout": 3600.0, "critic": 150.0}
    cheap = json.dumps({"model": "claude-haiku-4-5-20251001"})
    assert cost([("critic", "x", cheap, 1_000_000, 1_000_000), ("scout", "x", "{}", 1_000_000, 1_000_000)]) == {"critic": 600.0, "scout": 1800.0}


def ledger(spark, rows, opening=None):
    df = table(spark, [(i, float(i), *r) for i, r in enumerate(rows)], "id bigint, seq double, user_id string, kind string, minutes double, ref string")
    start = None if opening is None else table(spark, list(opening.items()), "user_id string, balance bigint")
    return sorted(J.apply_ledger(df, start).collect(), key=lambda r: r.id)


def test_ledger(spark):
    got = ledger(spark, [("u", "debit", 40.0, "a"), ("u", "debit", 40.0, "b")], {"u": 50})
    assert [(r.verdict, r.balance_after) for r in got] == [("accepted", 10), ("rejected", 10)]
    got = ledger(spark, [("u", "signup_grant", 60.0, "u"), ("u", "debit", 30.0, "A"), ("u", "debit", 20.0, "B"), ("u", "refund", 20.0, "B"), ("u", "reconcile", 5.0, "A"),
                         ("u", "refund", 20.0, "B"), ("u", "debit", 30.0, "A")])
    assert got[-1].balance_after == 35 and sum(r.delta for r in got) == 35 and got[-1].verdict == "duplicate"
    # a refused debit may land later, and an accepted one is remembered across the first shortfall
    got = ledger(spark, [("u", "debit", 10.0, "a"), ("u", "debit", 50.0, "b"), ("u", "purchase", 60.0, "p"), ("u", "debit", 50.0, "b"), ("u", "debit", 50.0, "b"), ("u", "debit", 10.0, "a")], {"u": 20})
    assert [r.verdict for r in got] == ["accepted", "rejected", "accepted", "accepted", "duplicate", "duplicate"]
    assert [ledger(spark, [("u", "reconcile", float(e - a), "j")], {"u": b})[0].balance_after for b, e, a in ((100, 30, 10), (100, 30, 45), (35, 30, 100))] == [120, 85, 0]


def test_sweep(spark):
    now = datetime(2026, 1, 1, 12)
    row = lambda i, s, m: (i, "u", s, datetime(2026, 1, 1, 11, 60 - m) if m <= 60 else now)
    jobs = table(spark, [row("a", "processing", 31), row("b", "processing", 5), row("c", "queued", 40), row("d", "done", 50)], "id string, user_id string, status string, updated_at timestamp")
    led = table(spark, [("u", -12.0, "job_debit", "a", now)], "user_id string, delta_minutes double, reason string, ref string, created_at timestamp")
    swept, back = J.sweep_stale(jobs, led, now)
    assert sorted(r.job_id for r in swept.collect()) == ["a", "c"]
    assert [(r.ref, r.delta_minutes) for r in back.collect()] == [("a", 12.0)]
    again = led.unionByName(back.withColumn("created_at", F.lit(now)))
    assert J.sweep_stale(jobs, again, now)[1].count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "j1").mkdir()
    (tmp_path / "j1" / "agent_events.jsonl").write_text('{"agent":"scout","action":"found","payload":{"count":3},"tokens_in":5}\n\n{"agent":"cri')
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "j2").mkdir()
    (tmp_path / "r" / "j2" / "run.json").write_text('{"version":1,"error":{"code":"X","message":"boom"}}')
    ev = A.read_agent_events(spark, str(tmp_path / "j1"))
    row = I.activity_feed(ev).first()
    assert (row.job_id, row.tokens_in, row.tokens_out, row.line) == ("j1", 5, 0, "Scout found 3 moments")
    ok, bad = A.read_run_results(spark, str(tmp_path / "r" / "*"))
    assert ok.count() == 0 and bad.first().error == "boom" and bad.first().job_id == "j2"
    files = A.fingerprints(spark, str(tmp_path / "r")).collect()
    assert len(files) == 1 and ":" in files[0].fingerprint


def test_replies(spark):
    rows = [("a", 1, "no"), ("a", 2, '```json\n{"t": "x"}\n```'), ("b", 1, 'sure: {"t": {"y": 1}} ok'), ("b", 2, '{"t": "z"}'), ("c", 1, "[1]")]
    out = parse_model_replies(table(spark, rows, "k string, attempt int, raw string"), ["t"], {"t": "string"}, ["k"]).collect()
    assert {r.k: r.attempt for r in out} == {"a": 2, "b": 2, "c": None}


def plain_lines(rows, least=3, most=5, gap=1.2):
    """Line and place of each word, one after another."""
    line, n, out = 0, 0, []
    for k, (text, t0, t1) in enumerate(rows):
        out.append((line, n))
        n += 1
        after = rows[k + 1][1] - t1 if k + 1 < len(rows) else 0.0
        if n >= most or n >= least and (text.rstrip()[-1:] in tuple(".,!?;:") or after > gap):
            line, n = line + 1, 0
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_caption_blocks_are_the_fold(spark, block):
    r = random.Random(block)
    words, cuts = [], []
    for v in range(6):
        t = 0.0
        for pos in range([0, 1, 5, 63, 200, 400][v]):
            words.append((f"v{v}", pos, r.choice(["one", "two.", "three,", "four ", "five! "]), t, t + 0.3))
            t += r.choice([0.3, 0.4, 1.4, 1.6])
        cuts.append((f"v{v}", "c", 0.0, t + 1))
    w = table(spark, words, "video_id string, pos int, text string, t0 double, t1 double")
    df = I.caption_lines(table(spark, cuts, "video_id string, cand_id string, t0 double, t1 double"), w, block=block)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "MapInPandas" not in df._jdf.queryExecution().toString()
    got = {(x.video_id, x.pos): (x.line_no, x.word_no) for x in df.collect()}
    want = {}
    for v in range(6):
        rows = [x for x in words if x[0] == f"v{v}"]
        want |= {(f"v{v}", x[1]): p for x, p in zip(rows, plain_lines([x[2:] for x in rows]), strict=True)}
    assert got == want


def test_median_of_stage_times_is_exact(spark):
    r = random.Random(3)
    runs = [(f"j{i}", {"a": float(r.randint(0, 9)), "b": r.random(), **({"c": 1.0} if i == 0 else {})}) for i in range(201)]
    df = table(spark, runs, "job_id string, t map<string,double>").selectExpr("job_id", "named_struct('timings_s', t, 'duration_processed_s', 10.0D) as run")
    per, factor = J.stage_timings(df)
    for x in per.collect():
        values = [t[x.stage] for _, t in runs if x.stage in t]
        assert (x.n_runs, x.p50_s, x.max_s) == (len(values), statistics.median(values), max(values)) and abs(x.total_s - sum(values)) < 1e-9
    assert factor.count() == 201


def test_hook_limits_look_at_the_title_once(spark):
    """Messages in order for null, empty, long and rude titles; the plan splits the title once for its words and once for their lower-cased forms."""
    rows = [("v", "a", None), ("v", "b", ""), ("v", "c", "Shit! (damn) SHIT  happens"), ("v", "d", "You Won't  Believe one two three four five six"), ("v", "e", "crappy 'gone' wrong")]
    caps = F.create_map(F.lit("tiktok"), F.lit("x"), F.lit("reels"), F.lit("x"), F.lit("shorts"), F.lit("x" * 101))
    out = I.hook_violations(spark.createDataFrame(rows, "video_id string, cand_id string, title string").withColumn("captions", caps))
    short = "shorts caption is 101 chars, max 100"
    assert {x.cand_id: x.violations for x in out.collect()} == {
        "a": [short], "b": [short], "c": ["title contains profanity: ['damn', 'shit']", short],
        "d": ["title has 9 words, max 8", "title is 46 chars, max 40", 'title contains banned phrase "you won\'t believe"', short],
        "e": ["title contains banned phrase 'gone wrong'", short]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
