import datetime
import os
import pathlib
import subprocess
import sys

from make import table
from pyspark.sql import Row

from momentloom.operators.stored import scratch
from momentloom.streaming import streams as K

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_tail_and_progress(spark, tmp_path):
    for job, agents in {"j1": ["scout", "qa"], "j2": ["critic", "nobody"]}.items():
        (tmp_path / job).mkdir()
        (tmp_path / job / "agent_events.jsonl").write_text("\n".join(f'{{"agent":"{a}","action":"x","payload":{{}}}}' for a in agents) + '\n{"agent":"s')
    out = K.run_available(K.stream_progress(K.stream_agent_events(spark, str(tmp_path))), "update")
    assert {r.job_id: (r.stage, r.progress) for r in out.collect()} == {"j1": ("render", 1.0), "j2": ("crew", 0.7)}


def _arrive(spark, folder, rows, ddl):
    table(spark, rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).parquet(folder)


def test_billing_is_exactly_once(spark):
    users = table(spark, [("u",)], "id string")
    ddl = "seq bigint, event_id string, type string, user_id string, amount_cents int, currency string, minutes double"
    row = lambda i, e, t="payment.succeeded", u="u": (i, e, t, u, 1999, "usd", 60.0)
    base = scratch(spark, "billing")
    before = table(spark, [("e0",), (None,)], "event_id string")
    batches = [[row(1, "e1"), row(2, "e1"), row(3, "e9", "other"), row(0, "e0"), row(8, "e7", u="later")], [row(4, "e1"), row(5, "e2")], [row(6, "e7", u="later"), row(7, "e2")]]
    for k, rows in enumerate(batches):
        known = users.union(table(spark, [("later",)], "id string")) if k == 2 else users
        stream = K.stream_billing(_arrive(spark, f"{base}/in", rows, ddl), known, before)
        K.run_available(stream, sink=K.billing_sink(f"{base}/p", f"{base}/l"), path=f"{base}/run")
    got = spark.read.parquet(f"{base}/l").collect()
    assert sorted(r.ref for r in got) == ["e1", "e2", "e7"] and sum(r.delta_minutes for r in got) == 180
    sink = K.billing_sink(f"{base}/p", f"{base}/l")
    last = spark.read.parquet(f"{base}/l").agg({"batch": "max"}).first()[0]
    sink(table(spark, [(9, "e2", "u", 1, "usd", 5.0, "purchase")], "seq bigint, event_id string, user_id string, amount_cents int, currency string, minutes double, reason string"), last)
    assert spark.read.parquet(f"{base}/l").where(f"batch = {last}").count() == 1  # a replayed batch replaces itself


def test_a_swept_job_stays_swept(spark):
    ddl = "job_id string, user_id string, status string, updated_at timestamp, seq bigint"
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    base = scratch(spark, "stale")
    files = [[("a", "u", "processing", at(0), 1), ("b", "u", "queued", at(0), 2)], [("b", "u", "done", at(20), 3), ("x", "u", "done", at(90), 4)],
             [("a", "u", "processing", at(100), 5), ("x", "u", "done", at(101), 6)], [("x", "u", "done", at(300), 7)], [("a", "u", "queued", at(400), 8), ("x", "u", "done", at(900), 9)], [("x", "u", "done", at(990), 10)]]
    out = None
    for rows in files:
        out = K.run_available(K.stream_stale_jobs(_arrive(spark, f"{base}/in", rows, ddl)), path=f"{base}/run")
    assert [(r.job_id, r.error) for r in out.collect()] == [("a", "timed out")]


def test_debits_leave_no_state_before_the_ledger(spark):
    ddl = "id bigint, seq bigint, user_id string, kind string, minutes bigint, ref string"
    base = scratch(spark, "ledger")
    files = [[(1, 1, "u", "signup_grant", 50, "g"), (2, 2, "u", "debit", 20, "j1"), (3, 3, "v", "purchase", 30, "p")],
             [(4, 4, "u", "debit", 20, "j1"), (5, 5, "v", "purchase", 30, "p"), (None, 6, "v", "debit", 10, "j2"), (None, 7, "v", "debit", 15, "j3")]]
    out = None
    for rows in files:
        out = K.run_available(K.stream_ledger(_arrive(spark, f"{base}/in", [r if r[0] is not None else (100 + r[1], *r[1:]) for r in rows], ddl)), path=f"{base}/run")
    got = sorted((r.user_id, r.id, r.verdict, r.balance_after) for r in out.collect())
    assert [g for g in got if g[2] == "accepted"] == [("u", 1, "accepted", 50), ("u", 2, "accepted", 30), ("v", 3, "accepted", 30), ("v", 106, "accepted", 20), ("v", 107, "accepted", 5)]
    states = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "landed").load(f"{base}/run/checkpoint")
    held = [tuple(r.key) for r in states.select("key").collect()]
    assert sorted(held) == [("purchase", "p"), ("signup_grant", "g")] or all("debit" not in k for k in held)


class _Store:
    """Stands in for a value or map state and counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def updateValue(self, key, value):
        self.held[key] = value


def test_ledger_asks_its_state_once_per_reference():
    p = K.GuardedLedger()
    p.balance, p.landed = _Store(), _Store()
    rows = [Row(id=i, seq=s, user_id="u", kind=k, minutes=m, ref=f) for i, s, k, m, f in (
        (5, 5, "debit", 3, "a"), (1, 1, "purchase", 4, "p"), (2, 2, "debit", 3, "a"), (3, 3, "debit", 3, "a"), (4, 4, "debit", 9, "b"), (6, 6, "debit", 1, "b"))]
    got = [tuple(r) for r in p.handleInputRows(("u",), iter(rows), None)]
    assert got == [(1, "u", "accepted", 4, 4), (2, "u", "accepted", -3, 1), (3, "u", "duplicate", 0, 1), (4, "u", "rejected", 0, 1),
                   (5, "u", "duplicate", 0, 1), (6, "u", "accepted", -1, 0)]
    assert p.landed.asked == 3 and set(p.landed.held) == {("purchase", "p"), ("debit", "a"), ("debit", "b")} and p.balance.get() == (0,)


def test_processors_run_from_another_folder(tmp_path):
    """Workers of stateful operators do not see the folder of the library; only the driver does."""
    code = f"""
import sys
sys.path[:0] = [{str(ROOT)!r}]
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.queries()["stream_stale_jobs"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
