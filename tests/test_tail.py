"""Growing logs: lines by byte ranges, unfinished last lines, files that appear later, resumed runs."""

import io
import random

from momentloom.operators.stored import scratch
from momentloom.streaming import streams as K
from momentloom.streaming import tail


def test_ranges_cut_anywhere_give_each_line_once(monkeypatch):
    monkeypatch.setattr(tail, "BACK", 3)
    r = random.Random(1)
    for _ in range(200):
        data = b"".join(r.choice([b"", b"a", b"longer line", b"\xc3\xa9"]) + b"\n" for _ in range(r.randint(0, 12))) + r.choice([b"", b"unfinished"])
        cuts = sorted({0, len(data), *(r.randint(0, len(data)) for _ in range(4))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in tail.lines(io.BytesIO(data), a, b)]
        assert got == data.split(b"\n")[:-1]


def _values(df):
    return sorted((r.job_id, r.value) for r in df.collect())


def test_appended_lines_are_read_on(spark, tmp_path):
    logs, run = tmp_path / "logs", scratch(spark, "tail")
    go = lambda: K.run_available(tail.tail_lines(spark, str(logs)), path=run)
    assert _values(go()) == []
    for job in ("j1", "j2"):
        (logs / job).mkdir(parents=True)
    (logs / "j1" / "a.jsonl").write_bytes(b"one\ntwo\nthr")
    (logs / "j2" / "a.jsonl").write_bytes(b"x")
    assert _values(go()) == [("j1", "one"), ("j1", "two")]
    with open(logs / "j1" / "a.jsonl", "ab") as f:
        f.write(b"ee\nfour\n\xff\n")
    with open(logs / "j2" / "a.jsonl", "ab") as f:
        f.write(b"y\n")
    (logs / "j2" / "b.jsonl").write_bytes("é\n".encode())
    want = [("j1", "four"), ("j1", "one"), ("j1", "three"), ("j1", "two"), ("j1", "�"), ("j2", "xy"), ("j2", "é")]
    assert _values(go()) == want and _values(go()) == want


def test_short_ranges_share_a_task(monkeypatch):
    monkeypatch.setattr(tail, "RANGE", 100)
    monkeypatch.setattr(tail, "OPEN", 10)
    end = {**{f"/j{i}/a": 20 for i in range(9)}, "/k/a": 250, "/l/a": 5, "/m/a": 7}
    start = {"/j0/a": 20, "/k/a": 30, "/m/a": 7}
    tasks = [p.ranges for p in tail.Tail("/").partitions(start, end)]
    assert len(tasks) == 6 and max(sum(b - a for _, a, b in t) for t in tasks) <= 100
    got = [x for t in tasks for x in t]
    assert got == [(f"/j{i}/a", 0, 20) for i in range(1, 9)] + [("/k/a", 30, 130), ("/k/a", 130, 230), ("/k/a", 230, 250), ("/l/a", 0, 5)]
    assert [p.ranges for p in tail.Tail("/").partitions(end, end)] == [[]]


def test_events_of_growing_logs(spark, tmp_path):
    (tmp_path / "j").mkdir()
    log, run = tmp_path / "j" / "agent_events.jsonl", scratch(spark, "tail")
    text = '{"agent":"scout","action":"found","payload":{"count":2}}\n\n{"agent":"qa","action":"checked","payload":{},"tokens_in":3}\n'
    log.write_text(text[:70])
    assert [(r.agent, r.action) for r in K.run_available(K.tail_agent_events(spark, str(tmp_path)), path=run).collect()] == [("scout", "found")]
    log.write_text(text)
    got = K.run_available(K.tail_agent_events(spark, str(tmp_path)), path=run).collect()
    assert sorted((r.job_id, r.agent, r.tokens_in) for r in got) == [("j", "qa", 3), ("j", "scout", 0)]
