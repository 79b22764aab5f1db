import random

from make import signals, table
from pyspark.sql import functions as F

from momentloom.operators import timeline as T
from momentloom.operators.series import as_spans


def _random(seed=3):
    rnd = random.Random(seed)
    edges = [(f"v{rnd.randint(0, 3)}", i, rnd.randint(0, 8000) / 8) for i in range(150)]
    edges = [(v, i, t, t + rnd.randint(1, 80) / 8) for v, i, t in edges]
    # one timeline holds most rows
    edges += [("v0", 1000 + i, i / 4, i / 4 + 1) for i in range(400)]
    points = [(f"v{rnd.randint(0, 4)}", i, rnd.randint(-100, 9000) / 8) for i in range(150)]
    return edges, points


def test_lookup_matches_brute_force(spark):
    edges, points = _random()
    e = table(spark, edges, "video_id string, pos int, s0 double, s1 double")
    p = table(spark, points, "video_id string, id int, t double")
    out = T.lookup(p, [
        T.Edge("a", e, "s0", F.struct("s0", "pos"), "before", tie="pos"), T.Edge("b", e, "s0", F.struct("s0", "pos"), "after", tie="pos"),
        T.Edge("c", e, "s0", "s0", "before", strict=True), T.Edge("d", e, "s0", "s0", "after", strict=True),
        T.Edge("m", e, "s0", "s1", strict=True, keep="max"), T.Edge("n", e, "s0", F.lit(1), keep="sum")]).collect()
    assert len(out) == len(points)
    for r in out:
        es = [x for x in edges if x[0] == r.video_id]
        before = [x for x in es if x[2] <= r.t]
        after = [x for x in es if x[2] >= r.t]
        a = max(before, key=lambda x: (x[2], -x[1]), default=None)
        b = min(after, key=lambda x: (x[2], x[1]), default=None)
        assert (r.a and tuple(r.a)) == (a and (a[2], a[1]))
        assert (r.b and tuple(r.b)) == (b and (b[2], b[1]))
        assert r.c == max((x[2] for x in es if x[2] < r.t), default=None)
        assert r.d == min((x[2] for x in es if x[2] > r.t), default=None)
        assert r.m == max((x[3] for x in es if x[2] < r.t), default=None)
        assert r.n == len(before)


def test_interval_joins_match_brute_force(spark):
    edges, _ = _random(5)
    e = table(spark, edges, "video_id string, pos int, s0 double, s1 double")
    wins = [(f"v{i % 4}", i, i * 7.0, i * 7.0 + (i % 9) * 6) for i in range(80)]
    w = table(spark, wins, "video_id string, id int, t0 double, t1 double")
    got = {(r.id, r.pos) for r in T.overlapping(w, e, width=16.0).collect()}
    want = {(a[1], b[1]) for a in wins for b in edges if a[0] == b[0] and b[2] < a[3] and b[3] > a[2]}
    assert got == want
    near = T.nearest_span(w.select("video_id", "id", F.col("t0").alias("t")), e, width=1.0).collect()
    for r in near:
        es = [x for x in edges if x[0] == r.video_id]
        dist = lambda x: 0.0 if x[2] <= r.t <= x[3] else min(abs(x[2] - r.t), abs(x[3] - r.t))  # noqa: B023, E731
        best = min(es, key=lambda x: (dist(x), x[1]))
        assert (r.near.dist, r.near.pos) == (dist(best), best[1])


def test_hand_built_lookups(spark):
    sig = signals(spark, 90, words=[("hello", 0.0, 0.4), ("world", 0.5, 0.9)], peaks=[(60.0, 3.0), (10.0, 2.2)], events=[("laughter", 45, 47, 0.1)],
                  silence=[(29.4, 32.1), (80.0, 82.0)], scene=[(0, 20), (20, 40), (40, 70)])
    win = lambda a, b: table(spark, [("v", float(a), float(b))], "video_id string, t0 double, t1 double")
    at = lambda t: table(spark, [("v", float(t))], "video_id string, t double")
    assert T.points_in(win(59, 61), sig.peaks).count() == 1
    assert T.nearest_span(at(30), as_spans(sig.kind("silence"), "pos")).first().near.s0 == 29.4
    words = as_spans(sig.words, "pos", "text")
    assert T.stab_first(at(0.2), words).first().hit.text == "hello"
    assert T.stab_first(at(5), words).first().hit is None
    assert T.overlapping(win(0, 1), words).count() == 2
    scenes = as_spans(sig.kind("scene"), "pos")
    assert T.stab_first(at(25), scenes).first().hit.s0 == 20.0
    assert T.stab_first(at(20), scenes).first().hit.s0 == 0.0
    assert T.stab_first(at(85), scenes).first().hit is None
    ev = as_spans(sig.events, "label")
    assert T.events_in(win(44, 48), ev).count() == 1
    assert T.events_in(win(44, 48), ev, "applause").count() == 0


def _pairs_of_levels(spark, wins, spans, width):
    w = table(spark, wins, "video_id string, id int, t0 double, t1 double")
    s = table(spark, spans, "video_id string, pos int, s0 double, s1 double")
    got = sorted((r.id, r.pos) for r in T.overlapping(w, s, width=width).collect())
    assert got == sorted((a[1], b[1]) for a in wins for b in spans if a[0] == b[0] and b[2] < a[3] and b[3] > a[2])
    points = table(spark, [(v, i, t0) for v, i, t0, _ in wins], "video_id string, id int, t double")
    held = sorted((r.id, r.pos) for r in T.straddlers(points, s, width=width).collect())
    assert held == sorted((a[1], b[1]) for a in wins for b in spans if a[0] == b[0] and b[2] < a[2] < b[3])
    first = {(r.video_id, r.id): r.hit and r.hit.pos for r in T.stab_first(points, s, width=width).collect()}
    assert first == {(a[0], a[1]): min((b[1] for b in spans if a[0] == b[0] and b[2] <= a[2] <= b[3]), default=None) for a in wins}


def test_spans_of_all_lengths_match_brute_force(spark):
    """Lengths over eight orders of magnitude on both sides, exact cell edges, points, spans turned round, missing times."""
    rnd = random.Random(11)
    length = lambda: rnd.choice([0.0, 0.5, 1.0, 4.0, 16.0, 64.0, 1000.0, 4096.0, 2.6e6]) * rnd.choice([1, 1, 0.999, 1.001])
    span = lambda t: (t, t + length())
    wins = [(f"v{i % 3}", i, *span(rnd.choice([rnd.uniform(-3e3, 3e3), rnd.randint(-50, 50) * 64.0, rnd.uniform(0, 2e6)]))) for i in range(120)]
    spans = [(f"v{i % 3}", i, *span(rnd.choice([rnd.uniform(-3e3, 3e3), rnd.randint(-50, 50) * 64.0, rnd.uniform(0, 2e6)]))) for i in range(120)]
    for width in (0.5, 64.0):
        _pairs_of_levels(spark, wins, spans, width)
    _pairs_of_levels(spark, wins, [], 64.0)
    short = [(v, i, t, t + 0.1) for v, i, t, _ in spans]
    _pairs_of_levels(spark, wins, short, 1.0)


def test_a_month_costs_as_few_rows_as_a_second(spark):
    """Rows filed for one span: two cells at its own level, whatever its length, and two per level in use for its partners."""
    month = 30 * 86400.0
    spans = table(spark, [("v", i, 10.0 * i, 10.0 * i + 5.0) for i in range(2000)] + [("v", 9999, 3.0, 3.0 + month)], "video_id string, pos int, s0 double, s1 double")
    own = spans.withColumn("_own", T.level_of("s0", "s1", 64.0))
    filed = T._cells(own, F.array(F.struct(F.col("_own").alias("level"), F.lit(0).alias("side"))), "s0", "s1", 64.0)
    assert filed.where("pos = 9999").count() <= 2 and filed.count() <= 2 * 2001
    wins = table(spark, [("v", 1, 50.0, 60.0), ("v", 2, 1000.0, 1000.0 + month), ("v", 3, month - 1, month)], "video_id string, id int, t0 double, t1 double")
    got = T.overlapping(wins, spans).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 2, 2: 1901, 3: 1}


def test_a_busy_second_is_parted(spark):
    """One key and one second hold most rows: buckets follow the data, and what they inherit is right."""
    rnd = random.Random(13)
    edges = [("hot", i, 500.0 + rnd.random(), rnd.random()) for i in range(4000)] + [("hot", 5000 + i, i * 10.0, 0.5) for i in range(300)] + [(f"v{i % 40}", 9000 + i, float(i), 0.1) for i in range(400)]
    points = [("hot", i, rnd.choice([500.0 + rnd.random(), rnd.uniform(0, 3000)])) for i in range(1500)] + [(f"v{i % 40}", 2000 + i, float(i)) for i in range(100)] + [("hot", 9999, None)]
    e = table(spark, edges, "video_id string, pos int, s0 double, value double")
    p = table(spark, points, "video_id string, id int, t double")
    times = e.select("video_id", F.col("s0").alias("_t")).union(p.select("video_id", F.col("t").alias("_t")))
    cuts = T.cut_points(times, ["video_id"], 400)
    assert [r.video_id for r in cuts.collect()] == ["hot"]
    sizes = [r["count"] for r in T.dealt(times.where("video_id = 'hot' and _t is not null"), cuts, ["video_id"]).groupBy("_b").count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    out = T.lookup(p, [T.Edge("a", e, "s0", F.struct("s0", "pos"), "before", tie="pos"), T.Edge("b", e, "s0", "s0", "after", strict=True),
                       T.Edge("n", e, "s0", F.lit(1), keep="sum"), T.Edge("m", e, "s0", "value", strict=True, keep="max")], depth=400).collect()
    assert len(out) == len(points)
    for r in out:
        es = [x for x in edges if x[0] == r.video_id and r.t is not None]
        a = max((x for x in es if x[2] <= r.t), key=lambda x: (x[2], -x[1]), default=None)
        assert (r.a and tuple(r.a)) == (a and (a[2], a[1])) and r.n == sum(x[2] <= r.t for x in es)
        assert r.b == min((x[2] for x in es if x[2] > r.t), default=None)
        assert r.m == max((x[3] for x in es if x[2] < r.t), default=None)


def test_rows_at_one_time_and_empty_sides(spark):
    e = table(spark, [("v", i, 5.0) for i in range(900)], "video_id string, pos int, s0 double")
    p = table(spark, [("v", i, 4.0 + i % 3) for i in range(30)], "video_id string, id int, t double")
    out = T.lookup(p, [T.Edge("n", e, "s0", F.lit(1), keep="sum"), T.Edge("first", e, "s0", "pos", "after", tie="pos")], depth=100).collect()
    assert {(r.t, r.n, r.first) for r in out} == {(4.0, 0, 0), (5.0, 900, 0), (6.0, 900, None)}
    assert T.lookup(p.limit(0), [T.Edge("n", e, "s0", "s0")], depth=1).collect() == []
    assert {r.n for r in T.lookup(p, [T.Edge("n", e.limit(0), "s0", "s0")], depth=1).collect()} == {None}


def test_edges_before_are_not_sorted_back(spark):
    """Of edges on both sides, only points and edges after them take part in the scan from the end."""
    e = table(spark, [("v", i, float(i)) for i in range(50)], "video_id string, pos int, s0 double")
    p = table(spark, [("v", i, i + 0.5) for i in range(-1, 50)], "video_id string, id int, t double")
    out = T.lookup(p, [T.Edge("a", e, "s0", "s0"), T.Edge("b", e, "s0", "s0", "after"), T.Edge("c", e, "s0", "pos", "after")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in x and "isnotnull(_p" in x and " OR " in x for x in plan.splitlines())
    assert {(r.id, r.a, r.b, r.c) for r in out.collect()} == {(i, float(i) if i >= 0 else None, i + 1.0 if i < 49 else None, i + 1 if i < 49 else None) for i in range(-1, 50)}
