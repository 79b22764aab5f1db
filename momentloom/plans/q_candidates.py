"""Queries over candidate generation, scoring and selection."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from momentloom.operators import candidates as C
from momentloom.operators import scoring as S
from momentloom.plans import derive as D
from momentloom.plans.registry import query, with_
from momentloom.sources import replies as R

# The reference's seconds become minutes on the event clock: all limits times 60.
REACH, WINDOW, MIN_LEN, MAX_LEN = 300.0, 1200.0, 1800.0, 5400.0
LEAD, LEAD_WINDOW, TAIL, SCENE, HOP, WIDTH = 480.0, 1200.0, 180.0, 1200.0, 3600.0, 600.0
GATE = dict(slack=120.0, peak_time=30.0, peak_sigma=0.5, event_time=60.0, silence_time=30.0, scene_len=900.0, width=WIDTH)

rule_a = partial(C.rule_energy_rate, reach=REACH, window=WINDOW, min_len=MIN_LEN, max_len=MAX_LEN)
rule_b = partial(C.rule_event_leadup, lead=LEAD, window=LEAD_WINDOW, tail=TAIL, min_len=MIN_LEN, max_len=MAX_LEN, width=WIDTH)
rule_c = partial(C.rule_scene_variance, hop_s=HOP, scene_len=SCENE, min_len=MIN_LEN, max_len=MAX_LEN, width=WIDTH)
RULES = (rule_a, rule_b, rule_c)


def clamp_sql(src: str, cols: str, lo=MIN_LEN, hi=MAX_LEN) -> str:
    """Windows of ``src`` (``cols, r0, r1, dur``) cut to media and length bounds."""
    return f"""
        SELECT {cols}, part,
               CASE WHEN b - a < {lo} THEN greatest(0, a - ({lo} - (b - a)) / 2) WHEN n > 1 THEN a + part * ((b - a) / n) ELSE a END AS t0,
               CASE WHEN b - a < {lo} THEN least(dur, b + ({lo} - (b - a)) / 2) WHEN n > 1 THEN a + (part + 1) * ((b - a) / n) ELSE b END AS t1
        FROM (SELECT *, CASE WHEN b - a > {hi} THEN CAST(ceil((b - a) / {hi}) AS INT) ELSE 1 END AS n FROM (
                SELECT *, greatest(0, r0) AS a, least(dur, r1) AS b FROM {src}) WHERE b > a) x,
             LATERAL (SELECT unnest(range(0, x.n)) AS part) g"""


_NEAR = f"""SELECT s.video_id, s.pos AS surge, s.t0 AS surge_t0, p.t AS peak_t, p.sigma, p.t - {WINDOW} AS r0, p.t + {WINDOW} AS r1, m.duration_s AS dur
    FROM surges s JOIN media_t m ON m.video_id = s.video_id JOIN peaks p ON p.video_id = s.video_id AND p.t BETWEEN s.t0 - {REACH} AND s.t1 + {REACH}
    QUALIFY row_number() OVER (PARTITION BY s.video_id, s.pos ORDER BY abs(p.t - (s.t0 + s.t1) / 2), p.pos) = 1"""
_RULE_A = dict(near=_NEAR, ra=clamp_sql("near", "video_id, surge, surge_t0, peak_t, sigma"))


@query(with_("surges", "peaks", **_RULE_A) + "SELECT video_id, surge, surge_t0, peak_t, sigma, t0, t1 FROM ra")
def rule_energy_rate(spark, d):
    out = rule_a(D.tick_signals(spark, d, ("surge",), False))
    e = lambda i: F.get("evidence", F.lit(i))
    return out.select("video_id", F.col("o1").cast("bigint").alias("surge"), e(1)["t"].alias("surge_t0"), e(0)["t"].alias("peak_t"),
                      e(0)["value_num"].alias("sigma"), "t0", "t1")


@query(with_("surges", "peaks", **_RULE_A) + """SELECT video_id, rn - 1 AS place, t0, t1, peak_t, sigma FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t0, surge, part) AS rn FROM ra) WHERE rn <= 20""")
def energy_rate_windows(spark, d):
    """Flagship: words-and-energy style windows, best 20 per timeline."""
    out = C.top_candidates(rule_a(D.tick_signals(spark, d, ("surge",), False)))
    e = F.get("evidence", F.lit(0))
    return out.select("video_id", F.col("pos").alias("place"), "t0", "t1", e["t"].alias("peak_t"), e["value_num"].alias("sigma"))


_RULE_B = dict(
    lead=f"""SELECT e.video_id, e.pos, e.label, e.t0 AS e0, e.t0 - {LEAD_WINDOW} AS r0, e.t1 + {TAIL} AS r1, e.conf, m.duration_s AS dur,
        sum(least(k.t1, e.t0) - greatest(k.t0, e.t0 - {LEAD})) AS spoken FROM sevents e JOIN media_t m ON m.video_id = e.video_id JOIN talk k
        ON k.video_id = e.video_id AND k.t0 < e.t0 AND k.t1 > e.t0 - {LEAD} WHERE e.t0 < m.duration_s AND e.t1 > 0
        GROUP BY ALL HAVING spoken >= {LEAD}""",
    rb=clamp_sql("lead", "video_id, pos, label, e0, conf"))


@query(with_("sevents", "talk", **_RULE_B) + "SELECT video_id, label, e0, conf, t0, t1 FROM rb")
def rule_event_leadup(spark, d):
    out = rule_b(D.tick_signals(spark, d, ("speech",), False))
    e = F.get("evidence", F.lit(0))
    return out.select("video_id", e["kind"].alias("label"), F.col("o1").alias("e0"), e["value_num"].alias("conf"), "t0", "t1")


_DECILE = """SELECT video_id, round((xs[j] * (10 - d) + xs[j + 1] * d) / 10, 6) AS bar, (xs[j] * (10 - d) + xs[j + 1] * d) / 10 AS raw FROM (
    SELECT *, 9 * (n + 1) - j * 10 AS d FROM (SELECT *, least(greatest(9 * (n + 1) // 10, 1), n - 1) AS j FROM (
    SELECT video_id, list(v ORDER BY v) AS xs, count(*) AS n FROM pitch WHERE v > 0 GROUP BY 1) WHERE n >= 2))"""


@query(with_("pitch", dec=_DECILE) + "SELECT video_id, bar FROM dec")
def decile_bar(spark, d):
    return C.decile_bar(D.pitch(D.ticks(spark, d))).select("video_id", F.round("bar", 6).alias("bar"))


_RULE_C = dict(
    dec=_DECILE,
    loud=f"""SELECT s.video_id, s.pos, s.t0 AS scene_t0, s.t0 AS r0, s.t1 AS r1, m.duration_s AS dur, avg(p.v) AS mean FROM scenes s JOIN media_t m ON m.video_id = s.video_id JOIN pitch p
        ON p.video_id = s.video_id AND p.i >= floor(s.t0 / {HOP}) AND p.i < greatest(floor(s.t0 / {HOP}) + 1, floor(s.t1 / {HOP}))
        WHERE s.t1 - s.t0 >= {SCENE} GROUP BY ALL""",
    lc="SELECT l.* FROM loud l JOIN dec USING (video_id) WHERE mean >= raw",
    rc=clamp_sql("lc", "video_id, pos, scene_t0, mean"))


@query(with_("scenes", "pitch", **_RULE_C) + "SELECT video_id, pos AS scene, part, t0, t1, round(mean, 6) AS mean FROM rc")
def rule_scene_variance(spark, d):
    out = rule_c(D.tick_signals(spark, d, ("scene",)))
    return out.select("video_id", F.col("o1").cast("bigint").alias("scene"), "part", "t0", "t1",
                      F.round(F.get("evidence", F.lit(0))["value_num"], 6).alias("mean"))


@query("WITH m AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS dur, n_chars * 0.25::DOUBLE - 20 AS r0, n_chars * 0.75::DOUBLE + (doc_id % 8) * 5 AS r1 FROM documents)"
       + clamp_sql("m", "doc_id", 30.0, 90.0))
def clamp_windows(spark, d):
    m = D.read(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("duration_s"), (F.col("n_chars") * 0.25 - 20).alias("r0"),
        (F.col("n_chars") * 0.75 + F.col("doc_id") % 8 * 5).alias("r1"))
    return C.clamp_windows(m).select("doc_id", "part", "t0", "t1")


_UNION = dict(u="""SELECT video_id, 0 AS rule_rank, surge::DOUBLE AS o1, 0::BIGINT AS o2, part, t0, t1, 2 AS n_evidence FROM ra
                     UNION ALL SELECT video_id, 1, e0, CASE label WHEN 'laughter' THEN 0 ELSE 1099511627776 END + pos, part, t0, t1, 1 FROM rb""")
_RANKED = with_("surges", "peaks", "sevents", "talk", **_RULE_A, **_RULE_B, **_UNION)


# The greedy pass as a recursion over the candidates of each timeline.
_KEPT = "STRUCT(rule_rank INT, o1 DOUBLE, o2 BIGINT, part INT, t0 DOUBLE, t1 DOUBLE, ne INT, src INT)"
_INTER = "(least(y.t1, x.t1) - greatest(y.t0, x.t0))"
_FOLD = dict(
    num="SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rule_rank, o1, o2, part) AS n FROM u",
    fold=f"""SELECT DISTINCT video_id, 0::BIGINT AS n, []::{_KEPT}[] AS kept FROM num UNION ALL
        SELECT video_id, n, CASE WHEN hit IS NULL THEN list_append(kept, c) WHEN c.ne > kept[hit].ne THEN list_concat(list_concat(kept[1:hit - 1],
            [struct_pack(rule_rank := kept[hit].rule_rank, o1 := kept[hit].o1, o2 := kept[hit].o2, part := kept[hit].part, t0 := c.t0, t1 := c.t1, ne := c.ne, src := c.src)::{_KEPT}]), kept[hit + 1:]) ELSE kept END
        FROM (SELECT f.video_id, x.n, f.kept, struct_pack(rule_rank := x.rule_rank, o1 := x.o1, o2 := x.o2, part := x.part, t0 := x.t0, t1 := x.t1, ne := x.n_evidence, src := x.rule_rank)::{_KEPT} AS c,
                     nullif(list_position(list_transform(f.kept, lambda y: {_INTER} > 0 AND {_INTER} / ((y.t1 - y.t0) + (x.t1 - x.t0) - {_INTER}) > 0.5), true), 0) AS hit
              FROM fold f JOIN num x ON x.video_id = f.video_id AND x.n = f.n + 1)""",
    kept="SELECT video_id, unnest(arg_max(kept, n)) AS k FROM fold GROUP BY 1")
_SOURCES = "['rule_a_energy_rate', 'rule_b_laughter', 'rule_c_scene_pitch'][k.src + 1]"


@query(with_("surges", "peaks", "sevents", "talk", **_RULE_A, **_RULE_B, **_UNION, **_FOLD) + f"""SELECT video_id, k.rule_rank, k.o1, k.o2, k.part, k.t0, k.t1,
    {_SOURCES} AS source, k.ne AS n_evidence FROM kept""")
def dedupe_windows(spark, d):
    sig = D.tick_signals(spark, d, ("surge", "speech"), False)
    out = C.dedupe_windows(rule_a(sig).unionByName(rule_b(sig)))
    return out.select("video_id", "rule_rank", "o1", "o2", "part", "t0", "t1", "source", F.size("evidence").alias("n_evidence"))


@query(_RANKED + """SELECT video_id, rn - 1 AS place, rule_rank, t0, t1, n_evidence FROM (SELECT *, row_number() OVER (
    PARTITION BY video_id ORDER BY n_evidence DESC, t0, rule_rank, o1, o2, part) AS rn FROM u) WHERE rn <= 20""")
def top_candidates(spark, d):
    sig = D.tick_signals(spark, d, ("surge", "speech"), False)
    out = C.top_candidates(rule_a(sig).unionByName(rule_b(sig)))
    rank = F.when(F.col("source") == "rule_a_energy_rate", 0).otherwise(1)
    return out.select("video_id", F.col("pos").alias("place"), rank.alias("rule_rank"), "t0", "t1", F.size("evidence").alias("n_evidence"))


def _proposed(spark, d):
    sig = D.tick_signals(spark, d)
    return sig, D.settle(C.propose(sig, RULES))


_UNION3 = dict(u=_UNION["u"] + " UNION ALL SELECT video_id, 2, pos::DOUBLE, 0::BIGINT, part, t0, t1, 1 FROM rc")


@query(with_("surges", "peaks", "sevents", "talk", "scenes", "pitch", **_RULE_A, **_RULE_B, **_RULE_C, **_UNION3, **_FOLD) + f"""
    SELECT video_id, video_id || '-' || lpad(CAST(rn - 1 AS VARCHAR), 3, '0') AS cand_id, rn - 1 AS pos, k.t0, k.t1, {_SOURCES} AS source, k.ne AS n_evidence FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k.ne DESC, k.t0, k.rule_rank, k.o1, k.o2, k.part) AS rn FROM kept) WHERE rn <= 20""")
def propose(spark, d):
    _, out = _proposed(spark, d)
    return out.select("video_id", "cand_id", "pos", "t0", "t1", "source", F.size("evidence").alias("n_evidence"))


@query(with_("talk", "media_t", s="SELECT video_id, t0, t1, sum(t1 - t0) OVER (PARTITION BY video_id ORDER BY t0 RANGE UNBOUNDED PRECEDING) AS upto FROM talk",
             tot="SELECT video_id, sum(t1 - t0) AS total, arg_max(t1, t0) AS last FROM talk GROUP BY 1",
             v="SELECT m.video_id, m.duration_s AS dur, k, tot.total, tot.last, (k + 0.5) * coalesce(tot.total, m.duration_s) / 4 AS v FROM media_t m LEFT JOIN tot USING (video_id) CROSS JOIN (SELECT unnest(range(0, 4)) AS k)",
             mid="""SELECT v.video_id, v.k, v.dur, CASE WHEN v.total IS NULL THEN v.v ELSE coalesce(
                    (SELECT arg_min(s.t0 + v.v - (s.upto - (s.t1 - s.t0)), s.upto) FROM s WHERE s.video_id = v.video_id AND s.upto >= v.v), v.last) END AS mid FROM v""",
             w1="SELECT video_id, k, dur, mid - 900 AS lo, mid + 900 AS hi FROM mid",
             w2="SELECT video_id, k, dur, greatest(lo, 0) AS lo, CASE WHEN lo < 0 THEN hi - lo ELSE hi END AS hi FROM w1",
             w3="SELECT video_id, k, greatest(0, lo - greatest(hi - dur, 0)) AS t0, least(hi, dur) AS t1 FROM w2",
             ) + """, f AS (SELECT video_id, -1 AS k, []::STRUCT(t0 DOUBLE, t1 DOUBLE)[] AS kept FROM media_t
    UNION ALL SELECT f.video_id, f.k + 1, CASE WHEN list_bool_or(list_transform(f.kept, lambda y: least(y.t1, w.t1) > greatest(y.t0, w.t0) AND
        (least(y.t1, w.t1) - greatest(y.t0, w.t0)) / ((y.t1 - y.t0) + (w.t1 - w.t0) - (least(y.t1, w.t1) - greatest(y.t0, w.t0))) > 0.5))
        THEN f.kept ELSE list_append(f.kept, {'t0': w.t0, 't1': w.t1}) END FROM f JOIN w3 w ON w.video_id = f.video_id AND w.k = f.k + 1)
    SELECT video_id, unnest(kept).t0 AS t0, unnest(kept).t1 AS t1 FROM f WHERE k = 3""")
def fallback_windows(spark, d):
    return C.fallback_windows(D.tick_signals(spark, d, ("speech",), False), 4, span=MIN_LEN).select("video_id", "t0", "t1")


# --- scoring ------------------------------------------------------------------------------------------


_CLAIMED = """SELECT CAST(o_orderkey AS VARCHAR) AS cand_id, CAST(o_custkey AS VARCHAR) AS video_id, count(l_orderkey) AS n
              FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def _claimed(spark, d):
    """Candidates with any number of claims: one order is one window, its lines are claims."""
    o, li = D.read(spark, d, "orders"), D.read(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("int")
    start = (F.col("o_orderkey") % 500).cast("double") * 8
    claims = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: C.claim("energy_peak", start + i, (F.col("o_orderkey") % 13 + i) * 1.0))
    return o.join(per, o.o_orderkey == per.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").cast("string").alias("cand_id"), F.col("o_orderkey").alias("pos"),
        start.alias("t0"), (start + 40).alias("t1"), F.lit("rule").alias("source"), F.lit("").alias("notes"), F.slice(claims, F.lit(1), n).alias("evidence"))


@query(f"""WITH c AS ({_CLAIMED}), t AS (SELECT *, least(90, 15 * n) AS total FROM c)
    SELECT video_id, cand_id, total, CASE WHEN total >= 62 THEN 'keep' WHEN total <= 45 THEN 'kill' ELSE 'borderline' END AS verdict,
           total // 4 + CASE WHEN total % 4 > 0 THEN 1 ELSE 0 END AS hook_strength, total // 4 + CASE WHEN total % 4 > 1 THEN 1 ELSE 0 END AS payoff,
           total // 4 + CASE WHEN total % 4 > 2 THEN 1 ELSE 0 END AS emotion, total // 4 AS quotability FROM t""")
def evidence_score(spark, d):
    out = S.evidence_score(_claimed(spark, d))
    return out.select("video_id", "cand_id", "total", "verdict", *[F.col("components")[p]["score"].alias(p) for p in S.PARTS])


_ROUND1 = dict(
    c=_CLAIMED,
    w="SELECT *, (CAST(cand_id AS BIGINT) % 500) * 8.0 AS t0, (CAST(cand_id AS BIGINT) % 500) * 8.0 + 40 AS t1, least(90, 15 * n) AS total FROM c",
    keep1="SELECT * FROM w WHERE total >= 62")


def _rounds(spark, d):
    cands = _claimed(spark, d)
    return S.run_rounds(cands, S.evidence_score)


@query(with_(**_ROUND1, again="SELECT DISTINCT video_id FROM w WHERE total > 45 AND total < 62",
             fresh="""SELECT * FROM w WHERE video_id IN (FROM again) AND NOT EXISTS (SELECT 1 FROM keep1 k WHERE k.video_id = w.video_id AND least(k.t1, w.t1) > greatest(k.t0, w.t0)
                      AND (least(k.t1, w.t1) - greatest(k.t0, w.t0)) / (80 - (least(k.t1, w.t1) - greatest(k.t0, w.t0))) > 0.5)""",
             every="SELECT *, 0 AS round FROM w UNION ALL SELECT *, 1 FROM fresh") + """
    SELECT video_id, round, count(*) AS n_scored, count(*) FILTER (total >= 62) AS n_keep, sum(total)::BIGINT AS total FROM every GROUP BY 1, 2""")
def run_rounds(spark, d):
    _, every = _rounds(spark, d)
    return every.groupBy("video_id", "round").agg(
        F.count("*").alias("n_scored"), F.count_if(F.col("verdict") == "keep").alias("n_keep"), F.sum("total").alias("total"))


@query(with_(**_ROUND1) + """SELECT video_id, cand_id, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY total DESC, CAST(cand_id AS BIGINT)) AS place
    FROM keep1) WHERE place <= 8""")
def select_clips(spark, d):
    one = S.evidence_score(_claimed(spark, d)).withColumn("round", F.lit(0))
    return S.select_clips(S.keepers_in_order(one)).select("video_id", "cand_id", F.col("clip_index").alias("place"))


@query(with_("media_t", **_ROUND1,
             nokeep="SELECT * FROM w WHERE video_id NOT IN (SELECT video_id FROM keep1)",
             uniq="SELECT * FROM nokeep QUALIFY row_number() OVER (PARTITION BY video_id, t0, t1 ORDER BY CAST(cand_id AS BIGINT) DESC) = 1") + """
    SELECT video_id, cand_id, place FROM (SELECT video_id, cand_id, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, t0) - 1 AS place FROM uniq) WHERE place < 4""")
def best_effort(spark, d):
    one = S.evidence_score(_claimed(spark, d)).withColumn("round", F.lit(0))
    videos = one.select("video_id").distinct().withColumn("duration_s", F.lit(4000.0)).withColumn("language", F.lit("en"))
    spans = videos.select("video_id", F.lit("speech").alias("kind"), F.lit(0).alias("pos"), F.lit(0.0).alias("t0"), F.lit(100.0).alias("t1"))
    out = S.best_effort(one, S.Signals(media=videos, spans=spans))
    return out.select("video_id", "cand_id", "place")


@query(f"""WITH c AS ({_CLAIMED}) SELECT video_id, cand_id, CASE WHEN n = 0 THEN ['emotion', 'hook_strength', 'payoff', 'quotability'] ELSE ['emotion'] END AS voided FROM c""")
def voided_components(spark, d):
    return S.voided_components(_voided(spark, d))


def _voided(spark, d):
    """Scored candidates whose ``emotion`` part lost its evidence."""
    scored = S.evidence_score(_claimed(spark, d))
    gone = F.transform_values("components", lambda k, c: F.when(
        k == "emotion", F.struct(F.lit(0).alias("score"), F.slice(c.evidence, 1, 0).alias("evidence"))).otherwise(c))
    return scored.withColumn("components", gone)


@query(f"""WITH c AS ({_CLAIMED}), t AS (SELECT *, least(90, 15 * n) AS total FROM c)
    SELECT video_id, cand_id, 'hook_strength' AS top_component, total // 4 + CASE WHEN total % 4 > 0 THEN 1 ELSE 0 END AS top_score FROM t""")
def top_component(spark, d):
    return S.top_component(_voided(spark, d))


# --- stored replies -----------------------------------------------------------------------------------


def _replies(spark, d, body):
    """Two stored replies per order: ``body(attempt)`` is the JSON text, wrapped or spoiled by order number."""
    o = D.read(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").cast("string").alias("cand_id"), F.col("o_orderkey").alias("k"),
        "o_totalprice", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    text = body(F.col("k"), F.col("attempt"))
    shape = F.pmod(F.col("k") + F.col("attempt"), F.lit(5))
    raw = (F.when(shape == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
           .when(shape == 1, F.concat(F.lit("Here you go: "), text, F.lit(" - hope it helps")))
           .when(shape == 2, F.lit("no json today")).when(shape == 3, F.substring(text, 1, 12)).otherwise(text))
    return o.select("video_id", "cand_id", "k", "attempt", raw.alias("raw"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS k, o_totalprice AS p, (o_orderkey + 1) % 5 AS s1, (o_orderkey + 2) % 5 AS s2 FROM orders)
    SELECT CAST(o_custkey AS VARCHAR) AS video_id, CAST(k AS VARCHAR) AS cand_id,
           CASE WHEN s1 NOT IN (2, 3) THEN 1 WHEN s2 NOT IN (2, 3) THEN 2 END AS attempt,
           CASE WHEN s1 NOT IN (2, 3) OR s2 NOT IN (2, 3) THEN k END AS n, 2 AS n_attempts FROM o""")
def parse_model_replies(spark, d):
    raw = _replies(spark, d, lambda k, a: F.concat(F.lit('{"title": "t", "items": [1, 2], "n": '), k.cast("string"), F.lit("}")))
    out = R.parse_model_replies(raw, ["title", "items"], {"title": "string", "items": "array", "n": "number"}, ["video_id", "cand_id"])
    return out.select("video_id", "cand_id", "attempt", F.get_json_object("reply", "$.n").cast("bigint").alias("n"), "n_attempts")


def _proposal_replies(spark, d, tag):
    """One reply per peak with two proposals around it: a sound one and one that does not hold."""
    pk = D.peaks(D.ticks(spark, d))
    num = lambda c: c.cast("string")
    t, s = F.col("t"), F.col("sigma")
    claim = lambda t_, v: F.concat(F.lit('{"kind":"energy_peak","t":'), num(t_), F.lit(',"value":'), num(v), F.lit("}"))
    good = F.concat(F.lit('{"t0":'), num(t - 900), F.lit(',"t1":'), num(t + 900), F.lit(',"reason":"spike","evidence":['), claim(t, s), F.lit("]}"))
    off = F.concat(F.lit('{"t0":'), num(t - 600), F.lit(',"t1":'), num(t + 600), F.lit(',"evidence":['), claim(t + (0 if tag == 2 else 45), s + 40), F.lit("]}"))
    bad = F.lit('{"t0":"1","t1":2,"evidence":[]}')
    odd = F.lit('{"t0":1,"t1":2,"evidence":[{"kind":1,"t":2}]}')
    text = F.concat(F.lit('{"candidates":['), F.concat_ws(",", good, off, bad, odd), F.lit("]}"))
    return pk.select("video_id", F.col("pos").alias("chunk"), text.alias("reply"))


@query(with_("peaks", "media_t",
             g="SELECT video_id, pos, t - 900 AS r0, t + 900 AS r1, duration_s AS dur, unnest([1, 2]) AS round FROM peaks JOIN media_t USING (video_id)",
             w=clamp_sql("g", "video_id, pos, round")) + "SELECT video_id, pos, round, t0, t1, 'spike' AS notes FROM w")
def admit_proposals(spark, d):
    sig = D.tick_signals(spark, d, ("surge",), False)
    ok, _ = C.admit_proposals(_proposal_replies(spark, d, 1), sig, _proposal_replies(spark, d, 2), MIN_LEN, MAX_LEN, **GATE)
    pos = F.floor((F.col("o1") - 1) / 2)
    return ok.select("video_id", pos.alias("pos"), (F.col("o1") - 2 * pos).cast("int").alias("round"), "t0", "t1", "notes")


@query(with_("peaks") + """SELECT video_id, pos, x.round, x.seq, x.reason FROM peaks, (VALUES (1, 2, 'malformed t0/t1'), (1, 3, 'malformed evidence entry'),
    (2, 2, 'malformed t0/t1'), (2, 3, 'malformed evidence entry'), (2, 1, 'no energy peak within 30.0s')) x(round, seq, reason)""")
def rejected_proposals(spark, d):
    sig = D.tick_signals(spark, d, ("surge",), False)
    _, no = C.admit_proposals(_proposal_replies(spark, d, 1), sig, _proposal_replies(spark, d, 2), MIN_LEN, MAX_LEN, **GATE)
    short = F.when(F.col("reason").startswith("no energy"), F.substring("reason", 1, 27)).otherwise(F.col("reason"))
    return no.select("video_id", F.col("chunk").alias("pos"), "round", "seq", short.alias("reason"))


@query(with_("peaks") + """
    SELECT video_id, pos, CASE pos % 4 WHEN 0 THEN 60 WHEN 1 THEN 70 WHEN 2 THEN 45 ELSE 15 END AS total,
           CASE pos % 4 WHEN 0 THEN 'borderline' WHEN 1 THEN 'keep' ELSE 'kill' END AS verdict FROM peaks""")
def score_components(spark, d):
    """Replies per peak: emotion fails in the first reply of every peak; what the second one offers depends on the peak."""
    sig = D.tick_signals(spark, d, ("surge",), False)
    pk = D.peaks(D.ticks(spark, d))
    cands = pk.select("video_id", F.col("pos").cast("string").alias("cand_id"), "pos", (F.col("t") - 600).alias("t0"), (F.col("t") + 600).alias("t1"),
                      F.array(C.claim("energy_peak", F.col("t"), F.col("sigma"))).alias("evidence"), F.col("sigma"), F.col("t"))
    num = lambda c: c.cast("string")
    claim = lambda v: F.concat(F.lit('[{"kind":"energy_peak","t":'), num(F.col("t")), F.lit(',"value":'), num(v), F.lit("}]"))
    part = lambda n, s, ev: F.concat(F.lit(f'"{n}":{{"score":'), F.lit(s), F.lit(',"evidence":'), ev, F.lit("}"))
    s = F.col("sigma")
    first = F.concat(F.lit('{"components":{'), F.concat_ws(",", part("hook_strength", "40", claim(s)), part("payoff", "20.9", claim(s)),
                     part("emotion", "25", claim(s + 90)), part("quotability", '"x"', claim(s))), F.lit("}}"))
    case = F.pmod("pos", F.lit(4))
    # 0: second emotion holds with 15; 1: holds with 30, cut to 25, quotability stays 0; 2: fails again; 3: second reply unreadable
    second = F.concat(F.lit('{"components":{'), F.when(case == 0, part("emotion", "15", claim(s))).when(case == 1, part("emotion", "30", claim(s))).otherwise(
        part("emotion", "25", F.lit("[]"))), F.lit("}}"))
    rows = cands.select("video_id", "cand_id", F.inline(F.array(
        F.struct(F.lit(1).alias("attempt"), first.alias("reply")),
        F.struct(F.lit(2).alias("attempt"), F.when(case == 3, F.lit("oops")).otherwise(second).alias("reply")))))
    plain = cands.drop("sigma", "t")
    out = S.score_components(rows, plain, sig, **GATE)
    return out.select("video_id", "pos", "total", "verdict")
