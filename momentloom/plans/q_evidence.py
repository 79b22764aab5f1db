"""Queries over the evidence gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentloom.operators import evidence as E
from momentloom.plans import derive as D
from momentloom.plans.q_candidates import GATE
from momentloom.plans.registry import query, with_
from momentloom.schemas import Signals

KINDS = ("energy_peak", "laughter", "applause", "rate_surge", "silence", "scene_stable", "mystery", "energy_peak")

_CLAIMS = """SELECT video_id, event_id, ['energy_peak', 'laughter', 'applause', 'rate_surge', 'silence', 'scene_stable', 'mystery', 'energy_peak'][event_id % 8 + 1] AS kind,
    t + (event_id % 7 - 3) * 10.0 AS t, CASE WHEN event_id % 16 = 7 THEN NULL ELSE value / 50 + (event_id % 3) * 0.4 END AS value_num,
    t - 600 AS w0, t + (event_id % 4) * 200.0 - 300 AS w1 FROM ticks"""


def _claims(tk):
    i = F.col("event_id")
    return tk.select(
        "video_id", "event_id", F.get(F.array(*[F.lit(k) for k in KINDS]), (i % 8).cast("int")).alias("kind"),
        (F.col("t") + (i % 7 - 3) * 10.0).alias("t"), F.when(i % 16 != 7, F.col("value") / 50 + i % 3 * 0.4).alias("value_num"),
        F.lit(None).cast("string").alias("value_str"), (F.col("t") - 600).alias("w0"), (F.col("t") + i % 4 * 200.0 - 300).alias("w1"))


_GATED = dict(
    c=_CLAIMS,
    m="""SELECT video_id, 'energy_peak' AS kind, pos, t AS s0, t AS s1, sigma FROM peaks UNION ALL
         SELECT video_id, label, pos, t0, t1, NULL FROM sevents UNION ALL SELECT video_id, 'rate_surge', pos, t0, t1, NULL FROM surges UNION ALL
         SELECT video_id, 'silence', CAST(t0 AS BIGINT), t0, t1, NULL FROM quiet UNION ALL SELECT video_id, 'scene_stable', pos, t0, t1, NULL FROM scenes""",
    hit="""SELECT c.event_id, min(struct_pack(pos := m.pos, len := m.s1 - m.s0)) AS h FROM c JOIN m ON m.video_id = c.video_id AND m.kind = c.kind AND
           CASE c.kind WHEN 'energy_peak' THEN abs(m.s0 - c.t) <= 30 AND abs(m.sigma - c.value_num) <= 0.5
                WHEN 'laughter' THEN m.s0 < c.t + 60 AND m.s1 > c.t - 60 WHEN 'applause' THEN m.s0 < c.t + 60 AND m.s1 > c.t - 60
                WHEN 'silence' THEN (c.t BETWEEN m.s0 AND m.s1) OR least(abs(m.s0 - c.t), abs(m.s1 - c.t)) <= 30
                ELSE c.t BETWEEN m.s0 AND m.s1 END GROUP BY 1""",
    near="""SELECT c.event_id, m.s0, m.s1, m.sigma FROM c JOIN m ON m.video_id = c.video_id AND m.kind = c.kind
            QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY least(abs(m.s0 - c.t), abs(m.s1 - c.t)), m.pos) = 1""",
    g="""SELECT c.*, CASE WHEN c.t < w0 - 120 OR c.t > w1 + 120 THEN 'outside window [' || w0 || ', ' || w1 || '] (+/-120.0s): t=' || c.t
            WHEN c.kind = 'mystery' THEN 'unknown kind'
            WHEN c.kind = 'energy_peak' AND value_num IS NULL THEN 'bad value type'
            WHEN c.kind = 'energy_peak' AND h IS NULL THEN 'no energy peak within 30.0s of t=' || c.t || CASE WHEN near.s0 IS NULL THEN '; index has no peaks'
                 ELSE ' matching sigma=?; nearest is t=' || near.s0 END
            WHEN c.kind IN ('laughter', 'applause') AND h IS NULL THEN 'no ' || c.kind || ' event within 60.0s of t=' || c.t ||
                 CASE WHEN near.s0 IS NULL THEN '; index has no ' || c.kind || ' events' ELSE '; nearest ' || c.kind || ' is t=[' || near.s0 || ',' || near.s1 || ']' END
            WHEN c.kind = 'rate_surge' AND h IS NULL THEN 'no rate surge contains t=' || c.t || CASE WHEN near.s0 IS NULL THEN '; index has no surges' ELSE '; nearest surge is [' || near.s0 || ',' || near.s1 || ']' END
            WHEN c.kind = 'silence' AND h IS NULL THEN 'no silence span within 30.0s of t=' || c.t || CASE WHEN near.s0 IS NULL THEN '; index has no silences' ELSE '; nearest is [' || near.s0 || ',' || near.s1 || ']' END
            WHEN c.kind = 'scene_stable' AND h IS NULL THEN 'no scene span contains t=' || c.t
            WHEN c.kind = 'scene_stable' AND h.len < 900 THEN 'scene at t=' || c.t || ' is only ' || h.len || 's, below 900.0s minimum' END AS reason
         FROM c LEFT JOIN hit USING (event_id) LEFT JOIN near USING (event_id)""")
_TABLES = ("peaks", "sevents", "surges", "quiet", "scenes")


def _gated(spark, d):
    return E.validate_claims(_claims(D.ticks(spark, d)), D.tick_signals(spark, d, ("surge", "scene", "silence"), False), **GATE)


@query(with_(*_TABLES, **_GATED) + "SELECT video_id, event_id, kind, t, reason IS NULL AS resolved, reason FROM g")
def validate_claims(spark, d):
    # sigmas are not exact in decimal text, so the cited and the nearest one are masked
    reason = F.regexp_replace(F.regexp_replace("reason", r"sigma=[^;]+;", "sigma=?;"), r" sigma=[\d.E-]+$", "")
    return _gated(spark, d).select("video_id", "event_id", "kind", "t", "resolved", reason.alias("reason"))


@query(with_(*_TABLES, **_GATED) + """SELECT kind, CASE WHEN reason IS NULL THEN 'resolved' WHEN reason LIKE 'outside window%' THEN 'outside window'
    WHEN reason LIKE 'unknown kind%' THEN 'unknown kind' WHEN reason LIKE 'bad value type%' THEN 'bad value type'
    WHEN reason LIKE 'scene at%' THEN 'scene too short' ELSE 'no measurement' END AS outcome, count(*) AS n_claims FROM g GROUP BY 1, 2""")
def claim_quality(spark, d):
    return E.claim_quality(_gated(spark, d))


_SQUASH = r"""trim(regexp_replace(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+', ' ', 'g'))"""
_QUOTE = with_("words", c="""SELECT w.video_id, w.pos, w.t0 + (w.pos % 3) * 20.0 AS t,
        w.text || ', ' || coalesce(n.text, '') || CASE WHEN w.pos % 2 = 0 THEN '!' ELSE ' ' || coalesce(m.text, '') END AS q
        FROM words w LEFT JOIN words n ON n.video_id = w.video_id AND n.pos = w.pos + 1 LEFT JOIN words m ON m.video_id = w.video_id AND m.pos = w.pos + 2""",
        h="""SELECT c.video_id, c.pos, string_agg(w.text, ' ' ORDER BY w.pos) AS hay FROM c JOIN words w ON w.video_id = c.video_id
             AND w.t0 < c.t + length(c.q) / 4 AND w.t1 > c.t - 1 GROUP BY 1, 2""")


@query(_QUOTE + f"""SELECT c.video_id, c.pos, coalesce({_SQUASH.format('q')} <> '' AND contains({_SQUASH.format("coalesce(hay, '')")}, {_SQUASH.format('q')}), false) AS resolved
    FROM c LEFT JOIN h ON h.video_id = c.video_id AND h.pos = c.pos""")
def quote_claims(spark, d):
    """Every word opens a quote of two or three words, some cited twenty seconds off."""
    w = D.words(spark, d).select("video_id", "pos", "text", "t0", "t1")
    nxt = lambda k: w.select("video_id", (F.col("pos") - k).alias("pos"), F.col("text").alias(f"n{k}"))
    q = w.join(nxt(1), ["video_id", "pos"], "left").join(nxt(2), ["video_id", "pos"], "left")
    said = F.concat("text", F.lit(", "), F.coalesce("n1", F.lit("")), F.when(F.col("pos") % 2 == 0, "!").otherwise(F.concat(F.lit(" "), F.coalesce("n2", F.lit("")))))
    claims = q.select("video_id", "pos", F.lit("quote").alias("kind"), (F.col("t0") + F.col("pos") % 3 * 20.0).alias("t"),
                      F.lit(None).cast("double").alias("value_num"), said.alias("value_str"), F.lit(0.0).alias("w0"), F.lit(1e9).alias("w1"))
    sig = Signals(media=D.media(w), words=w, peaks=w.where("false").select("video_id", "pos", F.col("t0").alias("t"), F.col("t0").alias("sigma")))
    return E.validate_claims(claims, sig).select("video_id", "pos", "resolved")
