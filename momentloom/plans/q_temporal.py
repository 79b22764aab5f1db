"""Queries over the temporal joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentloom.functions.expr import ends_sentence
from momentloom.operators import timeline as T
from momentloom.operators.series import as_spans
from momentloom.plans import derive as D
from momentloom.plans.registry import query, with_

_WIN = "SELECT video_id, pos AS win, t0 - 300 AS t0, t1 + 300 AS t1 FROM surges"


def _windows(tk):
    return D.surges(tk).select("video_id", F.col("pos").alias("win"), (F.col("t0") - 300).alias("t0"), (F.col("t1") + 300).alias("t1"))


@query(with_("surges", "peaks", w=_WIN) + "SELECT w.video_id, w.win, p.pos AS peak, p.t FROM w JOIN peaks p ON p.video_id = w.video_id AND p.t BETWEEN w.t0 AND w.t1")
def points_in(spark, d):
    tk = D.ticks(spark, d)
    return T.points_in(_windows(tk), D.peaks(tk).withColumnRenamed("pos", "peak"), width=600.0).select("video_id", "win", "peak", "t")


@query(with_("words", "cuts") + """SELECT c.video_id, c.cand_id, count(*) AS n_words, min(w.pos) AS first_pos, max(w.pos) AS last_pos
    FROM cuts c JOIN words w ON w.video_id = c.video_id AND w.t0 < c.t1 AND w.t1 > c.t0 GROUP BY 1, 2""")
def words_in_windows(spark, d):
    w = D.words(spark, d)
    pairs = T.overlapping(D.cuts(D.speech(w)), as_spans(w, "pos"))
    return pairs.groupBy("video_id", "cand_id").agg(F.count("*").alias("n_words"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(with_("surges", "sevents", w=_WIN) + """SELECT w.video_id, w.win, e.pos AS ev, e.label, e.conf FROM w JOIN sevents e
    ON e.video_id = w.video_id AND e.t0 < w.t1 AND e.t1 > w.t0 WHERE e.label = 'laughter'""")
def events_in(spark, d):
    tk = D.ticks(spark, d)
    ev = as_spans(D.sevents(tk).withColumnRenamed("pos", "ev"), "ev", "label", "conf")
    return T.events_in(_windows(tk), ev, "laughter", width=600.0).select("video_id", "win", "ev", "label", "conf")


@query(with_("ticks", "scenes") + """SELECT p.video_id, p.event_id, s.pos AS scene, s.t0 AS scene_t0, s.t1 AS scene_t1 FROM ticks p
    LEFT JOIN scenes s ON s.video_id = p.video_id AND p.t BETWEEN s.t0 AND s.t1
    QUALIFY row_number() OVER (PARTITION BY p.video_id, p.event_id ORDER BY s.pos) = 1""")
def scene_at(spark, d):
    tk = D.ticks(spark, d)
    out = T.stab_first(tk.select("video_id", "event_id", "t"), as_spans(D.settle(D.scenes(tk), "scenes"), "pos"), width=600.0)
    return out.select("video_id", "event_id", F.col("hit.pos").alias("scene"), F.col("hit.s0").alias("scene_t0"), F.col("hit.s1").alias("scene_t1"))


@query(with_("ticks", "quiet") + """SELECT p.video_id, p.event_id, s.t0 AS near_t0, s.t1 AS near_t1,
        CASE WHEN p.t BETWEEN s.t0 AND s.t1 THEN 0 ELSE least(abs(s.t0 - p.t), abs(s.t1 - p.t)) END AS dist
    FROM ticks p LEFT JOIN quiet s ON s.video_id = p.video_id
    QUALIFY row_number() OVER (PARTITION BY p.video_id, p.event_id ORDER BY
        CASE WHEN p.t BETWEEN s.t0 AND s.t1 THEN 0 ELSE least(abs(s.t0 - p.t), abs(s.t1 - p.t)) END, s.pos) = 1""")
def nearest_silence(spark, d):
    tk = D.ticks(spark, d)
    q = D.settle(D.quiet(tk).withColumn("pos", F.floor("t0")), "quiet")
    out = T.nearest_span(tk.select("video_id", "event_id", "t"), as_spans(q, "pos"), width=600.0)
    return out.select("video_id", "event_id", F.col("near.s0").alias("near_t0"), F.col("near.s1").alias("near_t1"), F.col("near.dist").alias("dist"))


@query(with_("surges", "peaks") + """SELECT s.video_id, s.pos, p.pos AS sample, p.t AS sample_t, abs(p.t - s.t0) AS dist FROM surges s
    LEFT JOIN peaks p ON p.video_id = s.video_id
    QUALIFY row_number() OVER (PARTITION BY s.video_id, s.pos ORDER BY abs(p.t - s.t0), p.pos) = 1""")
def nearest_sample(spark, d):
    tk = D.ticks(spark, d)
    pts = D.surges(tk).select("video_id", F.col("pos").alias("id"), F.col("t0").alias("t"))
    out = T.nearest_point(pts, D.peaks(tk).withColumnRenamed("t", "s"), F.col("pos"))
    return out.select("video_id", F.col("id").alias("pos"), F.col("near.pos").alias("sample"), F.col("near.s").alias("sample_t"), F.col("near.dist").alias("dist"))


_EDGE = with_("cuts", "words", e="SELECT video_id, t1 AS e FROM words WHERE regexp_matches(text, '[.!?…][\"''”’)\\]}]*$')")


@query(_EDGE + """SELECT c.video_id, c.cand_id, max(CASE WHEN c.t0 - e.e <= 20 THEN e.e END) AS edge
    FROM cuts c LEFT JOIN e ON e.video_id = c.video_id AND e.e <= c.t0 GROUP BY 1, 2""")
def asof_backward(spark, d):
    w = D.words(spark, d)
    pts = D.cuts(D.speech(w)).select("video_id", "cand_id", F.col("t0").alias("t"))
    edges = w.select("video_id", F.col("t1").alias("e"), "text")
    return T.asof_backward(pts, edges, tolerance=20.0, predicate=ends_sentence("text")).select("video_id", "cand_id", "edge")


@query(_EDGE + """SELECT c.video_id, c.cand_id, CASE WHEN min(e.e) - any_value(c.t1) <= 12 THEN min(e.e) END AS edge
    FROM cuts c LEFT JOIN e ON e.video_id = c.video_id AND e.e >= c.t1 GROUP BY 1, 2""")
def asof_forward(spark, d):
    w = D.words(spark, d)
    pts = D.cuts(D.speech(w)).select("video_id", "cand_id", F.col("t1").alias("t"))
    edges = w.where(ends_sentence("text")).select("video_id", F.col("t1").alias("e"))
    return T.asof_forward(pts, edges, tolerance=12.0).select("video_id", "cand_id", "edge")


@query(with_("sevents", "talk", l="SELECT video_id, pos, t0 - 480 AS t0, t0 AS t1 FROM sevents") + """
    SELECT l.video_id, l.pos, coalesce(sum(CASE WHEN k.pos IS NOT NULL THEN least(k.t1, l.t1) - greatest(k.t0, l.t0) END), 0)::DOUBLE AS seconds
    FROM l LEFT JOIN talk k ON k.video_id = l.video_id AND k.t0 < l.t1 AND k.t1 > l.t0 GROUP BY 1, 2""")
def overlap_seconds(spark, d):
    tk = D.ticks(spark, d)
    leads = D.sevents(tk).select("video_id", "pos", (F.col("t0") - 480).alias("t0"), F.col("t0").alias("t1"))
    return T.overlap_seconds(leads, as_spans(D.surges(tk, 3600.0)), width=600.0).select("video_id", "pos", "seconds")


_A = "SELECT video_id, pos, t - 1200 AS t0, t + 1200 AS t1 FROM peaks"
_B = "SELECT video_id, pos AS k, t0 - 1200 AS s0, t1 + 1200 AS s1 FROM surges"
_IOU = "(least(a.t1, b.s1) - greatest(a.t0, b.s0)) / ((a.t1 - a.t0) + (b.s1 - b.s0) - (least(a.t1, b.s1) - greatest(a.t0, b.s0)))"


def _pair_sides(tk):
    a = D.peaks(tk).select("video_id", "pos", (F.col("t") - 1200).alias("t0"), (F.col("t") + 1200).alias("t1"))
    b = D.surges(tk).select("video_id", F.col("pos").alias("k"), (F.col("t0") - 1200).alias("s0"), (F.col("t1") + 1200).alias("s1"))
    return a, b


@query(with_("peaks", "surges", a=_A, b=_B) + f"""SELECT a.video_id, a.pos, b.k, round({_IOU}, 6) AS iou FROM a JOIN b
    ON b.video_id = a.video_id AND b.s0 < a.t1 AND b.s1 > a.t0 WHERE {_IOU} > 0.5""")
def iou_join(spark, d):
    a, b = _pair_sides(D.ticks(spark, d))
    return T.iou_join(a, b, 0.5, width=2400.0).select("video_id", "pos", "k", F.round("iou", 6).alias("iou"))


@query(with_("peaks", "surges", a=_A, b=_B) + f"""SELECT a.video_id, a.pos FROM a WHERE NOT EXISTS (SELECT 1 FROM b
    WHERE b.video_id = a.video_id AND b.s0 < a.t1 AND b.s1 > a.t0 AND {_IOU} > 0.5)""")
def not_overlapping(spark, d):
    a, b = _pair_sides(D.ticks(spark, d))
    return T.not_overlapping(a, b, 0.5, width=2400.0).select("video_id", "pos")


@query(with_("words", "cuts") + "SELECT c.video_id, c.cand_id, w.pos, w.text FROM cuts c JOIN words w ON w.video_id = c.video_id AND w.t0 < c.t0 AND w.t1 > c.t0")
def straddlers(spark, d):
    w = D.words(spark, d)
    pts = D.cuts(D.speech(w)).select("video_id", "cand_id", F.col("t0").alias("t"))
    return T.straddlers(pts, as_spans(w, "pos", "text")).select("video_id", "cand_id", "pos", "text")


@query(with_("words", "cuts") + """SELECT c.video_id, c.cand_id, EXISTS (SELECT 1 FROM words w WHERE w.video_id = c.video_id AND w.t0 < c.t0 AND w.t1 > c.t0) AS mid_word
    FROM cuts c""")
def inside_word(spark, d):
    w = D.words(spark, d)
    pts = D.cuts(D.speech(w)).select("video_id", "cand_id", F.col("t0").alias("t"))
    return T.inside_word(pts, as_spans(w)).select("video_id", "cand_id", "mid_word")
