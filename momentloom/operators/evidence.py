"""Evidence gate: a claim counts only if it resolves against the measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.functions.expr import fixed, squash
from momentloom.operators.stored import settle
from momentloom.operators.timeline import Edge, all_short, interval_pairs, lookup, met_in_one_cell, stab_pairs
from momentloom.schemas import Signals

# Claim kinds and tolerances in seconds.
POINT_KINDS = ("energy_peak", "laughter", "applause", "rate_surge", "silence", "scene_stable")
WINDOW_SLACK = 2.0
PEAK_TIME = 0.5
PEAK_SIGMA = 0.5
EVENT_TIME = 1.0
SILENCE_TIME = 0.5
SCENE_LEN = 15.0
QUOTE_LEAD = 1.0
QUOTE_RATE = 4.0


def marks(sig: Signals) -> DataFrame:
    """Every measurement a claim can cite, as spans of one table keyed by timeline and claim kind."""
    parts = []
    if sig.peaks is not None:
        parts.append(sig.peaks.select("video_id", F.lit("energy_peak").alias("kind"), "pos",
                                      F.col("t").alias("s0"), F.col("t").alias("s1"), "sigma"))
    if sig.events is not None:
        parts.append(sig.events.select("video_id", F.col("label").alias("kind"), "pos",
                                       F.col("t0").alias("s0"), F.col("t1").alias("s1")))
    if sig.spans is not None:
        named = F.create_map(*[F.lit(x) for x in ("surge", "rate_surge", "silence", "silence", "scene", "scene_stable")])
        parts.append(sig.spans.where(F.col("kind").isin("surge", "silence", "scene")).select(
            "video_id", named[F.col("kind")].alias("kind"), "pos", F.col("t0").alias("s0"), F.col("t1").alias("s1")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def validate_claims(
    claims: DataFrame, sig: Signals, *, slack: float = WINDOW_SLACK, peak_time: float = PEAK_TIME,
    peak_sigma: float = PEAK_SIGMA, event_time: float = EVENT_TIME, silence_time: float = SILENCE_TIME,
    scene_len: float = SCENE_LEN, width: float = 64.0,
) -> DataFrame:
    """Add ``resolved`` and ``reason`` to claims ``video_id, w0, w1, kind, t, value_num, value_str, ...``.

    All measured kinds share one table keyed by ``(video_id, kind)``: one containment join and one
    nearest lookup serve every kind.  A claim is rejected unless its rule holds: a null time, window bound, value
    or measurement never resolves.  Identical claims are judged once and all come back.
    """
    own = claims.columns
    claims = claims.groupBy(*own).agg(F.count("*").alias("_times"))
    base = claims.columns
    keys = ("video_id", "kind")
    quotes = claims.where(F.col("kind") == "quote")
    points = claims.where(~F.col("kind").eqNullSafe(F.lit("quote")))

    table = marks(sig).withColumnRenamed("pos", "m_pos")
    if "sigma" not in table.columns:
        table = table.withColumn("sigma", F.lit(None).cast("double"))
    reach = max(peak_time, event_time, silence_time)
    t, s0, s1 = F.col("t"), F.col("s0"), F.col("s1")
    kind = F.col("p.kind")
    edge_dist = F.least(F.abs(s0 - t), F.abs(s1 - t))
    inside = (s0 <= t) & (t <= s1)
    match = (
        F.when(kind == "energy_peak", (s0 >= t - peak_time) & (s0 <= t + peak_time)
               & (F.abs(F.col("sigma") - F.col("value_num")) <= peak_sigma))
        .when(kind.isin("laughter", "applause"), (s0 < t + event_time) & (s1 > t - event_time))
        .when(kind == "silence", inside | (edge_dist <= silence_time))
        .otherwise(inside)
    )
    spread = table.withColumn("x0", s0 - reach).withColumn("x1", s1 + reach)
    pairs = stab_pairs(points, spread, "t", "x0", "x1", match, keys=keys, width=width)
    first = F.min(F.when(s0.isNotNull(), F.struct("m_pos", "s0", "s1")))
    hit = pairs.select(*base, "m_pos", "s0", "s1").groupBy(*base).agg(first.alias("_hit"))
    hit = settle(hit, "hits")

    val = F.struct("m_pos", "s0", "s1", "sigma")
    near = lookup(
        hit, [Edge("_l", table, "s1", val, "before", tie="m_pos"), Edge("_r", table, "s0", val, "after", tie="m_pos")],
        keys=keys,
    )
    l, r = F.col("_l"), F.col("_r")
    cand = lambda c, d: F.when(c.isNotNull(), F.struct(d.alias("d"), c.m_pos.alias("pos"), c.s0.alias("s0"), c.s1.alias("s1"), c.sigma.alias("sigma")))
    near = near.withColumn("_n", F.array_min(F.array_compact(F.array(cand(l, t - l.s1), cand(r, r.s0 - t)))))

    txt = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    n, h = F.col("_n"), F.col("_hit")
    lit, cat = F.lit, F.concat
    outside = ~F.coalesce((t >= F.col("w0") - slack) & (t <= F.col("w1") + slack), lit(False))
    out_reason = cat(lit("outside window ["), txt(F.col("w0")), lit(", "), txt(F.col("w1")), lit(f"] (+/-{slack}s): t="), txt(t))
    k = F.col("kind")
    span_of = lambda s: cat(lit("["), txt(s.s0), lit(","), txt(s.s1), lit("]"))
    peak_head = cat(lit(f"no energy peak within {peak_time}s of t="), txt(t))
    peak_reason = F.when(n.isNull(), cat(peak_head, lit("; index has no peaks"))).otherwise(
        cat(peak_head, lit(" matching sigma="), txt(F.col("value_num")), lit("; nearest is t="), txt(n.s0), lit(" sigma="), txt(n.sigma)))
    event_head = cat(lit("no "), k, lit(f" event within {event_time}s of t="), txt(t))
    event_reason = F.when(n.isNull(), cat(event_head, lit("; index has no "), k, lit(" events"))).otherwise(
        cat(event_head, lit("; nearest "), k, lit(" is t="), span_of(n)))
    surge_head = cat(lit("no rate surge contains t="), txt(t))
    surge_reason = F.when(n.isNull(), cat(surge_head, lit("; index has no surges"))).otherwise(
        cat(surge_head, lit("; nearest surge is "), span_of(n)))
    quiet_head = cat(lit(f"no silence span within {silence_time}s of t="), txt(t))
    quiet_reason = F.when(n.isNull(), cat(quiet_head, lit("; index has no silences"))).otherwise(
        cat(quiet_head, lit("; nearest is "), span_of(n)))
    scene_reason = F.when(h.isNull(), cat(lit("no scene span contains t="), txt(t))).when(
        h.s1 - h.s0 < scene_len,
        cat(lit("scene at t="), txt(t), lit(" is only "), fixed(h.s1 - h.s0, 1), lit(f"s, below {scene_len}s minimum")))
    failed = h.isNull()
    holds = (~outside & k.isin(*POINT_KINDS) & ~failed & ((k != "energy_peak") | F.col("value_num").isNotNull())
             & ((k != "scene_stable") | (h.s1 - h.s0 >= scene_len)))
    reason = (
        F.when(outside, out_reason)
        .when(~k.isin(*POINT_KINDS) | k.isNull(), "unknown kind")
        .when((k == "energy_peak") & F.col("value_num").isNull(), "bad value type")
        .when(k == "energy_peak", F.when(failed, peak_reason))
        .when(k.isin("laughter", "applause"), F.when(failed, event_reason))
        .when(k == "rate_surge", F.when(failed, surge_reason))
        .when(k == "silence", F.when(failed, quiet_reason))
        .otherwise(scene_reason)
    )
    measured = near.select(*base, F.coalesce(holds, lit(False)).alias("resolved"), reason.alias("reason"))

    said = quotes.withColumn("q1", t + F.length("value_str") / QUOTE_RATE).withColumn("q0", t - QUOTE_LEAD)
    word = "struct<w_pos:int,w_text:string>"
    joined, place = said.select(*base, "q0", "q1", F.lit(None).cast(word).alias("w")), []
    if sig.words is not None:
        words = sig.words.select("video_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"),
                                 F.struct(F.col("pos").alias("w_pos"), F.col("text").alias("w_text")).cast(word).alias("w"))
        overlap = (s0 < F.col("q1")) & (s1 > F.col("q0"))
        if all_short(words, "s0", "s1", width):  # the usual case: claims are shuffled once
            joined, place = met_in_one_cell(said, words, "q0", "q1", "s0", "s1", overlap, width=width), ["_at", "_b"]
        else:
            heard = interval_pairs(said, words, "q0", "q1", "s0", "s1", overlap, width=width)
            joined = joined.unionByName(heard.select(*base, "q0", "q1", "w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda x: x.w_text), " ")
    joined = joined.groupBy(*base, "q0", "q1", *place).agg(text.alias("_text"))
    needle = squash("value_str")
    value_str = F.col("value_str")
    double_quoted = value_str.contains("'") & ~value_str.contains('"')
    slashed = F.replace(value_str, lit("\\"), lit("\\\\"))
    shown = F.when(double_quoted, cat(lit('"'), slashed, lit('"'))).otherwise(cat(lit("'"), F.replace(slashed, lit("'"), lit("\\'")), lit("'")))
    edge = lambda c: F.coalesce(fixed(c, 1), lit("null"))
    quote_reason = cat(lit("quote "), shown, lit(" not found in transcript t=["), edge("q0"), lit(","), edge("q1"), lit("]"))
    found = (needle != "") & F.coalesce(squash(F.coalesce("_text", lit(""))).contains(needle), lit(False))
    heard_it = F.coalesce(~outside & value_str.isNotNull() & found, lit(False))
    spoken = joined.select(*base, heard_it.alias("resolved"), (
        F.when(outside, out_reason).when(value_str.isNull(), "bad value type").when(~found, quote_reason)
    ).alias("reason"))
    every = measured.unionByName(spoken)
    told = F.when(~F.col("resolved"), F.coalesce("reason", lit("not resolved"))).alias("reason")
    return every.select(*own, "resolved", told, F.explode(F.sequence(lit(1).cast("bigint"), "_times")).alias("_copy")).drop("_copy")


# Reason classes, by the words each reason starts with.
REASON_CLASSES = {
    "outside window": "outside window", "unknown kind": "unknown kind", "bad value type": "bad value type",
    "quote": "quote not found", "scene at": "scene too short", "no ": "no measurement",
}


def claim_quality(validated: DataFrame) -> DataFrame:
    """Resolved and failed claims per kind and reason class."""
    label = F.when(F.col("resolved"), "resolved")
    for head, name in REASON_CLASSES.items():
        label = label.when(F.col("reason").startswith(head), name)
    return validated.groupBy("kind", label.alias("outcome")).agg(F.count("*").alias("n_claims"))
