"""Candidate windows by rule, from stored proposals, and as a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentloom.functions.expr import interval_iou
from momentloom.operators import folds
from momentloom.operators.evidence import validate_claims
from momentloom.operators.series import NOISE, as_spans
from momentloom.operators.stored import settle
from momentloom.operators.timeline import Edge, lookup, nearest_point, overlap_seconds, stab_pairs
from momentloom.schemas import CLAIMS, Signals
from momentloom.sources.replies import claims_at, has_type

# Limits of the candidate stage, in seconds and counts.
MAX_CANDIDATES = 20
MIN_LEN = 30.0
MAX_LEN = 90.0
PEAK_SURGE_REACH = 5.0
PEAK_SURGE_WINDOW = 20.0
LEAD_SPEECH = 8.0
LEAD_WINDOW = 20.0
EVENT_TAIL = 3.0
SCENE_LEN = 20.0
SAME_IOU = 0.5

ORDER = ("rule_rank", "o1", "o2", "part")


def claim(kind: Column | str, t: Column, num: Column | None = None) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), t.cast("double").alias("t"),
        (F.lit(None) if num is None else num).cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"),
    )


def clamp_windows(df: DataFrame, r0: str = "r0", r1: str = "r1", min_len: float = MIN_LEN, max_len: float = MAX_LEN) -> DataFrame:
    """Cut raw windows ``r0, r1`` to ``[0, duration_s]`` and to the length bounds; adds ``part, t0, t1``.

    Short windows grow by the same amount on both sides, each side stopped by the media edge; long
    ones fall into equal parts.
    """
    others = [c for c in df.columns if c not in (r0, r1)]
    a = F.greatest(F.lit(0.0), F.col(r0))
    b = F.least(F.col("duration_s"), F.col(r1))
    clipped = df.select(*others, a.alias("_a"), b.alias("_b")).where(F.col("_b") > F.col("_a"))
    span = F.col("_b") - F.col("_a")
    pad = (F.lit(min_len) - span) / 2
    n = F.when(span > max_len, F.ceil(span / max_len)).otherwise(F.lit(1)).cast("int")
    split = clipped.select(*others, "_a", "_b", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    short, step = span < min_len, span / F.col("_n")
    t0 = F.when(short, F.greatest(F.lit(0.0), F.col("_a") - pad)).when(F.col("_n") > 1, F.col("_a") + F.col("part") * step).otherwise(F.col("_a"))
    t1 = F.when(short, F.least(F.col("duration_s"), F.col("_b") + pad)).when(
        F.col("_n") > 1, F.col("_a") + (F.col("part") + 1) * step).otherwise(F.col("_b"))
    return split.select(*others, "part", t0.alias("t0"), t1.alias("t1")).where(F.col("t1") > F.col("t0"))


def _shape(df: DataFrame, rank: int, o1: Column, o2: Column, source: str, evidence: Column) -> DataFrame:
    return df.select(
        "video_id", F.lit(rank).alias("rule_rank"), o1.cast("double").alias("o1"), o2.cast("bigint").alias("o2"), "part",
        "t0", "t1", F.lit(source).alias("source"), F.lit("").alias("notes"), evidence.cast(CLAIMS).alias("evidence"),
    )


def rule_energy_rate(sig: Signals, reach: float = PEAK_SURGE_REACH, window: float = PEAK_SURGE_WINDOW,
                     min_len: float = MIN_LEN, max_len: float = MAX_LEN) -> DataFrame:
    """Windows around the peak nearest to a rate surge.

    The search zone is symmetric about the surge's middle, so its nearest peak is the nearest of all
    if that one lies inside: one as-of scan, no pairs.
    """
    mids = sig.kind("surge").select("video_id", F.col("pos").alias("surge_pos"), "t0", "t1", ((F.col("t0") + F.col("t1")) / 2).alias("t"))
    peaks = sig.peaks.select("video_id", "pos", F.col("t").alias("s"), "sigma")
    near = nearest_point(mids, peaks, F.col("sigma"))
    p = F.col("near")
    hit = near.where((p.s >= F.col("t0") - reach) & (p.s <= F.col("t1") + reach))
    raw = hit.select("video_id", "surge_pos", F.col("t0").alias("surge_t0"), p.s.alias("peak_t"), p.v.alias("sigma"),
                     (p.s - window).alias("r0"), (p.s + window).alias("r1"))
    cut = clamp_windows(raw.join(sig.media.select("video_id", "duration_s"), "video_id"), min_len=min_len, max_len=max_len)
    evidence = F.array(claim("energy_peak", F.col("peak_t"), F.col("sigma")), claim("rate_surge", F.col("surge_t0")))
    return _shape(cut, 0, F.col("surge_pos"), F.lit(0), "rule_a_energy_rate", evidence)


def rule_event_leadup(sig: Signals, lead: float = LEAD_SPEECH, window: float = LEAD_WINDOW, tail: float = EVENT_TAIL,
                      min_len: float = MIN_LEN, max_len: float = MAX_LEN, width: float = 64.0) -> DataFrame:
    """Windows ending just after laughter or applause that follows uninterrupted speech."""
    ev = sig.events.where(F.col("label").isin("laughter", "applause")).join(
        sig.media.select("video_id", "duration_s"), "video_id"
    ).where((F.col("t0") < F.col("duration_s")) & (F.col("t1") > 0))
    leads = ev.select("video_id", "duration_s", "label", "pos", "conf", F.col("t0").alias("e0"), F.col("t1").alias("e1"),
                      (F.col("t0") - lead).alias("t0"), F.col("t0").alias("t1"))
    spoken = overlap_seconds(leads, as_spans(sig.kind("speech")), width).where(F.col("seconds") >= lead)
    raw = spoken.select("video_id", "duration_s", "label", "pos", "conf", "e0",
                        (F.col("e0") - window).alias("r0"), (F.col("e1") + tail).alias("r1"))
    cut = clamp_windows(raw, min_len=min_len, max_len=max_len)
    second = F.when(F.col("label") == "laughter", 0).otherwise(1) * F.lit(2**40).cast("bigint") + F.col("pos")
    return _shape(cut, 1, F.col("e0"), second, "rule_b_laughter", F.array(claim(F.col("label"), F.col("e0"), F.col("conf"))))


def decile_bar(curve: DataFrame) -> DataFrame:
    """Top cut point (exclusive method) of each timeline's non-zero values; timelines with fewer than two drop out.

    Equal values are counted first; the ranks of the distinct values come from a bucketed running
    count, so no timeline is sorted in one place.
    """
    counted = curve.where(F.col("v") > 0).groupBy("video_id", "v").agg(F.count("*").alias("n"))
    size = counted.groupBy("video_id").agg(F.sum("n").alias("size"), F.max("v").alias("top")).where(F.col("size") >= 2)
    scaled = settle(counted.join(size, "video_id").withColumn("x", F.col("v") / F.col("top") * 1e6), "values")
    ranked = lookup(scaled, [Edge("upto", scaled, "x", "n", keep="sum")], t="x")
    n = F.col("size")
    j = F.least(F.greatest(F.floor(F.lit(9) * (n + 1) / 10), F.lit(1)), n - 1)
    ranked = ranked.withColumn("j", j)
    at = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), F.col("v")))
    picked = ranked.groupBy("video_id", "size", "j").agg(at(F.col("j")).alias("lo"), at(F.col("j") + 1).alias("hi"))
    d = F.lit(9) * (n + 1) - F.col("j") * 10
    return picked.select("video_id", ((F.col("lo") * (10 - d) + F.col("hi") * d) / 10).alias("bar"))


def rule_scene_variance(sig: Signals, hop_s: float = 1.0, scene_len: float = SCENE_LEN, curve: str = "pitch",
                        min_len: float = MIN_LEN, max_len: float = MAX_LEN, width: float = 64.0) -> DataFrame:
    """Long scenes whose mean pitch variance reaches the timeline's top decile.

    A mean that equals the bar reaches it, whatever the last digits of the two: they stay within ``NOISE``.
    """
    values = sig.curve(curve)
    scenes = sig.kind("scene").where(F.col("t1") - F.col("t0") >= scene_len)
    lo = F.floor(F.col("t0") / hop_s)
    hi = F.greatest(lo + 1, F.floor(F.col("t1") / hop_s))
    ranged = scenes.select("video_id", "pos", F.col("t0").alias("scene_t0"), F.col("t1").alias("scene_t1"),
                           lo.alias("lo"), (hi - 1).alias("last"))
    i = F.col("i")
    inside = stab_pairs(values.select("video_id", "i", "v"), ranged, "i", "lo", "last",
                        (i >= F.col("lo")) & (i <= F.col("last")), width=width, how="inner")
    mean = inside.groupBy("video_id", "pos", "scene_t0", "scene_t1").agg(F.avg("v").alias("mean"))
    loud = mean.join(decile_bar(values), "video_id").where(F.col("mean") >= F.col("bar") * (1 - NOISE))
    raw = loud.join(sig.media.select("video_id", "duration_s"), "video_id").select(
        "video_id", "duration_s", "pos", "mean", "scene_t0", F.col("scene_t0").alias("r0"), F.col("scene_t1").alias("r1"))
    cut = clamp_windows(raw, min_len=min_len, max_len=max_len)
    return _shape(cut, 2, F.col("pos"), F.lit(0), "rule_c_scene_pitch",
                  F.array(claim("scene_stable", F.col("scene_t0"), F.col("mean"))))


def dedupe_windows(cands: DataFrame, iou: float = SAME_IOU) -> DataFrame:
    """Greedy removal of near-identical windows in candidate order.

    Windows that no chain of overlaps connects cannot meet, so each such island is scanned alone.
    """
    rows = cands.select("video_id", *ORDER, "t0", "t1", "source", "notes", F.size("evidence").alias("n_evidence"),
                        F.to_json("evidence").alias("evidence_json"))
    parts = folds.gap_islands(rows, "t0", "t1", 0.0)
    kept = folds.scan_groups(
        parts, ["video_id", "island"], list(ORDER), folds.dedupe_step(iou),
        "t0 double, t1 double, source string, notes string, n_evidence int, evidence_json string, "
        "rule_rank int, o1 double, o2 bigint, part int",
    )
    return kept.select("video_id", *ORDER, "t0", "t1", "source", "notes", F.from_json("evidence_json", CLAIMS).alias("evidence"))


def top_candidates(cands: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """Best ``k`` per timeline by evidence count, then start, then candidate order; adds ``pos`` and ``cand_id``."""
    w = W.partitionBy("video_id").orderBy(F.size("evidence").desc(), "t0", *ORDER)
    ranked = cands.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return ranked.select(
        "video_id", F.concat_ws("-", "video_id", F.lpad((F.col("rn") - 1).cast("string"), 3, "0")).alias("cand_id"),
        (F.col("rn") - 1).alias("pos"), "t0", "t1", "source", "notes", "evidence",
    )


def rule_windows(sig: Signals, rules=(rule_energy_rate, rule_event_leadup, rule_scene_variance)) -> DataFrame:
    """Windows of the given rules (callables of ``Signals``), in rule order."""
    out = None
    for rule in rules:
        out = rule(sig) if out is None else out.unionByName(rule(sig))
    return out


def propose(sig: Signals, rules=(rule_energy_rate, rule_event_leadup, rule_scene_variance), k: int = MAX_CANDIDATES,
            iou: float = SAME_IOU, extra: DataFrame | None = None) -> DataFrame:
    """All rules, near-duplicates removed, best ``k`` per timeline.  ``extra`` adds admitted proposals."""
    best = top_candidates(dedupe_windows(rule_windows(sig, rules), iou), k)
    if extra is None:
        return best
    ruled = best.select("video_id", F.lit(0).alias("rule_rank"), F.col("pos").cast("double").alias("o1"),
                        F.lit(0).cast("bigint").alias("o2"), F.lit(0).alias("part"), "t0", "t1", "source", "notes", "evidence")
    return top_candidates(dedupe_windows(ruled.unionByName(extra), iou), k)


# --- stored proposals -------------------------------------------------------------------------


def parse_proposals(replies: DataFrame, media: DataFrame, min_len: float = MIN_LEN, max_len: float = MAX_LEN):
    """Split the candidates of valid replies ``video_id, chunk, reply`` into well-formed windows and discards."""
    entries = replies.select("video_id", "chunk", F.posexplode(F.try_variant_get(F.try_parse_json("reply"), "$.candidates", "array<variant>")).alias("seq", "e"))
    e = F.col("e")
    entries = entries.where(has_type(e, "$", "object"))
    typed = entries.select(
        "video_id", "chunk", "seq",
        F.when(has_type(e, "$.t0", "number"), F.try_variant_get(e, "$.t0", "double")).alias("r0"),
        F.when(has_type(e, "$.t1", "number"), F.try_variant_get(e, "$.t1", "double")).alias("r1"),
        claims_at(e, "$.evidence").alias("evidence"),
        F.coalesce(F.when(has_type(e, "$.reason", "string"), F.try_variant_get(e, "$.reason", "string")), F.lit("")).alias("notes"),
    )
    why = F.when(F.col("r0").isNull() | F.col("r1").isNull(), "malformed t0/t1").when(F.col("evidence").isNull(), "malformed evidence entry")
    typed = typed.withColumn("reason", why)
    bad = typed.where(F.col("reason").isNotNull()).select("video_id", "chunk", "seq", "reason")
    # texts and their entries look small to the planner, which would send all of them through the driver
    good = typed.where(F.col("reason").isNull()).drop("reason").join(media.select("video_id", "duration_s").hint("merge"), "video_id")
    return clamp_windows(good, min_len=min_len, max_len=max_len), bad


def gate_windows(windows: DataFrame, sig: Signals, ids: list[str], **gate) -> DataFrame:
    """Add to each window the array ``reasons`` of its failing claims (empty when all resolve)."""
    claims = windows.select(*ids, F.col("t0").alias("w0"), F.col("t1").alias("w1"), F.posexplode("evidence").alias("c_pos", "c"))
    flat = claims.select(*ids, "w0", "w1", "c_pos", "c.*")
    failed = validate_claims(flat, sig, **gate).where(~F.col("resolved"))
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("c_pos", "reason"))), lambda x: x.reason)
    failed = failed.groupBy(*ids).agg(reasons.alias("reasons"))
    return windows.join(failed, ids, "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def admit_proposals(first: DataFrame, sig: Signals, second: DataFrame | None = None, min_len: float = MIN_LEN,
                    max_len: float = MAX_LEN, **gate):
    """Admitted windows and rejections of stored proposals; chunks with failing windows get one second reply.

    ``first`` and ``second`` hold the valid replies of each round: ``video_id, chunk, reply``.
    """
    ids = ["video_id", "chunk", "seq", "part"]

    def one_round(replies, rank):
        windows, bad = parse_proposals(replies, sig.media, min_len, max_len)
        gated = settle(gate_windows(settle(windows, "windows"), sig, ids, **gate).withColumn("round", F.lit(rank)), "gated")
        return gated, bad.withColumn("round", F.lit(rank))

    gated, bad = one_round(first, 1)
    if second is not None:
        ask = gated.where(F.size("reasons") > 0).select("video_id", "chunk").distinct()
        gated2, bad2 = one_round(second.join(ask, ["video_id", "chunk"], "left_semi"), 2)
        gated, bad = gated.unionByName(gated2), bad.unionByName(bad2)
    admitted = gated.where(F.size("reasons") == 0).select(
        "video_id", F.lit(3).alias("rule_rank"), (F.col("chunk") * 2 + F.col("round")).cast("double").alias("o1"),
        F.col("seq").cast("bigint").alias("o2"), "part", "t0", "t1", F.lit("llm").alias("source"), "notes", "evidence")
    last = 1 if second is None else 2
    refused = gated.where((F.size("reasons") > 0) & (F.col("round") == last)).select(
        "video_id", "chunk", "seq", "round", F.array_join("reasons", "; ").alias("reason"))
    return admitted, bad.select("video_id", "chunk", "seq", "round", "reason").unionByName(refused)


# --- fallback -----------------------------------------------------------------------------------


def fallback_windows(sig: Signals, n: int, span: float = MIN_LEN, iou: float = SAME_IOU) -> DataFrame:
    """``n`` evenly spaced windows on the spoken part of each timeline, without evidence.

    Running speech time turns a spoken position into an as-of lookup; the greedy drop folds over the
    ``n`` windows of a timeline, an array of fixed size.
    """
    speech = sig.kind("speech").select("video_id", "pos", "t0", "t1", (F.col("t1") - F.col("t0")).alias("len"))
    cum = lookup(speech, [Edge("upto", speech, "t0", "len", keep="sum")], t="t0")
    cum = cum.select("video_id", "t0", "t1", "upto", (F.col("upto") - F.col("len")).alias("before"))
    total = speech.groupBy("video_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("len"))).alias("total"), F.max_by("t1", "t0").alias("last"))
    mids = sig.media.where(F.col("duration_s") > 0).select("video_id", "duration_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    mids = mids.join(total, "video_id", "left")
    spoken = F.coalesce("total", F.lit(0.0)) > 0
    mids = mids.withColumn("v", (F.col("k") + 0.5) * F.when(spoken, F.col("total")).otherwise(F.col("duration_s")) / n)
    placed = lookup(mids, [Edge("hit", cum, "upto", F.struct("t0", "before"), "after")], t="v")
    mid = F.when(~spoken, F.col("v")).otherwise(
        F.coalesce(F.col("hit.t0") + F.col("v") - F.col("hit.before"), F.col("last")))
    half = span / 2
    lo, hi = mid - half, mid + half
    hi = F.when(lo < 0, hi - lo).otherwise(hi)
    lo = F.greatest(lo, F.lit(0.0))
    over = F.greatest(hi - F.col("duration_s"), F.lit(0.0))
    w = placed.select("video_id", "k", F.greatest(F.lit(0.0), lo - over).alias("t0"), F.least(hi, F.col("duration_s")).alias("t1"))
    per = w.where(F.col("t1") - F.col("t0") >= 1e-9).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("k", "t0", "t1"))).alias("ws"))
    start = F.array().cast("array<struct<k:int,t0:double,t1:double>>")
    kept = F.aggregate("ws", start, lambda acc, x: F.when(
        F.exists(acc, lambda y: interval_iou(x.t0, x.t1, y.t0, y.t1) > iou), acc).otherwise(F.concat(acc, F.array(x))))
    out = per.select("video_id", F.posexplode(kept).alias("pos", "w"))
    return out.select("video_id", F.concat_ws("-f", "video_id", F.col("pos").cast("string")).alias("cand_id"), "pos", "w.t0", "w.t1",
                      F.lit("fallback").alias("source"), F.lit("").alias("notes"), F.array().cast(CLAIMS).alias("evidence"))
