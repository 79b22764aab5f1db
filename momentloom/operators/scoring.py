"""Scores, verdicts and the choice of windows per timeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentloom.functions.expr import held, verdict
from momentloom.operators.candidates import fallback_windows
from momentloom.operators.evidence import validate_claims
from momentloom.operators.stored import settle
from momentloom.operators.timeline import not_overlapping
from momentloom.schemas import CLAIMS, COMPONENTS, Signals
from momentloom.sources.replies import claims_at, has_type, is_valid

# Score components in display order, and scoring limits.
PARTS = ("hook_strength", "payoff", "emotion", "quotability")
PART_MAX = 25
PER_CLAIM = 15
STUB_MAX = 90
BEST_EFFORT = 4
MAX_CLIPS = 8


def evidence_score(cands: DataFrame) -> DataFrame:
    """Score by number of claims, spread over the components; the first ones take the remainder."""
    total = F.least(F.lit(STUB_MAX), F.size("evidence") * PER_CLAIM)
    k = len(PARTS)
    score = lambda i: (F.floor(total / k) + F.when(F.pmod(total, F.lit(k)) > i, 1).otherwise(0)).cast("int")
    comps = F.map_from_arrays(
        F.array(*[F.lit(p) for p in PARTS]),
        F.array(*[F.struct(score(i).alias("score"), F.col("evidence").alias("evidence")) for i in range(k)]),
    )
    return cands.select("*", total.cast("int").alias("total"), comps.cast(COMPONENTS).alias("components"), verdict(total).alias("verdict"))


def score_components(replies: DataFrame, cands: DataFrame, sig: Signals, **gate) -> DataFrame:
    """Score candidates from stored replies ``video_id, cand_id, attempt, reply`` under the evidence gate.

    A component with missing, malformed or unresolved evidence is taken from the second reply, and
    is void when that fails too.  Without a valid reply the evidence count decides.
    """
    ids = ["video_id", "cand_id"]
    v = F.col("_v")
    parsed = held(replies.where(F.col("attempt") <= 2), _v=F.try_parse_json("reply"))
    parsed = parsed.select(*ids, "attempt", F.when(is_valid(v, ["components"], {"components": "object"}), v).alias("v"))
    rows = cands.select(*ids, F.col("t0").alias("w0"), F.col("t1").alias("w1")).join(parsed, ids).where(F.col("v").isNotNull())
    name = F.explode(F.array(*[F.lit(p) for p in PARTS]))
    rows = rows.select(*ids, "w0", "w1", "attempt", "v", name.alias("part"))
    pick = None
    for p in PARTS:
        cond = F.col("part") == p
        val = F.try_variant_get("v", f"$.components.{p}", "variant")
        pick = F.when(cond, val) if pick is None else pick.when(cond, val)
    rows = held(rows.select(*ids, "w0", "w1", "attempt", "part", "v"), e=pick)
    e = F.col("e")
    raw = F.when(has_type(e, "$.score", "number"), F.try_variant_get(e, "$.score", "double"))
    clamped = F.when(raw.isNull() | F.isnan(raw), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(PART_MAX), raw.cast("int"))))
    present = has_type(e, "$", "object")
    rows = rows.select(*ids, "w0", "w1", "attempt", "part", F.when(present, clamped).otherwise(0).alias("score"),
                       F.when(present, claims_at(e, "$.evidence")).alias("evidence"))
    rows = settle(rows, "parts")
    usable = F.size(F.coalesce("evidence", F.array().cast(CLAIMS))) > 0
    unit = [*ids, "attempt", "part"]
    claims = rows.where(usable).select(*unit, "w0", "w1", F.posexplode("evidence").alias("c_pos", "c")).select(*unit, "w0", "w1", "c_pos", "c.*")
    bad = validate_claims(claims, sig, **gate).where(~F.col("resolved")).select(*unit).distinct().withColumn("bad", F.lit(True))
    judged = rows.join(bad, unit, "left").withColumn("ok", usable & F.col("bad").isNull())
    best = judged.groupBy(*ids, "part").agg(
        F.min_by(F.struct("score", "evidence"), F.when(F.col("ok"), F.col("attempt"))).alias("c"),
        F.max((F.col("attempt") == 1) & F.col("ok")).alias("first_ok"),
    )
    seen = parsed.groupBy(*ids).agg(
        F.max((F.col("attempt") == 1) & F.col("v").isNotNull()).alias("has1"),
        F.max((F.col("attempt") == 2) & F.col("v").isNotNull()).alias("has2"),
    )
    void = F.struct(F.lit(0).alias("score"), F.array().cast(CLAIMS).alias("evidence"))
    per = best.groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct("part", F.coalesce("c", void)))).cast(COMPONENTS).alias("live"),
        F.sum(F.coalesce("c.score", F.lit(0))).cast("int").alias("live_total"), F.min("first_ok").alias("all_first"),
    )
    base = evidence_score(cands)
    out = base.join(per, ids, "left").join(seen, ids, "left")
    live = F.coalesce(F.col("has1") & (F.col("all_first") | F.col("has2")), F.lit(False))
    total = F.when(live, F.col("live_total")).otherwise(F.col("total"))
    return out.select(*cands.columns, total.alias("total"), F.when(live, F.col("live")).otherwise(F.col("components")).alias("components"),
                      verdict(total).alias("verdict"))


def run_rounds(cands: DataFrame, scorer: Callable[[DataFrame], DataFrame], refined: DataFrame | None = None, iou: float = 0.5):
    """Two scoring rounds as one plan: ``(keepers, every scored row)``, each with ``round``.

    Timelines with a borderline window are proposed again (``refined``, or the same candidates) and
    lose what overlaps a keeper.
    """
    one = settle(scorer(cands).withColumn("round", F.lit(0)), "round")
    keep = one.where(F.col("verdict") == "keep")
    again = one.where(F.col("verdict") == "borderline").select("video_id").distinct()
    pool = (cands if refined is None else refined).join(again, "video_id", "left_semi")
    fresh = not_overlapping(pool, keep.select("video_id", F.col("t0").alias("s0"), F.col("t1").alias("s1")), iou)
    two = scorer(fresh).withColumn("round", F.lit(1))
    every = one.unionByName(two)
    return every.where(F.col("verdict") == "keep"), every


def best_effort(every: DataFrame, sig: Signals, n: int = BEST_EFFORT, span: float = 30.0) -> DataFrame:
    """Windows for timelines without a keeper: the best scored ones, or spaced fallbacks when none was scored.

    Everything is marked borderline.  Equal windows count once, the last scored one.
    """
    every = settle(every, "scored")
    kept = every.where(F.col("verdict") == "keep").select("video_id").distinct()
    scored = every.select("video_id").distinct()
    cols = ["cand_id", "pos", "source", "notes", "evidence", "total", "components"]
    last = every.join(kept, "video_id", "left_anti").groupBy("video_id", "t0", "t1").agg(
        F.max_by(F.struct(*cols), F.struct("round", "pos")).alias("x"), F.min(F.struct("round", "pos")).alias("first"))
    w = W.partitionBy("video_id").orderBy(F.size("x.evidence").desc(), "t0", "first")
    ranked = last.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    ranked = ranked.select("video_id", "t0", "t1", *[F.col(f"x.{c}").alias(c) for c in cols], (F.col("rn") - 1).alias("place"))
    bare = Signals(media=sig.media.join(scored, "video_id", "left_anti"), spans=sig.spans)
    spare = evidence_score(fallback_windows(bare, n, span=span))
    spare = spare.where(F.col("pos") < n).select("video_id", "t0", "t1", *cols, F.col("pos").alias("place"))
    return ranked.unionByName(spare).withColumn("verdict", F.lit("borderline"))


def keepers_in_order(every: DataFrame) -> DataFrame:
    """Kept windows with ``place`` by total, ties in scoring order."""
    w = W.partitionBy("video_id").orderBy(F.col("total").desc(), "round", "pos")
    cols = ["video_id", "t0", "t1", "cand_id", "pos", "source", "notes", "evidence", "total", "components"]
    return every.where(F.col("verdict") == "keep").withColumn("place", F.row_number().over(w) - 1).select(*cols, "place", "verdict")


def voided_components(scored: DataFrame) -> DataFrame:
    """Names of components that score nothing and cite nothing."""
    names = F.map_keys(F.map_filter("components", lambda k, c: (c.score == 0) & (F.size(c.evidence) == 0)))
    return scored.select("video_id", "cand_id", F.array_sort(names).alias("voided"))


def top_component(scored: DataFrame) -> DataFrame:
    """Highest component, the first in map order on a tie, null without components."""
    best = F.aggregate(
        F.map_entries("components"), F.lit(None).cast("struct<score:int,name:string>"),
        lambda acc, x: F.when(acc.isNull() | (x.value.score > acc.score), F.struct(x.value.score.alias("score"), x.key.alias("name"))).otherwise(acc))
    return scored.select("video_id", "cand_id", best["name"].alias("top_component"), best["score"].alias("top_score"))


def select_clips(chosen: DataFrame, k: int = MAX_CLIPS) -> DataFrame:
    """First ``k`` windows per timeline in keeper order."""
    w = W.partitionBy("video_id").orderBy("place")
    return chosen.withColumn("clip_index", F.row_number().over(w)).where(F.col("clip_index") <= k)
