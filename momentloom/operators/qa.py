"""Quality checks of cuts and renders, their routes and the repair history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentloom.functions.expr import fixed, p95
from momentloom.operators.cuts import IDS, repair
from momentloom.operators.series import as_spans
from momentloom.operators.timeline import interval_pairs, stab_pairs
from momentloom.schemas import Signals

# Checks in report order with the stage a failure goes back to.
ROUTES = {
    "RES": "render", "DUR": "drop", "LUFS": "render", "WORD_CLIP": "surgeon",
    "ALIGN": "surgeon", "SAFE_AREA": "drop", "BLACK": "render", "FROZEN": "render",
}
TARGET_W, TARGET_H = 1080, 1920
LUFS_TARGET, LUFS_SLACK = -14.0, 1.0
MIN_DUR, MAX_DUR = 5.0, 90.0
TITLE_CHARS, CHAR_PX, WIDTH_FRAC = 40, 20.0, 0.9
ALIGN_MAX_MS = 300.0
MAX_REPAIRS = 2


def _fail(df: DataFrame, code: str, detail: Column) -> DataFrame:
    return df.select(*IDS, F.lit(list(ROUTES).index(code)).alias("ord"), F.lit(code).alias("code"),
                     detail.alias("detail"), F.lit(ROUTES[code]).alias("route_to"))


def check_resolution(media: DataFrame, w: int = TARGET_W, h: int = TARGET_H) -> DataFrame:
    bad = media.where((F.col("width") != w) | (F.col("height") != h))
    return _fail(bad, "RES", F.format_string(f"%dx%d != {w}x{h}", "width", "height"))


def check_duration(media: DataFrame, lo: float = MIN_DUR, hi: float = MAX_DUR) -> DataFrame:
    bad = media.where((F.col("duration_s") < lo) | (F.col("duration_s") > hi))
    return _fail(bad, "DUR", F.concat(F.lit("duration "), fixed("duration_s", 2), F.lit(f"s outside [{lo}, {hi}]")))


def check_loudness(media: DataFrame, target: float = LUFS_TARGET, slack: float = LUFS_SLACK) -> DataFrame:
    bad = media.where((F.col("lufs") < target - slack) | (F.col("lufs") > target + slack))
    shown = F.when(F.col("lufs") == float("-inf"), "-inf").otherwise(fixed("lufs", 1))
    return _fail(bad, "LUFS", F.concat(shown, F.lit(f" LUFS outside {target}+-{slack}")))


def _quoted(text: Column) -> Column:
    plain = ~text.contains("'") | text.contains('"')
    return F.when(plain, F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(
        F.concat(F.lit('"'), text, F.lit('"')))


def check_word_clip(cuts: DataFrame, words: DataFrame, width: float = 64.0) -> DataFrame:
    """Cuts with a word strictly around either edge."""
    ends = cuts.select(*IDS, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("side"), F.col("t1").alias("t")))).alias("x")
    ).select(*IDS, "x.side", "x.t")
    spans = as_spans(words, "pos", "text")
    hit = stab_pairs(ends, spans, "t", "s0", "s1", (F.col("s0") < F.col("t")) & (F.col("s1") > F.col("t")), width=width, how="inner")
    per = hit.groupBy(*IDS).agg(F.array_sort(F.collect_list(F.struct("side", "pos", "text"))).alias("ws"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("ws", lambda x: _quoted(x.text)), ", "), F.lit("]"))
    return _fail(per, "WORD_CLIP", F.concat(F.size("ws").cast("string"), F.lit(" word(s) straddle a cut boundary: "), listed))


def cut_alignment(cuts: DataFrame, words: DataFrame, media: DataFrame, max_ms: float = ALIGN_MAX_MS, width: float = 64.0) -> DataFrame:
    """p95 alignment error ``p95_ms`` of the words in each cut of an English timeline, and whether it is above ``max_ms`` (``over``).

    ``over`` is counted; the errors of a cut are gathered and sorted only where ``p95_ms`` is asked for.
    """
    english = media.where(F.col("language") == "en").select("video_id")
    timed = as_spans(words.where(F.col("align_err_ms").isNotNull()), "align_err_ms")
    pairs = interval_pairs(cuts.select(*IDS, "t0", "t1").join(english, "video_id", "left_semi"), timed, "t0", "t1", "s0", "s1",
                           (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0")), width=width)
    per = pairs.groupBy(*IDS).agg(F.count("*").alias("n"), F.count(F.when(F.col("align_err_ms") > max_ms, 1)).alias("bad"), p95(F.collect_list("align_err_ms")).alias("p95_ms"))
    return per.select(*IDS, "p95_ms", (F.col("n") - F.col("bad") <= F.floor(F.lit(0.95) * (F.col("n") - 1))).alias("over"))


def check_alignment(cuts: DataFrame, words: DataFrame, media: DataFrame, max_ms: float = ALIGN_MAX_MS, width: float = 64.0) -> DataFrame:
    bad = cut_alignment(cuts, words, media, max_ms, width).where("over")
    return _fail(bad, "ALIGN", F.concat(F.lit("p95 align_err_ms="), fixed("p95_ms", 1), F.lit(f" > {max_ms}")))


def check_title_fit(hooks: DataFrame, media: DataFrame) -> DataFrame:
    """Titles too long for the safe area by characters, else by estimated width; no title passes."""
    rows = hooks.select(*IDS, F.col("hook.title").alias("title")).join(media.select(*IDS, "width"), list(IDS))
    n = F.length("title")
    wide = n * CHAR_PX
    detail = F.when(n > TITLE_CHARS, F.format_string(f"hook title is %d chars, max {TITLE_CHARS}", n)).when(
        wide > F.col("width") * WIDTH_FRAC,
        F.concat(F.lit("hook title estimated width "), fixed(wide, 0), F.lit("px > "), fixed(F.col("width") * WIDTH_FRAC, 0),
                 F.lit("px (90% of "), F.col("width").cast("string"), F.lit("px frame)")))
    return _fail(rows.where(detail.isNotNull()), "SAFE_AREA", detail)


def check_defects(defects: DataFrame) -> DataFrame:
    """Clips with black or frozen spans: ``video_id, cand_id, kind, pos, t0, t1``."""
    span = F.concat(F.lit("Span(t0="), F.col("t0").cast("string"), F.lit(", t1="), F.col("t1").cast("string"), F.lit(")"))
    per = defects.where(F.col("kind").isin("black", "frozen")).groupBy(*IDS, "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", span.alias("s")))), lambda x: x.s).alias("ss"))
    detail = F.concat(F.size("ss").cast("string"), F.lit(" "), F.col("kind"), F.lit(" span(s): ["), F.array_join("ss", ", "), F.lit("]"))
    out = [_fail(per.where(F.col("kind") == k), k.upper(), detail) for k in ("black", "frozen")]
    return out[0].unionByName(out[1])


def qa_failures(cuts: DataFrame, sig: Signals, render: DataFrame | None = None, hooks: DataFrame | None = None,
                defects: DataFrame | None = None, width: float = 64.0) -> DataFrame:
    """All failures of all cuts; checks without an input table are left out."""
    parts = [check_word_clip(cuts, sig.words, width), check_alignment(cuts, sig.words, sig.media, width=width)]
    if render is not None:
        parts += [check_resolution(render), check_duration(render), check_loudness(render)]
        if hooks is not None:
            parts.append(check_title_fit(hooks, render))
    if defects is not None:
        parts.append(check_defects(defects))
    return reduce(lambda a, b: a.unionByName(b), parts)


def qa_report(cuts: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per cut: passed, failures in check order, and the joined codes as dropped reason."""
    per = failures.groupBy(*IDS).agg(F.array_sort(F.collect_list(F.struct("ord", "code", "detail", "route_to"))).alias("fs"))
    out = cuts.select(*IDS).join(per, list(IDS), "left")
    fs = F.coalesce("fs", F.array().cast("array<struct<ord:int,code:string,detail:string,route_to:string>>"))
    codes = F.transform(fs, lambda x: x.code)
    return out.select(*IDS, (F.size(fs) == 0).alias("passed"), codes.alias("codes"), F.transform(fs, lambda x: x.detail).alias("details"),
                      F.when(F.size(fs) > 0, F.array_join(codes, "; ")).alias("dropped_reason"), route_of(codes).alias("route"))


def route_of(codes: Column) -> Column:
    """Repair route of a set of codes: surgeon if any, else render if any, else drop; null when there are none."""
    to = {s: [c for c, r in ROUTES.items() if r == s] for s in ("surgeon", "render")}
    has = lambda s: F.arrays_overlap(codes, F.array(*[F.lit(c) for c in to[s]]))
    return F.when(F.size(codes) == 0, F.lit(None)).when(has("surgeon"), "surgeon").when(has("render"), "render").otherwise("drop")


def repair_route(failures: DataFrame) -> DataFrame:
    """Route per clip from its failure rows."""
    rank = F.max(F.when(F.col("route_to") == "surgeon", 2).when(F.col("route_to") == "render", 1).otherwise(0))
    out = failures.groupBy(*IDS).agg(rank.alias("_r"))
    return out.select(*IDS, F.when(F.col("_r") == 2, "surgeon").when(F.col("_r") == 1, "render").otherwise("drop").alias("route"))


def repair_history(checks: DataFrame, limit: int = MAX_REPAIRS) -> DataFrame:
    """Repair attempts per clip from its successive checks ``video_id, cand_id, check_no, codes``.

    Attempt *n* answers check *n - 1* and is judged by check *n*; a drop-routed or passed check ends it.
    """
    w = W.partitionBy(*IDS).orderBy("check_no")
    rows = checks.where(F.col("check_no") <= limit).withColumn("before", F.lag("codes").over(w))
    rows = rows.withColumn("_r", route_of(F.col("before"))).withColumn(
        "_stop", F.max(F.when((F.col("check_no") > 0) & (F.col("_r").isNull() | (F.col("_r") == "drop")), 1).otherwise(0)).over(
            w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    live = rows.where((F.col("check_no") > 0) & (F.col("_stop") == 0))
    entry = F.struct(
        F.col("check_no").cast("int").alias("attempt"), F.col("before").alias("codes"), F.col("_r").alias("route"),
        F.when(F.size("codes") == 0, "fixed").otherwise("failed").alias("outcome"))
    return live.groupBy(*IDS).agg(F.array_sort(F.collect_list(entry)).alias("repairs"))


def repair_pass(cuts: DataFrame, sig: Signals, width: float = 64.0, settle=lambda df: df):
    """Two unrolled rounds of check, repair and check again: ``(cuts, remaining failures)``.

    ``settle`` may store each round's cuts (for example ``DataFrame.checkpoint``).
    """
    for _ in range(MAX_REPAIRS):
        bad = qa_failures(cuts, sig, width=width).select(*IDS, "code")
        cuts = settle(repair(cuts, bad, sig, width=width))
    return cuts, qa_failures(cuts, sig, width=width)
