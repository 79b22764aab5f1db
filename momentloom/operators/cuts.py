"""Snap window edges to speech: sentence and silence boundaries, whole words, length bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.functions.expr import ends_sentence
from momentloom.operators.series import as_spans
from momentloom.operators.stored import settle
from momentloom.operators.timeline import Edge, inside_word, interval_pairs, lookup
from momentloom.schemas import Signals

# Limits of the cut stage, in seconds.
MIN_SILENCE = 0.3
SILENCE_BACK = 5.0
FILLER_SCAN = 2.0
ROOM = 0.8
TIE = 2.0
MIN_DUR = 30.0
MAX_DUR = 90.0
SENTENCE_LEAD = 10.0
SENTENCE_TAIL = 12.0
ALIGN_MAX_MS = 300.0

#: Cells of joins of words with spans of their own length, in seconds: a cell holds a few words.
FINE = 2.0

IDS = ("video_id", "cand_id")


def ask(df: DataFrame, roles: dict[str, Column], edges: list[Edge], ids=IDS) -> DataFrame:
    """One lookup for several times of each row: adds ``<role>_<edge>`` for every pair.

    The row itself travels with its first role only and is put together again by key.
    """
    ids = list(ids)
    df = settle(df, "asked")
    row = F.struct(*[c for c in df.columns if c not in ids])
    points = [
        F.struct(F.lit(r).alias("role"), t.cast("double").alias("t"), (row if i == 0 else F.lit(None)).alias("row"))
        for i, (r, t) in enumerate(roles.items())
    ]
    asked = df.select(*ids, F.explode(F.array(*points)).alias("x")).select(*ids, "x.role", "x.t", "x.row")
    found = lookup(asked, edges)
    wide = [F.max(F.when(F.col("role") == r, F.col(e.name))).alias(f"{r}_{e.name}") for r in roles for e in edges]
    out = found.groupBy(*ids).agg(F.first("row", ignorenulls=True).alias("row"), *wide)
    return out.select(*ids, "row.*", *[f"{r}_{e.name}" for r in roles for e in edges])


def sentence_ends(words: DataFrame) -> DataFrame:
    return words.where(ends_sentence("text")).select("video_id", "t1")


def edges_of(sig: Signals, *names: str) -> list[Edge]:
    """The speech edges of these names. Ends of sentences, and pauses outside of words, are looked for once and stored, if they are among them."""
    words = sig.words.select("video_id", "pos", "t0", "t1")
    quiet = sig.kind("silence")
    ends = clean = None
    if "sentence_before" in names or "sentence_after" in names:
        ends = settle(sentence_ends(sig.words), "sentences")
    if "silence_before" in names:
        long = quiet.where(F.col("t1") - F.col("t0") >= MIN_SILENCE).select("video_id", F.col("t1").alias("t"))
        clean = settle(inside_word(long, as_spans(words)).where(~F.col("mid_word")), "pauses")
    every = {
        "sentence_before": Edge("sentence_before", ends, "t1", "t1", "before"),
        "sentence_after": Edge("sentence_after", ends, "t1", "t1", "after"),
        "silence_before": Edge("silence_before", clean, "t", "t", "before"),
        "any_silence_before": Edge("any_silence_before", quiet, "t1", "t1", "before"),
        "word_before": Edge("word_before", words, "t0", "t0", "before"),
        "start_after": Edge("start_after", words, "t0", "t0", "after"),
        "end_after": Edge("end_after", words, "t1", "t1", "after"),
        "last_pos": Edge("last_pos", words, "t0", "pos", "before", keep="max"),
        "reach": Edge("reach", words, "t0", "t1", "before", strict=True, keep="max"),
    }
    return [every[n] for n in names]


def sentence_start(points: DataFrame, sig: Signals, lead: float = SENTENCE_LEAD) -> DataFrame:
    """Start of the sentence holding ``t``, at most ``lead`` back; null without an earlier sentence end."""
    out = settle(lookup(points, edges_of(sig, "sentence_before")), "ends")
    out = lookup(out, edges_of(sig, "start_after"), t="sentence_before")
    back = F.col("t") - F.col("start_after")
    return out.select(*points.columns, F.when((back >= 0) & (back <= lead), F.col("start_after")).alias("sentence_start"))


def sentence_end(points: DataFrame, sig: Signals, tail: float = SENTENCE_TAIL) -> DataFrame:
    """First sentence end at or after ``t``, at most ``tail`` ahead."""
    out = lookup(points, edges_of(sig, "sentence_after"))
    end = F.col("sentence_after")
    return out.select(*points.columns, F.when(end - F.col("t") <= tail, end).alias("sentence_end"))


def silence_edge(points: DataFrame, sig: Signals, back: float = SILENCE_BACK) -> DataFrame:
    """End of the last real pause before ``t`` that does not fall inside a word."""
    out = lookup(points, edges_of(sig, "silence_before"))
    e = F.col("silence_before")
    return out.select(*points.columns, F.when(F.col("t") - e <= back, e).alias("silence_edge"))


def word_start(points: DataFrame, sig: Signals) -> DataFrame:
    """Start of the last word beginning at or before ``t``."""
    return lookup(points, edges_of(sig, "word_before")).withColumnRenamed("word_before", "word_start")


def _open_choice(t: Column, start: Column, silence: Column, word: Column) -> Column:
    back = t - start
    sentence = F.when((back >= 0) & (back <= SENTENCE_LEAD), start)
    near = F.when(t - silence <= SILENCE_BACK, silence)
    both = F.when(F.abs(near - word) <= TIE, F.least(near, word))
    return F.coalesce(sentence, both, near, word, t)


def snap_open(rows: DataFrame, sig: Signals, t: str = "t0", name: str = "open") -> DataFrame:
    """Opening edge: sentence start, else pause or word start, the earlier when close together, else unchanged."""
    cols = rows.columns
    out = ask(rows, {"o": F.col(t)}, edges_of(sig, "sentence_before", "silence_before", "word_before"))
    out = ask(out, {"s": F.col("o_sentence_before")}, edges_of(sig, "start_after"))
    choice = _open_choice(F.col(t), F.col("s_start_after"), F.col("o_silence_before"), F.col("o_word_before"))
    return out.select(*cols, choice.alias(name))


def filler_words(sig: Signals, width: float = FINE) -> DataFrame:
    """Words lying inside a filler span."""
    words = sig.words.select("video_id", "pos", F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    spans = sig.kind("filler").select("video_id", "t0", "t1")
    hit = interval_pairs(spans, words, "t0", "t1", "s0", "s1", (F.col("t0") <= F.col("s0")) & (F.col("s1") <= F.col("t1")), width=width)
    return hit.select("video_id", "pos", F.col("s0").alias("t0"), F.col("s1").alias("t1")).distinct()


def _first_word(points: DataFrame, words: DataFrame, t: str, scan: float, ids: list[str], width: float) -> DataFrame:
    """First word heard in ``[t, t + scan]`` per point; points without one drop out."""
    pts = points.select(*ids, F.col(t).alias("_f0"), (F.col(t) + scan).alias("_f1"))
    pairs = interval_pairs(pts, words, "_f0", "_f1", "s0", "s1", (F.col("s0") < F.col("_f1")) & (F.col("s1") > F.col("_f0")), width=width)
    return pairs.groupBy(*ids, F.col("_f0").alias(t)).agg(F.min(F.struct("s0", "pos", "s1")).alias("w"))


def strip_fillers(opens: DataFrame, sig: Signals, t: str = "open", scan: float = FILLER_SCAN, width: float = FINE) -> DataFrame:
    """Move opening edges past leading filler words.

    Each filler word leads to the next word start.  Such a start is final unless its own first word
    is a filler again, so a run of fillers ends at the first final start: a forward lookup instead
    of a loop.
    """
    opens = settle(opens, "opens")
    cols = opens.columns
    words = sig.words.select("video_id", "pos", F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    fillers = settle(filler_words(sig, width), "fillers")
    nexts = settle(lookup(fillers, [Edge("next", words, "s0", "s0", "after", strict=True)], t="t0"), "nexts")
    starts = nexts.where(F.col("next").isNotNull()).select("video_id", "next").distinct()
    heads = _first_word(starts, words, "next", scan, ["video_id"], width)
    heads = heads.select("video_id", "next", F.col("w.pos").alias("pos"), F.col("w.s0").alias("h0"))
    again = heads.where(F.col("h0") >= F.col("next")).join(fillers.select("video_id", "pos"), ["video_id", "pos"], "left_semi")
    final = settle(starts.join(again.select("video_id", "next"), ["video_id", "next"], "left_anti"), "final")
    tail = fillers.groupBy("video_id").agg(F.max_by("t1", F.struct("t0", "pos")).alias("tail"))

    first = _first_word(opens.select(*IDS, t), words, t, scan, list(IDS), width)
    first = first.select(*IDS, F.col("w.pos").alias("pos"))
    leading = settle(first.join(nexts.select("video_id", "pos", "next", "t1"), ["video_id", "pos"]), "leading")
    jump = lookup(leading, [Edge("final", final, "next", "next", "after")], t="next")
    jump = jump.join(tail, "video_id").select(
        *IDS, F.when(F.col("next").isNull(), F.col("t1")).otherwise(F.coalesce("final", "tail")).alias("_jump"))
    out = opens.join(jump, list(IDS), "left")
    return out.select(*[F.coalesce("_jump", t).alias(t) if c == t else F.col(c) for c in cols])


def _close_target(t: Column, sentence: Column, end: Column) -> Column:
    return F.coalesce(F.when(sentence - t <= SENTENCE_TAIL, sentence), end)


def _with_room(t: Column, target: Column, following: Column) -> Column:
    gap = F.coalesce(following - target, F.lit(ROOM))
    return F.when(target.isNull(), t).otherwise(target + F.least(F.lit(ROOM), F.greatest(F.lit(0.0), gap)))


def snap_close(rows: DataFrame, sig: Signals, t: str = "t1", name: str = "close") -> DataFrame:
    """Closing edge: sentence end, else word end, plus room up to the next word; unchanged past the last word."""
    cols = rows.columns
    out = ask(rows, {"c": F.col(t)}, edges_of(sig, "sentence_after", "end_after"))
    out = out.withColumn("_target", _close_target(F.col(t), F.col("c_sentence_after"), F.col("c_end_after")))
    out = ask(out, {"n": F.col("_target")}, edges_of(sig, "start_after"))
    return out.select(*cols, _with_room(F.col(t), F.col("_target"), F.col("n_start_after")).alias(name))


def clamp_cut(rows: DataFrame, t0: str = "t0", t1: str = "t1", min_dur: float = MIN_DUR, max_dur: float = MAX_DUR) -> DataFrame:
    """Media bounds first, then length bounds: short cuts grow at the end, then at the start; long ones lose their end."""
    zero, dur = F.lit(0.0), F.col("duration_s")
    a = F.greatest(zero, F.least(F.col(t0), dur))
    b = F.greatest(zero, F.least(F.col(t1), dur))
    out = rows.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    span = F.col("_b") - F.col("_a")
    grown = F.least(dur, F.col("_a") + min_dur)
    new1 = F.when(span < min_dur, grown).when(span > max_dur, F.col("_a") + max_dur).otherwise(F.col("_b"))
    new0 = F.when(span < min_dur, F.greatest(zero, grown - min_dur)).otherwise(F.col("_a"))
    out = out.withColumn("_n0", new0).withColumn("_n1", new1)
    return out.select(*[F.col("_n0").alias(c) if c == t0 else F.col("_n1").alias(c) if c == t1 else F.col(c) for c in rows.columns])


def reopen_on_speech(rows: DataFrame, sig: Signals, before: str, max_dur: float = MAX_DUR) -> DataFrame:
    """Where the length floor moved ``t0`` before ``before``, go back to the last pause end or word start."""
    out = ask(rows, {"r": F.when(F.col("t0") < F.col(before), F.col("t0"))}, edges_of(sig, "any_silence_before", "word_before"))
    edge = F.greatest("r_any_silence_before", "r_word_before")
    floor = F.greatest(F.lit(0.0), F.col("t1") - max_dur)
    moved = F.when((F.col("t0") < F.col(before)) & (edge >= floor), edge)
    return out.select(*[F.coalesce(moved, F.col("t0")).alias("t0") if c == "t0" else F.col(c) for c in rows.columns])


def payoff_time(evidence: Column) -> Column:
    """Time of the strongest peak claim (first on a tie), else of the first claim."""
    peaks = F.filter(evidence, lambda c: (c.kind == "energy_peak") & c.value_num.isNotNull())
    best = F.aggregate(
        peaks, F.lit(None).cast("struct<s:double,t:double>"),
        lambda acc, c: F.when(acc.isNull() | (F.abs(c.value_num) > acc.s), F.struct(F.abs(c.value_num).alias("s"), c.t.alias("t"))).otherwise(acc))
    return F.coalesce(best["t"], F.get(evidence, F.lit(0))["t"])


def payoff_word(cands: DataFrame, sig: Signals) -> DataFrame:
    """Last word position at or before the payoff claim; null without claims."""
    cols = cands.columns
    out = ask(cands, {"p": payoff_time(F.col("evidence"))}, edges_of(sig, "last_pos"))
    return out.select(*cols, F.col("p_last_pos").alias("payoff_word_i"))


def refine(cands: DataFrame, sig: Signals, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR, width: float = FINE) -> DataFrame:
    """Cuts for all candidates: one scan of the words answers opening, closing and payoff together."""
    rows = cands.select(*IDS, "t0", "t1", "evidence").join(sig.media.select("video_id", "duration_s"), "video_id")
    got = ask(
        rows, {"o": F.col("t0"), "c": F.col("t1"), "p": payoff_time(F.col("evidence"))},
        edges_of(sig, "sentence_before", "silence_before", "word_before", "sentence_after", "end_after", "last_pos"))
    got = got.select(
        *IDS, "duration_s", "t0", "t1", F.col("p_last_pos").alias("payoff_word_i"),
        "o_sentence_before", "o_silence_before", "o_word_before",
        _close_target(F.col("t1"), F.col("c_sentence_after"), F.col("c_end_after")).alias("_target"))
    got = ask(got, {"s": F.col("o_sentence_before"), "n": F.col("_target")}, edges_of(sig, "start_after"))
    snapped = got.select(
        *IDS, "duration_s", "payoff_word_i",
        _open_choice(F.col("t0"), F.col("s_start_after"), F.col("o_silence_before"), F.col("o_word_before")).alias("open"),
        _with_room(F.col("t1"), F.col("_target"), F.col("n_start_after")).alias("t1"))
    stripped = strip_fillers(snapped, sig, "open", width=width)
    clamped = clamp_cut(stripped.withColumn("t0", F.col("open")), min_dur=min_dur, max_dur=max_dur)
    out = reopen_on_speech(clamped, sig, "open", max_dur)
    return out.select(*IDS, "t0", "t1", "payoff_word_i")


# --- repair ---------------------------------------------------------------------------------------


def repair_word_clip(cuts: DataFrame, sig: Signals, width: float = FINE) -> DataFrame:
    """Snap again only the edges that fall inside a word: one scan of the words tells which they are and what lies around both edges."""
    got = ask(cuts, {"a": F.col("t0"), "b": F.col("t1")},
              edges_of(sig, "reach", "sentence_before", "silence_before", "word_before", "sentence_after", "end_after"))
    got = got.select(
        *cuts.columns, F.coalesce(F.col("a_reach") > F.col("t0"), F.lit(False)).alias("_cut0"), F.coalesce(F.col("b_reach") > F.col("t1"), F.lit(False)).alias("_cut1"),
        "a_sentence_before", "a_silence_before", "a_word_before", _close_target(F.col("t1"), F.col("b_sentence_after"), F.col("b_end_after")).alias("_target"))
    got = ask(got, {"s": F.when(F.col("_cut0"), F.col("a_sentence_before")), "n": F.when(F.col("_cut1"), F.col("_target"))}, edges_of(sig, "start_after"))
    opened = _open_choice(F.col("t0"), F.col("s_start_after"), F.col("a_silence_before"), F.col("a_word_before"))
    closed = _with_room(F.col("t1"), F.col("_target"), F.col("n_start_after"))
    new = {"t0": F.when(F.col("_cut0"), opened).otherwise(F.col("t0")), "t1": F.when(F.col("_cut1"), closed).otherwise(F.col("t1"))}
    snapped = settle(got.select(*[new[c].alias(c) if c in new else F.col(c) for c in cuts.columns], "_cut0"), "snapped")
    moved = strip_fillers(snapped.where("_cut0"), sig, "t0", width=width)
    return snapped.where("not _cut0").unionByName(moved).select(*cuts.columns)


def best_run(t0: np.ndarray, t1: np.ndarray, bad: np.ndarray) -> tuple[float, float] | None:
    """Longest span of consecutive words with an acceptable p95, by their times in order of start; the earliest on a tie.

    ``bad`` marks words over the bar. The p95 of words i to j is within it if at most (j - i) / 20, rounded up, are bad:
    j - 20 * (bad up to j) + 20 > i - 20 * (bad before i). A start is worth a look only if that right side is less than
    at all starts before, an end only if the left side is more than at all ends after; each start takes the last end it may.
    """
    i, upto = np.arange(len(t0)), np.cumsum(bad)
    tail, head = i - 20 * upto + 20, i - 20 * (upto - bad)
    starts = np.flatnonzero(np.diff(np.minimum.accumulate(head), prepend=head[0] + 1) < 0)
    if (t1[1:] < t1[:-1]).any():  # a word ends before an earlier one: look at all ends of each start
        ends = np.array([k + np.argmax(np.where(tail[k:] > head[k], t1[k:], -np.inf)) for k in starts])
        sure = tail[ends] > head[starts]
    else:
        after = np.maximum.accumulate(tail[::-1])[::-1]
        ends = np.flatnonzero(np.diff(after, append=after[-1] - 1) < 0)
        at = np.searchsorted(-tail[ends], -head[starts]) - 1
        ends = ends[at]
        sure = (at >= 0) & (ends >= starts)
    span = np.where(sure, t1[ends] - t0[starts], 0.0)
    best = int(np.argmax(span))  # the first of equal spans
    return (float(t0[starts[best]]), float(t1[ends[best]])) if span[best] > 0 else None


def _best_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``best_run`` of each cut; rows come cut by cut and in order of start, and words of one cut are held at a time."""
    out, held = pa.schema([("video_id", pa.string()), ("cand_id", pa.string()), ("run_t0", pa.float64()), ("run_t1", pa.float64())]), []

    def runs(table: pa.Table, edges: list[int]) -> pa.RecordBatch:
        a, b, bad = (table.column(c).to_numpy() for c in ("s0", "s1", "bad"))
        names = table.select(list(IDS)).take(edges[:-1]).to_pylist()
        found = [(n["video_id"], n["cand_id"], best_run(a[i:j], b[i:j], bad[i:j])) for n, i, j in zip(names, edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_pylist([dict(zip(out.names, (v, c, *r), strict=True)) for v, c, r in found if r], out)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        new = np.zeros(len(table), bool)
        for c in IDS:
            x = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        if held:
            new[0] = any(held[-1].column(c)[0] != table.column(c)[0] for c in IDS)
        marks = np.flatnonzero(new)
        if not len(marks):  # all of the cut that is held
            held.append(table)
            continue
        whole = pa.concat_tables([*held, table.slice(0, int(marks[-1]))])
        lead = len(whole) - int(marks[-1])
        if len(whole):
            yield runs(whole, sorted({0, *(marks + lead).tolist()}))
        held = [table.slice(int(marks[-1]))]
    if held:
        whole = pa.concat_tables(held)
        yield runs(whole, [0, len(whole)])


def best_aligned_run(cuts: DataFrame, words: DataFrame, max_ms: float = ALIGN_MAX_MS, width: float = 64.0) -> DataFrame:
    """Longest stretch of words in each cut whose p95 error is acceptable; the earliest on a tie.

    Work grows with the words of the cuts; a task holds the words of one cut, at most the cut's length of speech, and a batch.
    """
    timed = words.where(F.col("align_err_ms").isNotNull()).select(
        "video_id", "pos", F.col("t0").alias("s0"), F.col("t1").alias("s1"), (F.col("align_err_ms") > max_ms).cast("int").alias("bad"))
    pairs = interval_pairs(cuts.select(*IDS, "t0", "t1"), timed, "t0", "t1", "s0", "s1",
                           (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0")), width=width)
    ordered = pairs.select(*IDS, "pos", "s0", "s1", "bad").repartition(*IDS).sortWithinPartitions(*IDS, "s0", "pos")
    return ordered.select(*IDS, "s0", "s1", "bad").mapInArrow(_best_runs, "video_id string, cand_id string, run_t0 double, run_t1 double")


def repair(cuts: DataFrame, failures: DataFrame, sig: Signals, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR, width: float = 64.0) -> DataFrame:
    """Revised cuts for clips with surgeon-routed failures; the others pass unchanged.

    ``failures`` has ``video_id, cand_id, code``.
    """
    codes = failures.groupBy(*IDS).agg(
        F.max(F.col("code") == "WORD_CLIP").alias("_wc"), F.max(F.col("code") == "ALIGN").alias("_al"))
    cols = cuts.columns
    marked = settle(cuts.join(codes, list(IDS), "left"), "marked")
    due = F.coalesce(F.col("_wc") | F.col("_al"), F.lit(False))
    same = marked.where(~due).select(*cols)
    work = marked.where(due)
    fixed = settle(repair_word_clip(work.where("_wc"), sig).unionByName(work.where("not _wc")), "fixed")
    runs = best_aligned_run(fixed.where("_al"), sig.words, width=width)
    fixed = fixed.join(runs, list(IDS), "left")
    take = F.col("_al") & (F.col("run_t1") - F.col("run_t0") >= min_dur)
    fixed = fixed.withColumn("t0", F.when(take, F.col("run_t0")).otherwise(F.col("t0"))).withColumn(
        "t1", F.when(take, F.col("run_t1")).otherwise(F.col("t1")))
    fixed = fixed.select(*cols).withColumn("_before", F.col("t0")).join(sig.media.select("video_id", "duration_s"), "video_id")
    out = reopen_on_speech(clamp_cut(fixed, min_dur=min_dur, max_dur=max_dur), sig, "_before", max_dur)
    return same.unionByName(out.select(*cols))
