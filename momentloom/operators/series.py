"""Curves, spans and segmentation of many timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentloom.operators import folds
from momentloom.operators.stored import settle
from momentloom.operators.timeline import KEY, Edge, lookup, running

# Filler words and the two-word filler.
FILLER = r"(?i)^(um|uh|like)[,.]?$"
FILLER_PAIR = (r"(?i)^you$", r"(?i)^know[,.]?$")

# Lowest probability that counts as an event, per class.
EVENT_THRESHOLDS = {"laughter": 0.05, "applause": 0.5}

#: Relative error of sums and variances that decides nothing: their last digits depend on the order in which parts are merged.
NOISE = 1e-12


def as_spans(df: DataFrame, *keep: str) -> DataFrame:
    """``t0, t1`` renamed to ``s0, s1`` for the right side of a temporal join."""
    return df.select("video_id", *keep, F.col("t0").alias("s0"), F.col("t1").alias("s1"))


def rms_curve(samples: DataFrame, hop: int) -> DataFrame:
    """Root mean square of centred frames two hops long, zero-padded at both ends.

    A sample falls in exactly two frames, so this is a partial aggregate over exploded rows;
    no chunking is needed to bound memory.
    """
    i = F.floor(F.col("n") / hop)
    frames = (
        samples.select("video_id", "n", "x", F.explode(F.array(i, i + 1)).alias("i"))
        .groupBy("video_id", "i")
        .agg(F.sum(F.col("x") * F.col("x")).alias("sq"), F.max("n").alias("last_n"))
    )
    size = frames.groupBy("video_id").agg(F.floor((F.max("last_n") + 1) / hop).alias("last_i"))
    return frames.join(size, "video_id").where(F.col("i") <= F.col("last_i")).select(
        "video_id", "i", F.sqrt(F.col("sq") / (2 * hop)).alias("v")
    )


def overlapping_chunks(media: DataFrame, chunk_s: float = 600.0, overlap_s: float = 5.0) -> DataFrame:
    """Fixed-size pieces of each timeline that overlap their neighbour; the last one is cut short."""
    step = chunk_s - overlap_s
    n = F.when(F.col("duration_s") <= chunk_s, F.lit(1)).otherwise(F.ceil((F.col("duration_s") - overlap_s) / step))
    c = media.select("video_id", "duration_s", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("chunk"))
    return c.select(
        "video_id", "chunk", (F.col("chunk") * step).alias("t0"),
        F.least(F.col("chunk") * step + chunk_s, F.col("duration_s")).alias("t1"),
    )


def stitch_chunks(chunk_values: DataFrame, overlap_frames: int) -> DataFrame:
    """One curve from per-chunk curves: later chunks lose their head, positions are renumbered.

    The offset of a chunk comes from per-chunk counts, not from numbering the values.
    """
    kept = chunk_values.where((F.col("chunk") == 0) | (F.col("i") >= overlap_frames))
    sizes = kept.groupBy("video_id", "chunk").agg(F.count("*").alias("size"), F.min("i").alias("head"))
    sizes = running(sizes, "upto", "chunk", "size").withColumn("off", F.col("upto") - F.col("size"))
    return kept.join(sizes.select("video_id", "chunk", "head", "off"), ["video_id", "chunk"]).select(
        "video_id", (F.col("off") + F.col("i") - F.col("head")).alias("i"), "v"
    )


def rolling_zscore(curve: DataFrame, window: int, block: int | None = None) -> DataFrame:
    """z-score against a centred window of ``window // 2`` values on each side, shrinking at the ends.

    The curve is cut into blocks; each value is also sent to the blocks within reach, so every
    block holds its whole neighbourhood.  Inside a block the window sums are differences of
    running sums: constant work per value whatever the window.
    """
    half = window // 2
    block = block or max(4096, 4 * half)
    i = F.col("i")
    spread = curve.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.greatest(i - half, F.lit(0)) / block), F.floor((i + half) / block)))
    )
    w = W.partitionBy("video_id", "_b").orderBy("i")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("video_id", "_b")
    sums = spread.select(
        "*", F.sum("v").over(upto).alias("_c1"), F.sum(F.col("v") * F.col("v")).over(upto).alias("_c2"),
        F.row_number().over(w).alias("_r"), F.count("*").over(whole).alias("_n"),
        F.sum("v").over(whole).alias("_t1"), F.sum(F.col("v") * F.col("v")).over(whole).alias("_t2"),
    )
    hi = lambda c, t: F.coalesce(F.lead(c, half).over(w), F.col(t))
    lo = lambda c: F.coalesce(F.lag(c, half + 1).over(w), F.lit(0.0))
    stats = sums.select(
        "video_id", "i", "v", "_b",
        (F.least(F.col("_r") + half, F.col("_n")) - F.greatest(F.col("_r") - half - 1, F.lit(0))).alias("_cnt"),
        (hi("_c1", "_t1") - lo("_c1")).alias("_s1"), (hi("_c2", "_t2") - lo("_c2")).alias("_s2"),
    ).where(F.col("_b") == F.floor(i / block))
    mean = F.col("_s1") / F.col("_cnt")
    std = F.sqrt(F.greatest(F.col("_s2") / F.col("_cnt") - mean * mean, F.lit(0.0)))
    return stats.select("video_id", "i", "v", F.when(std > 1e-9, (F.col("v") - mean) / std).otherwise(0.0).alias("z"))


def energy_peaks(curve: DataFrame, hop_s: float = 0.05, window_s: float = 30.0, sigma: float = 2.0) -> DataFrame:
    """Values standing out by more than ``sigma`` from their surroundings."""
    z = rolling_zscore(curve, round(window_s / hop_s))
    return z.where(F.col("z") > sigma).select("video_id", (F.col("i") * hop_s).alias("t"), F.col("z").alias("sigma"))


def _grid(media: DataFrame, hop_s: float) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_s") / hop_s)).cast("bigint")
    return media.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))


def rate_curve(words: DataFrame, media: DataFrame, hop_s: float = 1.0) -> DataFrame:
    """Words per second on a dense grid; words are counted per bucket before meeting the grid."""
    counts = words.groupBy("video_id", F.floor(F.col("t0") / hop_s).alias("i")).agg(F.count("*").alias("n"))
    return _grid(media, hop_s).join(counts, ["video_id", "i"], "left").select(
        "video_id", "i", (F.col("i") * hop_s).alias("t"), (F.coalesce("n", F.lit(0)) / F.lit(hop_s)).alias("v")
    )


def bucket_variance(f0: DataFrame, media: DataFrame, frame_hop_s: float, hop_s: float = 1.0) -> DataFrame:
    """Population variance of the voiced frames of each bucket, 0 with fewer than two."""
    edge = lambda k: F.bround(k * F.lit(hop_s) / F.lit(frame_hop_s), 0)
    k0 = F.floor(F.col("i") * frame_hop_s / hop_s)
    placed = (
        f0.where(F.col("f").isNotNull() & ~F.isnan("f"))
        .select("video_id", "i", "f", F.explode(F.array(k0 - 1, k0, k0 + 1)).alias("k"))
        .where((F.col("i") >= edge(F.col("k"))) & (F.col("i") < edge(F.col("k") + 1)))
    )
    var = placed.groupBy("video_id", F.col("k").alias("i")).agg(F.var_pop("f").alias("var"), F.count("*").alias("n"))
    return _grid(media, hop_s).join(var, ["video_id", "i"], "left").select(
        "video_id", "i", (F.col("i") * hop_s).alias("t"),
        F.when(F.coalesce("n", F.lit(0)) < 2, 0.0).otherwise(F.col("var")).alias("v"),
    )


def runs_where(curve: DataFrame, predicate: Column, hop_s: float = 1.0, min_duration_s: float = 0.0, keys=KEY) -> DataFrame:
    """Maximal runs of consecutive buckets passing ``predicate``, with the highest value inside.

    A run starts where its left neighbour is missing; every hit finds the start before it, and
    the run is an aggregate over that start.  No window spans a whole timeline.
    """
    keys = list(keys)
    hits = settle(curve.where(predicate).select(*keys, F.col("i").cast("bigint").alias("i"), "v"), "hits")
    starts = hits.select(*keys, "i").join(hits.select(*keys, (F.col("i") + 1).alias("i")), keys + ["i"], "left_anti")
    runs = lookup(hits, [Edge("start", starts, "i", "i")], t="i", keys=keys)
    runs = runs.groupBy(*keys, "start").agg(F.max("i").alias("stop"), F.max("v").alias("peak"))
    return runs.select(
        *keys, (F.col("start") * hop_s).alias("t0"), ((F.col("stop") + 1) * hop_s).alias("t1"), "peak"
    ).where(F.col("t1") - F.col("t0") >= min_duration_s)


def _with_spread(curve: DataFrame) -> DataFrame:
    stats = curve.groupBy("video_id").agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std"))
    return curve.join(stats, "video_id")


def _beyond(sign: int, k: float) -> Column:
    """Values more than ``k`` deviations above (1) or below (-1) the mean; one that lies exactly there does not, whatever the last digits."""
    mean, reach = F.col("_mean"), k * F.col("_std")
    return sign * (F.col("v") - mean) > reach + NOISE * (F.abs(mean) + reach)


def surges(curve: DataFrame, hop_s: float = 1.0, k: float = 1.0, min_duration_s: float = 3.0) -> DataFrame:
    """Stretches well above the timeline's own mean."""
    return runs_where(_with_spread(curve), _beyond(1, k), hop_s, min_duration_s)


def monotone(curve: DataFrame, hop_s: float = 1.0, k: float = 1.0, min_duration_s: float = 10.0) -> DataFrame:
    """Stretches well below the timeline's own mean."""
    return runs_where(_with_spread(curve), _beyond(-1, k), hop_s, min_duration_s)


def threshold_events(probs: DataFrame, hop_s: float, thresholds: dict[str, float] = EVENT_THRESHOLDS) -> DataFrame:
    """Labelled spans of consecutive frames at or above their class threshold; ``conf`` is the run's best."""
    bar = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("label")]
    hits = runs_where(probs.withColumnRenamed("p", "v"), F.col("v") >= bar, hop_s, keys=("video_id", "label"))
    return hits.withColumnRenamed("peak", "conf")


def interval_complement(spans: DataFrame, media: DataFrame) -> DataFrame:
    """What the spans leave uncovered inside ``[0, duration]``, including the tail."""
    heads = settle(spans.groupBy("video_id", "t0").agg(F.max("t1").alias("t1")), "heads")
    seen = lookup(heads, [Edge("cursor", heads, "t0", "t1", strict=True, keep="max")], t="t0")
    cursor = F.greatest(F.coalesce("cursor", F.lit(0.0)), F.lit(0.0))
    gaps = seen.where(F.col("t0") > cursor).select("video_id", cursor.alias("t0"), F.col("t0").alias("t1"))
    last = media.select("video_id", "duration_s").join(
        heads.groupBy("video_id").agg(F.greatest(F.max("t1"), F.lit(0.0)).alias("end")), "video_id", "left"
    ).select("video_id", F.coalesce("end", F.lit(0.0)).alias("t0"), F.col("duration_s").alias("t1"))
    return gaps.unionByName(last.where(F.col("t0") < F.col("t1")))


def segments_from_cuts(cut_points: DataFrame, media: DataFrame) -> DataFrame:
    """Contiguous segments between cut times, covering each timeline from 0 to its end."""
    inner = cut_points.join(media.select("video_id", "duration_s"), "video_id").where(
        (F.col("t") > 0) & (F.col("t") < F.col("duration_s"))
    ).select("video_id", "t").distinct()
    inner = settle(inner, "points")
    heads = inner.unionByName(media.select("video_id", F.lit(0.0).alias("t")))
    ends = inner.unionByName(media.select("video_id", F.col("duration_s").alias("t")))
    out = lookup(heads, [
        Edge("t1", ends, "t", "t", "after", strict=True),
        Edge("n", heads, "t", F.lit(1), strict=True, keep="sum"),
    ])
    return out.select("video_id", F.col("n").cast("int").alias("pos"), F.col("t").alias("t0"), "t1")


def vector_diff_curve(frames: DataFrame, scale: float = 255.0) -> DataFrame:
    """Mean absolute difference to the last readable frame; 0 for the first and for unreadable ones."""
    readable = frames.where(F.col("vec").isNotNull())
    prev = lookup(frames, [Edge("_prev", readable, "i", "vec", strict=True)], t="i")
    diffs = F.zip_with("vec", "_prev", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    mean = F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x) / F.size("vec") / scale
    return prev.select(
        "video_id", "i", F.when(F.col("vec").isNull() | F.col("_prev").isNull(), 0.0).otherwise(mean).alias("v")
    )


def filler_spans(words: DataFrame, single: str = FILLER, pair: tuple[str, str] = FILLER_PAIR) -> DataFrame:
    """Spans of filler words and of the two-word filler.

    The second word of the pair starts neither pattern, so no scan is needed; only words that can
    open or close the pair take part in the join.
    """
    one = words.where(F.col("text").rlike(single)).select("video_id", "pos", "t0", "t1")
    first = words.where(F.col("text").rlike(pair[0]) & ~F.col("text").rlike(single)).select("video_id", "pos", "t0")
    second = words.where(F.col("text").rlike(pair[1])).select("video_id", (F.col("pos") - 1).alias("pos"), "t1")
    return one.unionByName(first.join(second, ["video_id", "pos"]))


def alignment_error(words: DataFrame, aligned: DataFrame, media: DataFrame) -> DataFrame:
    """Milliseconds between the middles of a word and its aligned form; English letters only."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2 * 1000
    usable = (F.col("language") == "en") & (F.regexp_replace(F.lower("text"), "[^a-z']", "") != "")
    return (
        words.join(media.select("video_id", "language"), "video_id", "left")
        .join(aligned.select("video_id", "pos", "a0", "a1"), ["video_id", "pos"], "left")
        .select("video_id", "pos", "text", "t0", "t1",
                F.when(usable, F.abs(mid("t0", "t1") - mid("a0", "a1"))).alias("align_err_ms"))
    )


def span_batches(words: DataFrame, window_s: float = 60.0, pad_s: float = 1.0) -> DataFrame:
    """Greedy batches of consecutive words with their padded audio slice.

    A pause longer than the window always opens a batch, so each stretch between such pauses is
    scanned on its own.
    """
    parts = folds.gap_islands(words.select("video_id", "pos", "t0", "t1"), "t0", "t1", window_s)
    marked = folds.scan_groups(parts, ["video_id", "island"], ["pos"], folds.batch_step(window_s),
                               "pos bigint, batch int, t0 double, t1 double")
    return marked.groupBy("video_id", "island", "batch").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("n_words"),
        F.greatest(F.lit(0.0), F.min_by("t0", "pos") - pad_s).alias("slice_t0"),
        (F.max_by("t1", "pos") + pad_s).alias("slice_t1"),
    ).drop("island", "batch")


def dominant_track(faces: DataFrame, min_conf: float = 0.5, iou: float = 0.3) -> DataFrame:
    """Index of the followed box per sample.

    A sample without a strong box ends the track, so each stretch between such samples is scanned
    on its own.
    """
    strong = F.exists("boxes", lambda b: b.conf >= min_conf)
    flagged = faces.withColumn("_live", F.coalesce(strong, F.lit(False)))
    dead = flagged.where(~F.col("_live")).select("video_id", "t", F.lit(None).cast("int").alias("dominant"))
    live = flagged.where(F.col("_live")).select("video_id", "t", "boxes")
    live = lookup(live, [Edge("part", dead, "t", "t")]).fillna({"part": -1.0})
    tracked = folds.scan_groups(live, ["video_id", "part"], ["t"], folds.track_step(min_conf, iou), "t double, dominant int")
    return tracked.select("video_id", "t", "dominant").unionByName(dead)


def transcript_chunks(words: DataFrame, n: int = 2000, every: int = 10) -> DataFrame:
    """Text blocks of ``n`` words with a ``[seconds]`` mark before each ``every``-th word of the block."""
    j = F.pmod("pos", F.lit(n))
    mark = F.concat(F.lit("["), F.bround("t0", 0).cast("bigint").cast("string"), F.lit("s] "))
    token = F.when(F.pmod(j, F.lit(every)) == 0, F.concat(mark, "text")).otherwise(F.col("text"))
    return words.groupBy("video_id", F.floor(F.col("pos") / n).cast("int").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", token.alias("s")))), lambda x: x.s), " ").alias("text")
    )
