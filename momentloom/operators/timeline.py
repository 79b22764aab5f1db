"""Temporal joins over many timelines at once.

Every helper takes the timeline key as an equi key and cuts the time axis, so one very long or very busy timeline is
spread over many tasks:

* interval predicates become an equi join on ``(key, level, cell)``.  A span lies at the level of its length, where
  cells are as long as it is or longer, so it touches two of them at most; the other side looks once, in two cells at
  most, at every level in use from its own on.  So a span of a month costs as few rows as one of a second, and a
  pair meets at the higher of its two levels only; it is kept only in the first cell that both share.
* as-of lookups scan each ``(key, bucket)`` on its own.  Buckets follow the data: a timeline is one bucket unless it
  has more than ``DEPTH`` rows; then sketched quantiles of its times part it, so a burst within one second is parted
  like any other stretch.  What a bucket inherits from its neighbours comes from a directory with one row per bucket.

Adaptive execution splits a pair join whose cell is overfull. Rows of one timeline at exactly one time stay together in a scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentloom.functions.expr import col, interval_iou
from momentloom.operators.stored import settle

KEY = ("video_id",)
WIDTH = 64.0

#: How many times longer the cells of a level are than those of the level below.
STEP = 4.0

#: Rows of a timeline that a scan takes in one piece; the cut points of longer ones, one per half as many rows, are broadcast.
DEPTH = 1 << 18
_SKETCH = 1023


def cell(t: Column | str, level: Column, width: float) -> Column:
    return F.floor(col(t) / (F.lit(float(width)) * F.pow(F.lit(STEP), level))).cast("bigint")


def level_of(t0: str, t1: str, width: float) -> Column:
    """The lowest level whose cells are as long as the span."""
    ratio = F.greatest((F.col(t1) - F.col(t0)) / F.lit(float(width)), F.lit(1.0))
    return F.least(F.ceil(F.log(STEP, ratio)), F.lit(60)).cast("int")


def _levels(df: DataFrame, t0: str, t1: str, width: float) -> Column:
    """The levels in use, as one array for all rows of another table."""
    if t0 == t1:
        return F.array(F.lit(0))
    found = df.select(level_of(t0, t1, width).alias("level")).where("level is not null")
    return found.agg(F.sort_array(F.collect_set("level")).alias("levels")).scalar()


def _cells(df: DataFrame, entries: Column, t0: str, t1: str, width: float) -> DataFrame:
    """One row per entry (``level`` and ``side``) and cell that the span touches there, in ``_at`` and ``_b``."""
    rows = df.withColumn("_at", F.explode(entries))
    lo = cell(t0, F.col("_at.level"), width)
    return rows.withColumn("_b", F.explode(F.sequence(lo, F.greatest(lo, cell(t1, F.col("_at.level"), width)))))


def interval_pairs(
    left: DataFrame, right: DataFrame, l0: str, l1: str, r0: str, r1: str, predicate: Column,
    keys=KEY, width: float = WIDTH,
) -> DataFrame:
    """Inner join of intervals under ``predicate``; columns other than ``keys`` must not clash.  ``width``: of the cells of the lowest level.

    Rows with a null key or time have no partner.
    """
    keys = list(keys)
    mine, theirs = level_of(l0, l1, width), level_of(r0, r1, width)
    entry = lambda level, side: F.struct(level.cast("int").alias("level"), F.lit(side).alias("side"))
    # Side 0: spans of the right at their own level, met by the left from its own level on. Side 1: spans of the left at
    # their own level, met by those of the right that are shorter.
    in_use = _levels(right, r0, r1, width)
    lhs = left.withColumn("_own", mine).withColumn("_in_use", in_use)
    up = F.transform(F.filter("_in_use", lambda x: x >= F.col("_own")), lambda x: entry(x, 0))
    lhs = _cells(lhs, F.when(F.array_min("_in_use") < F.col("_own"), F.concat(up, F.array(entry(F.col("_own"), 1)))).otherwise(up), l0, l1, width).drop("_own", "_in_use")
    rhs = right.withColumn("_own", theirs).withColumn("_in_use", _levels(left, l0, l1, width))
    higher = F.transform(F.filter("_in_use", lambda x: x > F.col("_own")), lambda x: entry(x, 1))
    rhs = _cells(rhs, F.concat(F.array(entry(F.col("_own"), 0)), higher), r0, r1, width).drop("_own", "_in_use")
    level = F.col("_at.level")
    home = F.greatest(cell(l0, level, width), cell(r0, level, width))
    return lhs.join(rhs, [*keys, "_at", "_b"]).where((F.col("_b") == home) & predicate).drop("_at", "_b")


def all_short(spans: DataFrame, r0: str, r1: str, width: float = WIDTH) -> bool:
    """Whether no span with both ends is longer than a cell of the lowest level; a span with an infinite end or no number is not short."""
    return spans.where(F.col(r0).isNotNull() & F.col(r1).isNotNull() & ~((F.col(r1) - F.col(r0)) <= float(width))).isEmpty()


def met_in_one_cell(
    left: DataFrame, right: DataFrame, l0: str, l1: str, r0: str, r1: str, predicate: Column,
    keys=KEY, width: float = WIDTH,
) -> DataFrame:
    """Left join of intervals to short spans (``all_short``) that overlap them and pass ``predicate``: each row of ``left`` stands in one cell, ``_at`` and ``_b``.

    The cell is that of its start at its own level, and a span of the right comes to every cell in which an interval that
    overlaps it may start: three at most of each level in use. So partners grouped by ``keys``, ``_at``, ``_b`` and more of ``left``
    are not shuffled again; in return adaptive execution does not split an overfull cell.
    """
    keys, at = list(keys), F.col("_at")
    lhs = left.withColumn("_at", level_of(l0, l1, width)).withColumn("_b", cell(l0, at, width))
    rhs = right.where(F.col(r0).isNotNull() & F.col(r1).isNotNull()).withColumn("_at", F.explode(_levels(left, l0, l1, width)))
    reach = F.lit(1.001 * width) * F.pow(F.lit(STEP), at)  # what an interval of the level is long, and a little
    lo = cell(F.col(r0) - reach, at, width)
    rhs = rhs.withColumn("_b", F.explode(F.sequence(lo, F.greatest(lo, cell(r1, at, width)))))
    theirs = [c for c in rhs.columns if c not in [*keys, "_at", "_b"]]
    met = lhs.alias("l").join(rhs.alias("r"), reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_at", "_b"]]) & predicate, "left")
    return met.select("l.*", *[F.col(f"r.{c}") for c in theirs])


def stab_pairs(
    points: DataFrame, spans: DataFrame, t: str, r0: str, r1: str, predicate: Column,
    keys=KEY, width: float = WIDTH, how: str = "left",
) -> DataFrame:
    """Join of points to the spans they hit.  In the outer form a point without a span comes once per level in use."""
    keys = list(keys)
    in_use = F.array_union(F.array(F.lit(0)), _levels(spans, r0, r1, width))
    lhs = points.withColumn("_at", F.explode(in_use)).withColumn("_b", cell(t, F.col("_at"), width))
    rhs = spans.withColumn("_at", level_of(r0, r1, width))
    lo = cell(r0, F.col("_at"), width)
    rhs = rhs.withColumn("_b", F.explode(F.sequence(lo, F.greatest(lo, cell(r1, F.col("_at"), width)))))
    return lhs.alias("p").join(
        rhs.alias("s"),
        reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_at", "_b"]]) & predicate,
        how,
    ).drop(*[F.col(f"s.{k}") for k in [*keys, "_at", "_b"]] if how in ("left", "inner") else []).drop("_at", "_b")


@dataclass(frozen=True)
class Edge:
    """One kind of event to look up.

    ``side``: ``before`` (last edge <= t) or ``after`` (first edge >= t); ``strict`` excludes equality.
    ``keep``: ``nearest``, or ``max`` / ``sum`` of ``value`` over every edge before the point.
    ``tie``: list position; among edges of equal time the lowest position wins.
    """

    name: str
    df: DataFrame
    t: Column | str
    value: Column | str
    side: str = "before"
    strict: bool = False
    tie: Column | str | None = None
    keep: str = "nearest"


def _is_time(e: Edge) -> bool:
    """The edge's value is its own time, so ties do not matter."""
    return e.keep == "nearest" and isinstance(e.t, str) and isinstance(e.value, str) and e.t == e.value


def _plain(e: Edge) -> bool:
    """Slots of plain numbers aggregate by hash; other payloads are wrapped, so that a null payload still counts."""
    return e.keep != "nearest" or _is_time(e)


def _edge_rows(slots: dict[str, Edge], keys: list[str]) -> DataFrame:
    """Rows of edges that share table, time, side and tie: one row carries all their values."""
    e = next(iter(slots.values()))
    before = e.side == "before"
    tie = F.lit(0).cast("bigint") if e.tie is None else col(e.tie).cast("bigint")

    def value(x: Edge) -> Column:
        if not _plain(x):
            return F.struct(col(x.value).alias("v"))
        return col(x.value).cast("double") if _is_time(x) else col(x.value)

    return e.df.select(
        *keys,
        col(e.t).cast("double").alias("_t"),
        F.lit(0 if before != e.strict else 2).alias("_side"),
        (-tie if before else tie).alias("_tie"),
        *[value(x).alias(s) for s, x in slots.items()],
    ).where(F.col("_t").isNotNull())


def _grouped(slots: dict[str, Edge]) -> list[dict[str, Edge]]:
    groups: dict = {}
    for s, e in slots.items():
        shared = isinstance(e.t, str) and (e.tie is None or isinstance(e.tie, str))
        key = (id(e.df), e.t, e.side, e.strict, e.tie) if shared else s
        groups.setdefault(key, {})[s] = e
    return list(groups.values())


def _fold(e: Edge, c: Column) -> Column:
    """How several values of one slot combine, in scan order."""
    if e.keep == "max":
        return F.max(c)
    if e.keep == "sum":
        return F.sum(c)
    return F.last(c, ignorenulls=True)


def _any_long(points: DataFrame, groups: list[dict[str, Edge]], keys: list[str], depth: int) -> bool:
    """Whether a scan has more than ``depth`` rows of any key; a table that gives several groups of edges is read once."""
    tables: dict = {}
    for g in groups:
        e = next(iter(g.values()))
        tables.setdefault(id(e.df), (e.df, []))[1].append(F.when(col(e.t).isNotNull(), 1).otherwise(0))
    counts = [df.groupBy(*keys).agg(F.sum(reduce(lambda a, b: a + b, rows)).alias("_n")) for df, rows in tables.values()]
    counts.append(points.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = reduce(lambda a, b: a.unionByName(b), counts).groupBy(*keys).agg(F.sum("_n").alias("_n"))
    return not total.where(F.col("_n") > depth).isEmpty()


def long_keys(times: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """The keys with more than ``depth`` rows in ``times``, and how many."""
    return times.groupBy(*keys).agg(F.count("_t").alias("_n")).where(F.col("_n") > depth)


def cut_points(times: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """``keys`` and ``_cuts``, ascending times, of the keys with more than ``depth`` rows in ``times`` (``keys``, ``_t``).

    The cuts are sketched quantiles, about ``depth / 2`` rows apart, at most 1,023 of them. There are fewer than two cuts for each ``depth``
    rows of the table, which bounds what is broadcast: 64 MB for 10**12 rows.
    """
    sizes = long_keys(times, keys, depth)
    long = times.where(F.col("_t").isNotNull()).join(F.broadcast(sizes), keys)
    fine = F.percentile_approx("_t", [(i + 1) / (_SKETCH + 1) for i in range(_SKETCH)], 20_000).alias("_fine")
    wide = F.greatest(F.lit(1), F.floor(F.lit((_SKETCH + 1) * depth / 2) / F.col("_n")).cast("int"))
    cuts = long.groupBy(*keys).agg(F.max("_n").alias("_n"), fine)
    return cuts.select(*keys, F.array_distinct(F.filter("_fine", lambda x, i: (i + 1) % wide == 0)).alias("_cuts"))


def dealt(rows: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their bucket ``_b`` by ``_t``, and whether their key has several (``_parted``)."""
    cuts = F.broadcast(cuts.withColumnsRenamed({k: f"_of_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    placed = rows.join(cuts, same, "left").drop(*[f"_of_{k}" for k in keys])
    at = F.size(F.filter("_cuts", lambda c: c < F.col("_t")))
    return placed.withColumn("_parted", F.col("_cuts").isNotNull()).withColumn("_b", F.when(F.col("_parted") & F.col("_t").isNotNull(), at).otherwise(0)).drop("_cuts")


def _inherited(every: DataFrame, asked: DataFrame, slots: dict, ahead: dict, behind: dict, keys: list[str]) -> DataFrame:
    """What the buckets of parted keys inherit from their neighbours, as rows before and after all of theirs."""
    # Directory of the parted keys: one row per bucket that holds an edge or a point, with the sum of its edges.
    order = F.struct("_t", "_side", "_tie")
    aggs = []
    for s, e in slots.items():
        c = F.col(s)
        if e.keep != "nearest":
            aggs.append(_fold(e, c).alias(s))
        elif _is_time(e):
            aggs.append((F.max if e.side == "before" else F.min)(c).alias(s))
        else:
            aggs.append((F.max_by if e.side == "before" else F.min_by)(c, F.when(c.isNotNull(), order)).alias(s))
    used = asked.where("_parted").select(*keys, "_b")
    directory = every.where("_parted").unionByName(used, allowMissingColumns=True).groupBy(*keys, "_b").agg(*aggs)

    # What a bucket inherits from the ones before and after it, as one row at its start and one at its end.
    fwd = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    rev = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    inherited = directory.select(
        *keys, "_b", *[_fold(e, F.col(s)).over(fwd if e.side == "before" else rev).alias(s) for s, e in slots.items()]
    ).where(reduce(lambda x, y: x | y, [F.col(s).isNotNull() for s in slots]))

    def at(time: float, side: int, mine: dict) -> Column:
        kept = [(F.col(s) if s in mine else F.when(F.lit(False), F.col(s))).alias(s) for s in slots]
        return F.struct(F.lit(time).alias("_t"), F.lit(side).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), *kept)

    fills = ([at(float("-inf"), 0, ahead)] if ahead else []) + ([at(float("inf"), 2, behind)] if behind else [])
    return inherited.select(*keys, "_b", F.inline(F.array(*fills)))


def lookup(
    points: DataFrame, edges: list[Edge], t: str = "t", keys=KEY, depth: int = DEPTH,
) -> DataFrame:
    """Add to each point the edge values found before / after it, one column per edge.

    All edge kinds are resolved in a single scan of ``(key, bucket)`` groups.  Whether any key is so long that it must be
    parted is counted at once, so ``points`` and edges are read twice: store them first when they are costly.
    A point without a time finds nothing.
    """
    keys = list(keys)
    slots = {f"_e{i}": e for i, e in enumerate(edges)}
    ahead = {s: e for s, e in slots.items() if e.side == "before"}
    behind = {s: e for s, e in slots.items() if e.side == "after"}
    groups = _grouped(slots)

    every = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [_edge_rows(g, keys) for g in groups],
    )

    asked = points.select(
        *keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"),
        F.struct(*points.columns).alias("_p"),
    )
    parted = _any_long(points, groups, keys, depth)
    if parted:
        times = every.select(*keys, "_t").unionByName(asked.select(*keys, "_t"))
        cuts = cut_points(times, keys, depth)
        every, asked = dealt(every, cuts, keys), dealt(asked, cuts, keys)
    else:
        every, asked = every.withColumn("_b", F.lit(0)), asked.withColumn("_b", F.lit(0))

    rows = [every, asked]
    if parted:
        rows = [every.drop("_parted"), _inherited(every, asked, slots, ahead, behind, keys), asked.drop("_parted")]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)

    up = W.partitionBy(*keys, "_b").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_side"), F.desc("_tie")).rowsBetween(W.unboundedPreceding, W.currentRow)
    timed = F.col("_t").isNotNull()

    def seen(found: DataFrame, mine: dict[str, Edge], window) -> DataFrame:
        return found.select(*[c for c in found.columns if c not in mine], *[F.when(timed, _fold(e, F.col(s)).over(window)).alias(s) for s, e in mine.items()])

    found = seen(rows, ahead, up) if ahead else rows
    if ahead and behind:  # edges before a point are done with: only points and edges after them are sorted back
        found = found.where(reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in ["_p", *behind]]))
    found = seen(found, behind, down) if behind else found
    outs = []
    for s, e in slots.items():
        if e.keep == "sum":
            outs.append(F.coalesce(s, F.lit(0)).alias(e.name))
        else:
            outs.append((F.col(s) if _plain(e) else F.col(s)["v"]).alias(e.name))
    return found.where(F.col("_p").isNotNull()).select("_p.*", *outs)


# --- joins of windows with points and spans -----------------------------------------------


def points_in(windows: DataFrame, points: DataFrame, width: float = WIDTH) -> DataFrame:
    """Pairs with ``t0 <= t <= t1`` (closed)."""
    return interval_pairs(
        windows, points, "t0", "t1", "t", "t", (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")), width=width
    )


def overlapping(windows: DataFrame, spans: DataFrame, width: float = WIDTH) -> DataFrame:
    """Pairs of window ``t0, t1`` and span ``s0, s1`` with strict overlap; zero-width windows allowed."""
    return interval_pairs(
        windows, spans, "t0", "t1", "s0", "s1", (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0")), width=width
    )


def events_in(windows: DataFrame, events: DataFrame, label: str | None = None, width: float = WIDTH) -> DataFrame:
    """Strict overlap with labelled spans ``s0, s1``, one label or all."""
    return overlapping(windows, events if label is None else events.where(F.col("label") == label), width)


def stab_first(points: DataFrame, spans: DataFrame, width: float = WIDTH, name: str = "hit") -> DataFrame:
    """First span by ``pos`` that holds the point (closed ends), as a struct; null when none."""
    keys = points.columns
    payload = [c for c in spans.columns if c != "video_id"]
    pairs = stab_pairs(
        points, spans.select("video_id", F.struct("pos", *[c for c in payload if c != "pos"]).alias("_s")).select(
            "video_id", "_s", F.col("_s.s0").alias("_s0"), F.col("_s.s1").alias("_s1")),
        "t", "_s0", "_s1", (F.col("t") >= F.col("_s0")) & (F.col("t") <= F.col("_s1")), width=width,
    )
    return pairs.groupBy(*keys).agg(F.min("_s").alias(name))


def nearest_span(points: DataFrame, spans: DataFrame, width: float = WIDTH, name: str = "near") -> DataFrame:
    """Closest span as ``struct(dist, pos, s0, s1)``: 0 inside, else the nearer edge; list order breaks ties."""
    inside = settle(stab_first(points, spans.select("video_id", "pos", "s0", "s1"), width, "_in"), "inside")
    val = F.struct("pos", "s0", "s1")
    both = lookup(
        inside,
        [
            Edge("_l", spans, "s1", val, "before", tie="pos"),
            Edge("_r", spans, "s0", val, "after", tie="pos"),
        ],
    )
    cand = lambda c, d: F.when(c.isNotNull(), F.struct(d.alias("dist"), c.pos.alias("pos"), c.s0.alias("s0"), c.s1.alias("s1")))
    li, l, r = F.col("_in"), F.col("_l"), F.col("_r")
    best = F.array_min(F.array_compact(F.array(
        cand(li, F.lit(0.0)), cand(l, F.col("t") - l.s1), cand(r, r.s0 - F.col("t")),
    )))
    return both.select(*points.columns, best.alias(name))


def nearest_point(points: DataFrame, samples: DataFrame, value: Column, name: str = "near") -> DataFrame:
    """Closest sample as ``struct(dist, pos, v)``; ``samples`` has ``pos, s`` and ``value`` builds the payload."""
    val = F.struct(F.col("pos").alias("pos"), F.col("s").alias("s"), value.alias("v"))
    both = lookup(
        points, [Edge("_l", samples, "s", val, "before", tie="pos"), Edge("_r", samples, "s", val, "after", tie="pos")],
    )
    cand = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c.s - F.col("t")).alias("dist"), c.pos.alias("pos"), c.s.alias("s"), c.v.alias("v")))
    return both.select(*points.columns, F.array_min(F.array_compact(F.array(cand(F.col("_l")), cand(F.col("_r"))))).alias(name))


def asof_backward(points, edges, tolerance=None, predicate=None, name: str = "edge") -> DataFrame:
    """Greatest edge ``e <= t`` among edges passing ``predicate``, within ``tolerance``."""
    kept = edges if predicate is None else edges.where(predicate)
    out = lookup(points, [Edge(name, kept, "e", "e", "before")])
    if tolerance is None:
        return out
    return out.withColumn(name, F.when(F.col("t") - F.col(name) <= tolerance, F.col(name)))


def asof_forward(points, edges, tolerance=None, name: str = "edge") -> DataFrame:
    """Least edge ``e >= t``, within ``tolerance``."""
    out = lookup(points, [Edge(name, edges, "e", "e", "after")])
    if tolerance is None:
        return out
    return out.withColumn(name, F.when(F.col(name) - F.col("t") <= tolerance, F.col(name)))


def overlap_seconds(windows: DataFrame, spans: DataFrame, width: float = WIDTH, name: str = "seconds") -> DataFrame:
    """Summed overlap of each window with the spans; 0 without any.  Windows must be distinct rows; any column may be null."""
    keys = windows.columns
    pairs = overlapping(windows, spans.select("video_id", "s0", "s1"), width)
    sums = pairs.groupBy(*keys).agg(
        F.sum(F.least("t1", "s1") - F.greatest("t0", "s0")).alias(name)
    )
    sums = sums.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return windows.join(sums, same, "left").select(*[windows[c] for c in keys], F.coalesce(F.col(name), F.lit(0.0)).alias(name))


def iou_join(left: DataFrame, right: DataFrame, min_iou: float = 0.5, width: float = WIDTH) -> DataFrame:
    """Pairs of ``t0, t1`` and ``s0, s1`` whose intersection over union is above ``min_iou``."""
    pairs = overlapping(left, right, width)
    return pairs.withColumn("iou", interval_iou("t0", "t1", "s0", "s1")).where(F.col("iou") > min_iou)


def not_overlapping(cands: DataFrame, kept: DataFrame, iou: float = 0.5, width: float = WIDTH) -> DataFrame:
    """Candidates whose IoU with every kept window ``s0, s1`` is at most ``iou``."""
    ids = ["video_id", "t0", "t1"]
    windows = cands.select(*ids).distinct()
    hit = iou_join(windows, kept.select("video_id", "s0", "s1"), iou, width).select(*ids).distinct()
    return cands.join(hit, ids, "left_anti")


def straddlers(points: DataFrame, words: DataFrame, width: float = WIDTH) -> DataFrame:
    """Pairs of point ``t`` and the words ``s0, s1`` strictly around it."""
    return stab_pairs(
        points, words, "t", "s0", "s1", (F.col("s0") < F.col("t")) & (F.col("s1") > F.col("t")), width=width, how="inner"
    )


def inside_word(points: DataFrame, words: DataFrame, name: str = "mid_word") -> DataFrame:
    """Flag points strictly inside some word: the latest end among words started before the point is after it."""
    out = lookup(points, [Edge("_end", words, "s0", "s1", "before", strict=True, keep="max")])
    return out.select(*points.columns, F.coalesce(F.col("_end") > F.col("t"), F.lit(False)).alias(name))


# --- dense positions ------------------------------------------------------------------------


def running(df: DataFrame, name: str, at: str, value: Column | str, keep: str = "sum", strict: bool = False,
            tie: str | None = None, keys=KEY) -> DataFrame:
    """Running sum / max of ``value`` along ``at`` within each key."""
    return lookup(df, [Edge(name, df, at, value, "before", strict=strict, keep=keep, tie=tie)], t=at, keys=keys)
