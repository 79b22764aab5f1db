"""Order-dependent scans that no window frame expresses.

Spark does the grouping and the ordering (shuffle on the group key, sort inside the
partition); the Python step sees one row at a time, keeps a small state and never holds a
group.  Callers make the group key as fine as the rule allows, so that one long timeline
still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.operators.stored import settle
from momentloom.operators.timeline import Edge, lookup


def scan_groups(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Run ``step()`` once per group over its rows in order.

    ``step()`` returns ``(row, end)``: ``row(record) -> iterable of tuples`` and
    ``end() -> iterable of tuples``; each tuple is one output row without the keys.
    """
    cols = list(df.columns)
    at = [cols.index(k) for k in keys]
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = keys + [p.strip().split(" ")[0].strip("`") for p in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, row, end, out = None, None, None, []
        for batch in batches:
            for rec in batch.itertuples(index=False):
                key = tuple(rec[i] for i in at)
                if key != current:
                    if end is not None:
                        out.extend(current + tuple(r) for r in end())
                    current = key
                    row, end = step()
                out.extend(key + tuple(r) for r in row(rec))
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if end is not None:
            out.extend(current + tuple(r) for r in end())
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, f"{key_ddl}, {schema}")


def _fields(schema: str) -> list[str]:
    """Split a flat DDL string on top-level commas."""
    parts, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return parts + [cur]


# --- batches of consecutive words ---------------------------------------------------------


def batch_step(window_s: float):
    """Greedy batches: a word joins while its end is within ``window_s`` of the batch's first start."""

    def step():
        state = {"first": None, "i": -1}

        def row(r):
            if state["first"] is None or r.t1 - state["first"] > window_s:
                state["first"] = r.t0
                state["i"] += 1
            yield (int(r.pos), state["i"], r.t0, r.t1)

        return row, lambda: ()

    return step


# --- sticky dominant box --------------------------------------------------------------------


def _iou(a, b) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    if w <= 0 or h <= 0:
        return 0.0
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return w * h / union if union > 0 else 0.0


def choose_box(boxes, prev, min_conf: float, iou: float):
    """Index of the strong box that continues ``prev`` best, else of the largest strong box, else None."""
    strong = [(i, b) for i, b in enumerate(boxes) if b["conf"] >= min_conf]
    if prev is not None:
        held = [(_iou(b, prev), -i) for i, b in strong if _iou(b, prev) > iou]
        if held:
            return -max(held)[1]
    return -max((b["w"] * b["h"], -i) for i, b in strong)[1] if strong else None


def track_step(min_conf: float, iou: float):
    def step():
        state = {"prev": None}

        def row(r):
            boxes = [b if isinstance(b, dict) else b.asDict() for b in (r.boxes if r.boxes is not None else [])]
            pick = choose_box(boxes, state["prev"], min_conf, iou)
            state["prev"] = None if pick is None else boxes[pick]
            yield (r.t, pick)

        return row, lambda: ()

    return step


# --- greedy window dedupe -------------------------------------------------------------------


def dedupe_step(iou: float, cell: float = 90.0):
    """Greedy pass: a window too close to a kept one takes its place only with strictly more evidence.

    Kept windows sit in time cells, so a row is compared with its neighbourhood only.  A kept row
    comes out with the order columns of the row that opened its place.
    """

    def step():
        kept: list = []
        opened: list = []
        cells: dict[int, set[int]] = {}

        def span(r):
            return range(int(r.t0 // cell), int(r.t1 // cell) + 1)

        def close(a, b):
            inter = min(a.t1, b.t1) - max(a.t0, b.t0)
            union = (a.t1 - a.t0) + (b.t1 - b.t0) - inter
            return inter > 0 and union > 0 and inter / union > iou

        def row(r):
            near = {s for c in span(r) for s in cells.get(c, ())}
            hits = [s for s in near if close(kept[s], r)]
            if not hits:
                place = len(kept)
                kept.append(r)
                opened.append((int(r.rule_rank), float(r.o1), int(r.o2), int(r.part)))
            else:
                place = min(hits)
                if r.n_evidence <= kept[place].n_evidence:
                    return ()
                for c in span(kept[place]):
                    cells[c].discard(place)
                kept[place] = r
            for c in span(r):
                cells.setdefault(c, set()).add(place)
            return ()

        def end():
            for r, o in zip(kept, opened):
                yield (r.t0, r.t1, r.source, r.notes, int(r.n_evidence), r.evidence_json, *o)

        return row, end

    return step


# --- stretches without a pause ------------------------------------------------------------------


def gap_islands(df: DataFrame, t0: str, t1: str, gap: float, name: str = "island") -> DataFrame:
    """Label rows by the last place where the timeline pauses for more than ``gap``.

    Rows with one start count once, and only the breaks are looked up again.
    """
    df = settle(df, "rows")
    heads = df.groupBy("video_id", F.col(t0).alias("_h")).agg(F.max(t1).alias("_reach"))
    heads = settle(heads, "heads")
    heads = lookup(heads, [Edge("_seen", heads, "_h", "_reach", strict=True, keep="max")], t="_h")
    breaks = heads.where(F.col("_seen").isNull() | (F.col("_h") - F.col("_seen") > gap)).select("video_id", "_h")
    breaks = settle(breaks, "breaks")
    return lookup(df, [Edge(name, breaks, "_h", "_h")], t=t0)
