"""Small tables for tests."""

from momentloom.schemas import Signals

CLAIMS = "array<struct<kind:string,t:double,value_num:double,value_str:string>>"


def table(spark, rows, ddl):
    return spark.createDataFrame([tuple(r) for r in rows], ddl).coalesce(1)


def signals(spark, duration=100.0, words=(), peaks=(), events=(), pitch=(), language="en", errs=None, **spans):
    """One timeline ``v``.  Words are ``(text, t0, t1)``; other spans are ``(t0, t1)`` by kind."""
    w = [("v", i, x[0], float(x[1]), float(x[2]), 0.9, None if errs is None else errs[i]) for i, x in enumerate(words)]
    s = [("v", k, i, float(a), float(b)) for k, xs in spans.items() for i, (a, b) in enumerate(xs)]
    return Signals(
        media=table(spark, [("v", float(duration), language)], "video_id string, duration_s double, language string"),
        words=table(spark, w, "video_id string, pos int, text string, t0 double, t1 double, conf double, align_err_ms double"),
        spans=table(spark, s, "video_id string, kind string, pos int, t0 double, t1 double"),
        peaks=table(spark, [("v", i, float(t), float(x)) for i, (t, x) in enumerate(peaks)], "video_id string, pos int, t double, sigma double"),
        events=table(spark, [("v", i, lab, float(a), float(b), c) for i, (lab, a, b, c) in enumerate(events)],
                     "video_id string, pos int, label string, t0 double, t1 double, conf double"),
        curves=table(spark, [("v", "pitch", i, float(i), float(x)) for i, x in enumerate(pitch)], "video_id string, name string, i bigint, t double, v double"),
    )


def candidates(spark, windows):
    """Rows ``(t0, t1, claims)``; a claim is ``(kind, t, number, text)``."""
    rows = [("v", f"c{i}", i, float(a), float(b), "rule", "", [tuple(c) for c in ev]) for i, (a, b, ev) in enumerate(windows)]
    return spark.createDataFrame(rows, f"video_id string, cand_id string, pos int, t0 double, t1 double, source string, notes string, evidence {CLAIMS}").coalesce(1)
