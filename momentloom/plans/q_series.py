"""Queries over curves, spans and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentloom.operators import series
from momentloom.plans import derive as D
from momentloom.plans.registry import query, with_


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("""
    WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS video_id, l_extendedprice / 1000 AS x,
                      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS n FROM lineitem),
    f AS (SELECT video_id, n, x, unnest([n // 50, n // 50 + 1]) AS i FROM s),
    c AS (SELECT video_id, (max(n) + 1) // 50 AS last_i FROM s GROUP BY 1)
    SELECT f.video_id, f.i, round(sqrt(sum(x * x) / 100), 6) AS v FROM f JOIN c USING (video_id) WHERE f.i <= c.last_i GROUP BY 1, 2""")
def rms_curve(spark, d):
    li = D.read(spark, d, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    # the position of a sample is its rank in the table order of its series
    samples = li.select(F.col("l_suppkey").cast("string").alias("video_id"), (F.col("l_extendedprice") / 1000).alias("x"), order.alias("o"))
    samples = D.ranked(samples, "o", F.col("o.l_orderkey").cast("double"), 2048.0)
    return series.rms_curve(samples, 50).select("video_id", "i", r6("v"))


@query("""
    WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(n_chars AS DOUBLE) AS dur FROM documents),
    n AS (SELECT video_id, dur, CASE WHEN dur <= 600 THEN 1 ELSE CAST(ceil((dur - 5) / 595) AS INT) END AS n FROM m)
    SELECT video_id, g.chunk, g.chunk * 595.0 AS t0, least(g.chunk * 595.0 + 600, dur) AS t1
    FROM n, LATERAL (SELECT unnest(range(0, n.n)) AS chunk) g""")
def overlapping_chunks(spark, d):
    docs = D.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.col("n_chars").cast("double").alias("duration_s"))
    return series.overlapping_chunks(docs, 600.0, 5.0)


@query(with_("words", c="SELECT video_id, CAST(floor(t0 / 64) AS INT) AS chunk, pos, t0 AS v FROM words",
             i="SELECT *, row_number() OVER (PARTITION BY video_id, chunk ORDER BY pos) - 1 AS i FROM c") + """
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk, i) - 1 AS i, v FROM i WHERE chunk = 0 OR i >= 5""")
def stitch_chunks(spark, d):
    w = D.words(spark, d).select("video_id", F.floor(F.col("t0") / 64).cast("int").alias("chunk"), "pos", F.col("t0").alias("v"))
    first = w.groupBy("video_id", "chunk").agg(F.min("pos").alias("p0"))
    pieces = w.join(first, ["video_id", "chunk"]).select("video_id", "chunk", (F.col("pos") - F.col("p0")).alias("i"), "v")
    return series.stitch_chunks(pieces, 5)


_CURVE = """SELECT CAST(o_custkey AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
                   o_totalprice / 1000 AS v FROM orders"""


def _order_curve(spark, d):
    o = D.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("o"), (F.col("o_totalprice") / 1000).alias("v"))
    return D.ranked(o, "o", F.col("o").cast("double"), 65536.0).withColumnRenamed("n", "i").select("video_id", "i", "v")


_Z = "CASE WHEN stddev_pop(v) OVER w > 1e-9 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END"


@query(f"""WITH c AS ({_CURVE}) SELECT video_id, i, round(v, 6) AS v, round({_Z}, 6) AS z FROM c
    WINDOW w AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling_zscore(spark, d):
    return series.rolling_zscore(_order_curve(spark, d), 7).select("video_id", "i", r6("v"), r6("z"))


@query(f"""WITH c AS ({_CURVE}), z AS (SELECT video_id, i, {_Z} AS z FROM c
    WINDOW w AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
    SELECT video_id, i * 0.5 AS t, round(z, 6) AS sigma FROM z WHERE z > 1.75""")
def energy_peaks(spark, d):
    return series.energy_peaks(_order_curve(spark, d), hop_s=0.5, window_s=10.0, sigma=1.75).select("video_id", "t", r6("sigma"))


_RATE = dict(n="""SELECT m.video_id, g.i FROM media m, LATERAL (SELECT unnest(range(0, CAST(greatest(1, ceil(m.duration_s)) AS BIGINT))) AS i) g""",
             rate="""SELECT n.video_id, n.i, n.i * 1.0::DOUBLE AS t, coalesce(c.k, 0) / 1.0::DOUBLE AS v FROM n LEFT JOIN
                     (SELECT video_id, CAST(floor(t0) AS BIGINT) AS i, count(*) AS k FROM words GROUP BY 1, 2) c ON c.video_id = n.video_id AND c.i = n.i""")


@query(with_("words", "media", **_RATE) + "SELECT video_id, i, t, v FROM rate")
def rate_curve(spark, d):
    w = D.words(spark, d)
    return series.rate_curve(w, D.media(w))


@query(with_("pitch") + "SELECT video_id, i, t, round(v, 6) AS v FROM pitch")
def bucket_variance(spark, d):
    return D.pitch(D.ticks(spark, d)).select("video_id", "i", "t", r6("v"))


_RUNS = """SELECT video_id, min(i) * {hop} AS t0, (max(i) + 1) * {hop} AS t1, max(v) AS peak FROM (
        SELECT video_id, i, v, i - row_number() OVER (PARTITION BY video_id ORDER BY i) AS g FROM {src} WHERE {cond}) GROUP BY video_id, g
        HAVING (max(i) + 1) * {hop} - min(i) * {hop} >= {least}"""


@query(with_("pitch") + _RUNS.format(hop="3600.0", src="pitch", cond="v > 1000", least="7200"))
def runs_where(spark, d):
    out = series.runs_where(D.pitch(D.ticks(spark, d)), F.col("v") > 1000, 3600.0, 7200.0)
    return out.select("video_id", "t0", "t1", "peak")


_SPREAD = "SELECT r.*, avg(v) OVER (PARTITION BY video_id) AS mu, stddev_pop(v) OVER (PARTITION BY video_id) AS sd FROM rate r"


@query(with_("words", "media", **_RATE, s=_SPREAD) + _RUNS.format(hop="1.0", src="s", cond="v > mu + 0.1 * sd", least="3"))
def surges(spark, d):
    w = D.words(spark, d)
    return series.surges(series.rate_curve(w, D.media(w)), k=0.1)


@query(with_("words", "media", **_RATE, s=_SPREAD) + _RUNS.format(hop="1.0", src="s", cond="v < mu - sd", least="2"))
def monotone(spark, d):
    w = D.words(spark, d)
    return series.monotone(series.rate_curve(w, D.media(w)), min_duration_s=2.0)


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS video_id, CASE event_type WHEN 'click' THEN 'laughter' ELSE 'applause' END AS label,
                CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 3600000000 AS BIGINT) AS i, max(value / 400) AS v
                FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3),
    h AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, label ORDER BY i) AS g FROM c
          WHERE v >= CASE label WHEN 'laughter' THEN 0.05 ELSE 0.1 END)
    SELECT video_id, label, min(i) * 60.0 AS t0, (max(i) + 1) * 60.0 AS t1, max(v) AS conf FROM h GROUP BY video_id, label, g""")
def threshold_events(spark, d):
    e = D.sevents(D.ticks(spark, d))
    probs = e.groupBy("video_id", "label", F.floor(F.col("t0") / 60).alias("i")).agg(F.max("conf").alias("p"))
    return series.threshold_events(probs, 60.0, {"laughter": 0.05, "applause": 0.1})


@query(with_("quiet") + "SELECT video_id, t0, t1 FROM quiet")
def interval_complement(spark, d):
    return D.quiet(D.ticks(spark, d)).select("video_id", "t0", "t1")


@query(with_("scenes") + "SELECT video_id, pos, t0, t1 FROM scenes")
def segments_from_cuts(spark, d):
    return D.scenes(D.ticks(spark, d))


@query("""WITH f AS (SELECT CAST(label AS VARCHAR) AS video_id, vec_id AS i, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding END AS vec FROM embeddings),
    p AS (SELECT *, last_value(vec IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f)
    SELECT video_id, i, round(CASE WHEN vec IS NULL OR prev IS NULL THEN 0 ELSE
        list_sum(list_transform(list_zip(vec, prev), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(vec) END, 6) AS v FROM p""")
def vector_diff_curve(spark, d):
    e = D.read(spark, d, "embeddings")
    vec = F.when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    frames = e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("i"), vec.alias("vec"))
    return series.vector_diff_curve(frames, scale=1.0).select("video_id", "i", r6("v"))


@query(with_("fillers") + "SELECT video_id, pos, t0, t1 FROM fillers")
def filler_spans(spark, d):
    return series.filler_spans(D.words(spark, d), D.FILL_ONE, D.FILL_PAIR)


@query(with_("words") + """SELECT video_id, pos, CASE WHEN regexp_replace(lower(text), '[^a-z'']', '', 'g') <> '' THEN
        round(abs((t0 + t1) / 2 * 1000 - (t0 + (pos % 7) * 0.0625 + t1 + (pos % 5) * 0.0625) / 2 * 1000), 6) END AS align_err_ms FROM words""")
def alignment_error(spark, d):
    w = D.words(spark, d)
    aligned = w.select("video_id", "pos", (F.col("t0") + F.col("pos") % 7 * 0.0625).alias("a0"), (F.col("t1") + F.col("pos") % 5 * 0.0625).alias("a1"))
    return series.alignment_error(w, aligned, D.media(w)).select("video_id", "pos", r6("align_err_ms"))


@query(with_("words", ch="""SELECT video_id, 0::BIGINT AS p0, (SELECT w.t0 FROM words w WHERE w.video_id = m.video_id AND w.pos = 0) AS b0 FROM (SELECT DISTINCT video_id FROM words) m
        UNION ALL SELECT video_id, nx.pos, nx.t0 FROM (SELECT c.video_id, (SELECT arg_min(struct_pack(pos := w.pos, t0 := w.t0), w.pos) FROM words w
            WHERE w.video_id = c.video_id AND w.pos > c.p0 AND w.t1 - c.b0 > 60) AS nx FROM ch c) WHERE nx IS NOT NULL""",
             nb="SELECT *, lead(p0) OVER (PARTITION BY video_id ORDER BY p0) AS p1 FROM ch") + """
    SELECT b.video_id, b.p0 AS first_pos, count(*) AS n_words, greatest(0, b.b0 - 1) AS slice_t0, max(w.t1) + 1 AS slice_t1
    FROM nb b JOIN words w ON w.video_id = b.video_id AND w.pos >= b.p0 AND w.pos < coalesce(b.p1, 1000000000) GROUP BY b.video_id, b.p0, b.b0""")
def span_batches(spark, d):
    return series.span_batches(D.words(spark, d), 60.0, 1.0)


@query()
def dominant_track(spark, d):
    """Boxes of one sample are the lines of one order; the track runs over a customer's orders."""
    li, o = D.read(spark, d, "lineitem"), D.read(spark, d, "orders")
    box = F.struct(
        F.col("l_linenumber").alias("k"), (F.col("l_quantity") / 100).alias("x"), (F.col("l_discount") * 4).alias("y"),
        F.lit(0.3).alias("w"), (F.lit(0.2) + F.col("l_tax")).alias("h"), (F.col("l_extendedprice") / 100000).alias("conf"))
    per = li.select("l_orderkey", box.alias("b")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    faces = o.join(per, o.o_orderkey == per.l_orderkey).select(
        F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").cast("double").alias("t"),
        F.transform("bs", lambda b: F.struct(b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h"), b.conf.alias("conf"))).alias("boxes"))
    return series.dominant_track(faces)


@query(with_("words", t="""SELECT video_id, pos // 200 AS chunk, pos, CASE WHEN (pos % 200) % 10 = 0
        THEN '[' || CAST(CAST(round_even(t0, 0) AS BIGINT) AS VARCHAR) || 's] ' || text ELSE text END AS s FROM words""") + """
    SELECT video_id, chunk, string_agg(s, ' ' ORDER BY pos) AS text FROM t GROUP BY 1, 2""")
def transcript_chunks(spark, d):
    return series.transcript_chunks(D.words(spark, d), n=200, every=10)
