"""Queries over cut refinement, quality checks and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentloom.operators import cuts as G
from momentloom.operators import qa as H
from momentloom.operators.candidates import claim
from momentloom.plans import derive as D
from momentloom.plans.registry import query, with_

ENDS = "regexp_matches(text, '[.!?…][\"''”’)\\]}]*$')"
BASE = ("words", "silence", "media", "fillers", "cuts")

# Facts about every word: sentence end, inside a filler, next start.
FACTS = dict(
    wf=f"""SELECT w.video_id, w.pos, w.text, w.t0, w.t1, {ENDS} AS ends, lead(w.t0) OVER (PARTITION BY w.video_id ORDER BY w.pos) AS nxt,
           (w.pos * 37 % 500)::DOUBLE AS err,
           EXISTS (SELECT 1 FROM fillers f WHERE f.video_id = w.video_id AND f.t0 <= w.t0 AND w.t1 <= f.t1) AS filler FROM words w""",
    clean="""SELECT s.video_id, s.t1 FROM silence s WHERE s.t1 - s.t0 >= 0.3 AND NOT EXISTS
             (SELECT 1 FROM words w WHERE w.video_id = s.video_id AND w.t0 < s.t1 AND w.t1 > s.t1)""")


def open_sql(p: str, src: str) -> dict[str, str]:
    """Opening edges of ``src`` rows (``video_id, cand_id, t``): ``<p>_open`` before and ``<p>_strip`` after filler removal."""
    return {
        f"{p}_le": f"""SELECT s.video_id, s.cand_id, s.t, (SELECT max(w.t1) FROM wf w WHERE w.video_id = s.video_id AND w.ends AND w.t1 <= s.t) AS le,
            (SELECT max(c.t1) FROM clean c WHERE c.video_id = s.video_id AND c.t1 <= s.t) AS sil,
            (SELECT max(w.t0) FROM wf w WHERE w.video_id = s.video_id AND w.t0 <= s.t) AS ws FROM {src} s""",
        f"{p}_st": f"""SELECT *, (SELECT min(w.t0) FROM wf w WHERE w.video_id = l.video_id AND w.t0 >= l.le) AS st FROM {p}_le l""",
        f"{p}_ch": f"""SELECT video_id, cand_id, t, CASE WHEN t - st BETWEEN 0 AND 10 THEN st END AS sent, CASE WHEN t - sil <= 5 THEN sil END AS sil, ws FROM {p}_st""",
        f"{p}_open": f"""SELECT video_id, cand_id, t, sent, sil, ws, coalesce(sent, CASE WHEN abs(sil - ws) <= 2 THEN least(sil, ws) END, sil, ws, t) AS open FROM {p}_ch""",
        f"{p}_loop": f"""SELECT video_id, cand_id, open AS t, false AS done FROM {p}_open UNION ALL
            SELECT video_id, cand_id, CASE WHEN f IS NOT NULL AND f.filler THEN coalesce(f.nxt, f.t1) ELSE t END, f IS NULL OR NOT f.filler OR f.nxt IS NULL FROM (
                SELECT l.video_id, l.cand_id, l.t, (SELECT arg_min(struct_pack(filler := w.filler, nxt := w.nxt, t1 := w.t1), w.pos) FROM wf w
                    WHERE w.video_id = l.video_id AND w.t0 < l.t + 2 AND w.t1 > l.t) AS f FROM {p}_loop l WHERE NOT l.done)""",
        f"{p}_strip": f"SELECT video_id, cand_id, t AS open FROM {p}_loop WHERE done",
    }


def close_sql(p: str, src: str) -> dict[str, str]:
    return {
        f"{p}_ce": f"""SELECT s.video_id, s.cand_id, s.t, (SELECT min(w.t1) FROM wf w WHERE w.video_id = s.video_id AND w.ends AND w.t1 >= s.t) AS se,
            (SELECT min(w.t1) FROM wf w WHERE w.video_id = s.video_id AND w.t1 >= s.t) AS we FROM {src} s""",
        f"{p}_tg": f"SELECT *, coalesce(CASE WHEN se - t <= 12 THEN se END, we) AS target FROM {p}_ce",
        f"{p}_close": f"""SELECT video_id, cand_id, se, CASE WHEN target IS NULL THEN t ELSE target + least(0.8::DOUBLE, greatest(0,
            coalesce((SELECT min(w.t0) FROM wf w WHERE w.video_id = g.video_id AND w.t0 >= g.target) - target, 0.8::DOUBLE))) END AS close FROM {p}_tg g""",
    }


def clamp_sql(p: str, src: str) -> dict[str, str]:
    """Length bounds, then back to speech where the floor moved the opening: ``<p>_cut``."""
    return {
        f"{p}_k1": f"SELECT *, greatest(0, least(a, duration_s)) AS x, greatest(0, least(b, duration_s)) AS y FROM {src} JOIN media USING (video_id)",
        f"{p}_k2": f"SELECT video_id, cand_id, a, duration_s, least(x, y) AS lo, greatest(x, y) AS hi FROM {p}_k1",
        f"{p}_k3": f"""SELECT video_id, cand_id, a, CASE WHEN hi - lo < 30 THEN greatest(0, least(duration_s, lo + 30) - 30) ELSE lo END AS t0,
            CASE WHEN hi - lo < 30 THEN least(duration_s, lo + 30) WHEN hi - lo > 90 THEN lo + 90 ELSE hi END AS t1 FROM {p}_k2""",
        f"{p}_k4": f"""SELECT *, greatest((SELECT max(s.t1) FROM silence s WHERE s.video_id = k.video_id AND s.t1 <= k.t0),
            (SELECT max(w.t0) FROM wf w WHERE w.video_id = k.video_id AND w.t0 <= k.t0)) AS edge FROM {p}_k3 k""",
        f"{p}_cut": f"SELECT video_id, cand_id, CASE WHEN t0 < a AND edge >= greatest(0, t1 - 90) THEN edge ELSE t0 END AS t0, t1 FROM {p}_k4",
    }


_P0 = dict(p0="SELECT video_id, cand_id, t0 AS t FROM cuts")
_P1 = dict(p1="SELECT video_id, cand_id, t1 AS t FROM cuts")


def _points(sig_cuts, t):
    return sig_cuts.select("video_id", "cand_id", F.col(t).alias("t"))


def _talk(spark, d):
    sig = D.talk_signals(spark, d)
    return sig, D.cuts(sig.kind("speech").withColumnRenamed("pos", "turn"))


_OPEN = with_(*BASE, **FACTS, **_P0, **open_sql("o", "p0"))
_CLOSE = with_(*BASE, **FACTS, **_P1, **close_sql("c", "p1"))


@query(_OPEN + "SELECT video_id, cand_id, sent AS sentence_start FROM o_open")
def sentence_start(spark, d):
    sig, c = _talk(spark, d)
    return G.sentence_start(_points(c, "t0"), sig).select("video_id", "cand_id", "sentence_start")


@query(_CLOSE + "SELECT video_id, cand_id, CASE WHEN se - t <= 12 THEN se END AS sentence_end FROM c_tg")
def sentence_end(spark, d):
    sig, c = _talk(spark, d)
    return G.sentence_end(_points(c, "t1"), sig).select("video_id", "cand_id", "sentence_end")


@query(_OPEN + "SELECT video_id, cand_id, sil AS silence_edge FROM o_open")
def silence_edge(spark, d):
    sig, c = _talk(spark, d)
    return G.silence_edge(_points(c, "t0"), sig).select("video_id", "cand_id", "silence_edge")


@query(_OPEN + "SELECT video_id, cand_id, ws AS word_start FROM o_open")
def word_start(spark, d):
    sig, c = _talk(spark, d)
    return G.word_start(_points(c, "t0"), sig).select("video_id", "cand_id", "word_start")


@query(_OPEN + "SELECT video_id, cand_id, open FROM o_open")
def snap_open(spark, d):
    sig, c = _talk(spark, d)
    return G.snap_open(c, sig).select("video_id", "cand_id", "open")


@query(_OPEN + "SELECT video_id, cand_id, open FROM o_strip")
def strip_fillers(spark, d):
    sig, c = _talk(spark, d)
    return G.strip_fillers(D.settle(G.snap_open(c, sig), "open"), sig).select("video_id", "cand_id", "open")


@query(_CLOSE + "SELECT video_id, cand_id, round(close, 6) AS close FROM c_close")
def snap_close(spark, d):
    sig, c = _talk(spark, d)
    return G.snap_close(c, sig).select("video_id", "cand_id", F.round("close", 6).alias("close"))


@query("""WITH m AS (SELECT doc_id, n_chars / 8.0::DOUBLE AS dur, (doc_id % 90) * 2.5::DOUBLE - 10 AS a, (doc_id % 37) * 7.5::DOUBLE AS b FROM documents),
    k AS (SELECT doc_id, dur, least(greatest(0, least(a, dur)), greatest(0, least(b, dur))) AS lo, greatest(greatest(0, least(a, dur)), greatest(0, least(b, dur))) AS hi FROM m)
    SELECT doc_id, CASE WHEN hi - lo < 30 THEN greatest(0, least(dur, lo + 30) - 30) ELSE lo END AS t0,
           CASE WHEN hi - lo < 30 THEN least(dur, lo + 30) WHEN hi - lo > 90 THEN lo + 90 ELSE hi END AS t1 FROM k""")
def clamp_cut(spark, d):
    m = D.read(spark, d, "documents").select("doc_id", (F.col("n_chars") / 8).alias("duration_s"), (F.col("doc_id") % 90 * 2.5 - 10).alias("t0"),
                                             (F.col("doc_id") % 37 * 7.5).alias("t1"))
    return G.clamp_cut(m).select("doc_id", "t0", "t1")


_WIDE = dict(wide="SELECT video_id, cand_id, t0 + 12 AS a, t0 + 25 AS b FROM cuts")


@query(with_(*BASE, **FACTS, **_WIDE, **clamp_sql("x", "wide")) + "SELECT video_id, cand_id, t0, t1 FROM x_cut")
def reopen_on_speech(spark, d):
    sig, c = _talk(spark, d)
    raw = c.select("video_id", "cand_id", (F.col("t0") + 12).alias("t0"), (F.col("t0") + 25).alias("t1"), (F.col("t0") + 12).alias("before"))
    cut = G.clamp_cut(raw.join(sig.media.select("video_id", "duration_s"), "video_id"))
    return G.reopen_on_speech(cut, sig, "before").select("video_id", "cand_id", "t0", "t1")


def _cited(c):
    """Cuts with three claims: a quote, two peaks of the same strength or a weaker second one."""
    v = (F.col("turn") % 5).cast("double")
    quote = F.struct(F.lit("quote").alias("kind"), (F.col("t0") + 2.25).alias("t"), F.lit(None).cast("double").alias("value_num"), F.lit("x").alias("value_str"))
    peaks = F.array(quote, claim("energy_peak", F.col("t0") + 6.25, v), claim("energy_peak", F.col("t0") + 20.5, -F.lit(2.0)))
    return c.withColumn("evidence", F.when(F.col("turn") % 3 == 0, F.slice(peaks, 1, 1)).when(F.col("turn") % 3 == 1, peaks).otherwise(F.slice(peaks, 1, 0)))


_PAYOFF = dict(py="""SELECT video_id, cand_id, (SELECT max(w.pos) FROM words w WHERE w.video_id = c.video_id AND w.t0 <=
    CASE c.turn % 3 WHEN 0 THEN c.t0 + 2.25 WHEN 1 THEN CASE WHEN c.turn % 5 >= 2 THEN c.t0 + 6.25 ELSE c.t0 + 20.5 END END) AS payoff_word_i FROM cuts c""")


@query(with_("words", "cuts", **_PAYOFF) + "SELECT * FROM py")
def payoff_word(spark, d):
    sig, c = _talk(spark, d)
    return G.payoff_word(_cited(c), sig).select("video_id", "cand_id", "payoff_word_i")


_REFINE = dict(**FACTS, **_P0, **_P1, **open_sql("o", "p0"), **close_sql("c", "p1"),
               rf="SELECT o.video_id, o.cand_id, o.open AS a, c.close AS b FROM o_strip o JOIN c_close c USING (video_id, cand_id)", **clamp_sql("r", "rf"), **_PAYOFF)


@query(with_(*BASE, **_REFINE) + "SELECT video_id, cand_id, round(t0, 6) AS t0, round(t1, 6) AS t1, payoff_word_i FROM r_cut JOIN py USING (video_id, cand_id)")
def refine(spark, d):
    sig, c = _talk(spark, d)
    out = G.refine(_cited(c), sig)
    return out.select("video_id", "cand_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "payoff_word_i")


def _hit(t, c="c"):
    return f"EXISTS (SELECT 1 FROM words w WHERE w.video_id = {c}.video_id AND w.t0 < {c}.{t} AND w.t1 > {c}.{t})"


_FIXED = dict(
    **FACTS, fl=f"SELECT c.*, {_hit('t0')} AS h0, {_hit('t1')} AS h1 FROM cuts c", **_P0, **_P1, **open_sql("o", "p0"), **close_sql("c", "p1"),
    wc="""SELECT f.video_id, f.cand_id, CASE WHEN h0 THEN o.open ELSE f.t0 END AS t0, CASE WHEN h1 THEN c.close ELSE f.t1 END AS t1, h0 OR h1 AS hit
          FROM fl f JOIN o_strip o USING (video_id, cand_id) JOIN c_close c USING (video_id, cand_id)""")


@query(with_(*BASE, **_FIXED) + "SELECT video_id, cand_id, t0, round(t1, 6) AS t1 FROM wc")
def repair_word_clip(spark, d):
    sig, c = _talk(spark, d)
    out = G.repair_word_clip(c.select("video_id", "cand_id", "t0", "t1"), sig)
    return out.select("video_id", "cand_id", "t0", F.round("t1", 6).alias("t1"))


def best_run_sql(src: str, limit: float) -> dict[str, str]:
    return dict(
        iw=f"""SELECT c.video_id, c.cand_id, w.t0, w.t1, row_number() OVER v AS i, sum(CASE WHEN w.err > {limit} THEN 1 ELSE 0 END) OVER v AS bad
               FROM {src} c JOIN wf w ON w.video_id = c.video_id AND w.t0 < c.t1 AND w.t1 > c.t0 WINDOW v AS (PARTITION BY c.video_id, c.cand_id ORDER BY w.pos)""",
        br=f"""SELECT a.video_id, a.cand_id, a.t0 AS run_t0, b.t1 AS run_t1 FROM iw a JOIN iw b ON b.video_id = a.video_id AND b.cand_id = a.cand_id AND b.i >= a.i
               LEFT JOIN iw z ON z.video_id = a.video_id AND z.cand_id = a.cand_id AND z.i = a.i - 1
               WHERE (b.i - a.i + 1) - (b.bad - coalesce(z.bad, 0)) > CAST(floor(0.95::DOUBLE * (b.i - a.i)) AS INT) AND b.t1 > a.t0
               QUALIFY row_number() OVER (PARTITION BY a.video_id, a.cand_id ORDER BY b.t1 - a.t0 DESC, a.i, b.i) = 1""")


@query(with_(*BASE, **FACTS, **best_run_sql("cuts", 460.0)) + "SELECT video_id, cand_id, run_t0, run_t1 FROM br")
def best_aligned_run(spark, d):
    sig, c = _talk(spark, d)
    return G.best_aligned_run(c, sig.words, 460.0)


_FAILS = dict(
    al="""SELECT c.video_id, c.cand_id, list(w.err ORDER BY w.err) AS es FROM cuts c JOIN wf w ON w.video_id = c.video_id AND w.t0 < c.t1 AND w.t1 > c.t0 GROUP BY 1, 2""",
    p95="SELECT video_id, cand_id, es[CAST(floor(0.95::DOUBLE * (len(es) - 1)) AS INT) + 1] AS p95_ms FROM al")


@query(with_(*BASE, **_FIXED, **_FAILS, **best_run_sql("wc", 300.0),
             mk="SELECT wc.*, coalesce(p95.p95_ms > 300, false) AS al FROM wc LEFT JOIN p95 USING (video_id, cand_id)",
             fx="""SELECT m.video_id, m.cand_id, m.hit OR m.al AS due, CASE WHEN m.al AND br.run_t1 - br.run_t0 >= 30 THEN br.run_t0 ELSE m.t0 END AS a,
                   CASE WHEN m.al AND br.run_t1 - br.run_t0 >= 30 THEN br.run_t1 ELSE m.t1 END AS b FROM mk m LEFT JOIN br USING (video_id, cand_id)""",
             **clamp_sql("z", "fx")) + """
    SELECT f.video_id, f.cand_id, CASE WHEN due THEN z.t0 ELSE f.a END AS t0, round(CASE WHEN due THEN z.t1 ELSE f.b END, 6) AS t1 FROM fx f JOIN z_cut z USING (video_id, cand_id)""")
def repair(spark, d):
    sig, c = _talk(spark, d)
    c = D.settle(c.select("video_id", "cand_id", "t0", "t1"), "cuts")
    bad = D.settle(H.qa_failures(c, sig).select("video_id", "cand_id", "code"), "failures")
    out = G.repair(c, bad, sig)
    return out.select("video_id", "cand_id", "t0", F.round("t1", 6).alias("t1"))


@query()
def repair_pass(spark, d):
    sig, c = _talk(spark, d)
    cuts, bad = H.repair_pass(D.settle(c.select("video_id", "cand_id", "t0", "t1"), "cuts"), sig, settle=D.settle)
    n = bad.groupBy("video_id", "cand_id").agg(F.count("*").alias("n_failures"))
    return cuts.join(n, ["video_id", "cand_id"], "left").select("video_id", "cand_id", "t0", "t1", F.coalesce("n_failures", F.lit(0)).alias("n_failures"))


# --- quality checks -----------------------------------------------------------------------------------

_RENDER = """SELECT CAST(o_custkey AS VARCHAR) AS video_id, CAST(o_orderkey AS VARCHAR) AS cand_id,
    CASE WHEN o_orderkey % 9 = 0 THEN 1920 ELSE 1080 END AS width, CASE WHEN o_orderkey % 9 = 0 THEN 1080 WHEN o_orderkey % 13 = 0 THEN 1280 ELSE 1920 END AS height,
    (o_orderkey % 400) / 4.0::DOUBLE AS duration_s, CASE WHEN o_orderkey % 17 = 0 THEN '-inf'::DOUBLE ELSE -16.5 + (o_orderkey % 40) / 8.0::DOUBLE END AS lufs FROM orders"""


def _render(spark, d):
    k = F.col("o_orderkey")
    return D.read(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("video_id"), k.cast("string").alias("cand_id"),
        F.when(k % 9 == 0, 1920).otherwise(1080).alias("width"), F.when(k % 9 == 0, 1080).when(k % 13 == 0, 1280).otherwise(1920).alias("height"),
        (k % 400 / 4.0).alias("duration_s"), F.when(k % 17 == 0, float("-inf")).otherwise(-16.5 + k % 40 / 8.0).alias("lufs"))


@query(f"WITH r AS ({_RENDER}) SELECT video_id, cand_id, 'RES' AS code, width || 'x' || height || ' != 1080x1920' AS detail, 'render' AS route_to FROM r WHERE width <> 1080 OR height <> 1920")
def check_resolution(spark, d):
    return H.check_resolution(_render(spark, d)).drop("ord")


@query(f"""WITH r AS ({_RENDER}) SELECT video_id, cand_id, 'DUR' AS code, 'duration ' || CAST(CAST(duration_s AS DECIMAL(10, 2)) AS VARCHAR) || 's outside [5.0, 90.0]' AS detail,
    'drop' AS route_to FROM r WHERE duration_s < 5 OR duration_s > 90""")
def check_duration(spark, d):
    return H.check_duration(_render(spark, d)).drop("ord")


@query(f"""WITH r AS ({_RENDER}) SELECT video_id, cand_id, 'LUFS' AS code, CASE WHEN isinf(lufs) THEN '-inf' ELSE CAST(CAST(round_even(lufs, 1) AS DECIMAL(10, 1)) AS VARCHAR) END
    || ' LUFS outside -14.0+-1.0' AS detail, 'render' AS route_to FROM r WHERE lufs < -15 OR lufs > -13""")
def check_loudness(spark, d):
    return H.check_loudness(_render(spark, d)).drop("ord")


_STRAD = """SELECT c.video_id, c.cand_id, count(*) AS n, '[' || string_agg(CASE WHEN contains(w.text, '''') AND NOT contains(w.text, '"') THEN '"' || w.text || '"'
    ELSE '''' || replace(w.text, '''', '\\''') || '''' END, ', ' ORDER BY c.side, w.pos) || ']' AS ws
    FROM (SELECT video_id, cand_id, 0 AS side, t0 AS t FROM cuts UNION ALL SELECT video_id, cand_id, 1, t1 FROM cuts) c
    JOIN words w ON w.video_id = c.video_id AND w.t0 < c.t AND w.t1 > c.t GROUP BY 1, 2"""


@query(with_("words", "cuts", st=_STRAD) + "SELECT video_id, cand_id, 'WORD_CLIP' AS code, n || ' word(s) straddle a cut boundary: ' || ws AS detail, 'surgeon' AS route_to FROM st")
def check_word_clip(spark, d):
    sig, c = _talk(spark, d)
    return H.check_word_clip(c, sig.words).drop("ord")


@query(with_(*BASE, **FACTS, **_FAILS) + "SELECT video_id, cand_id, 'ALIGN' AS code, 'p95 align_err_ms=' || p95_ms || ' > 300.0' AS detail, 'surgeon' AS route_to FROM p95 WHERE p95_ms > 300")
def check_alignment(spark, d):
    sig, c = _talk(spark, d)
    return H.check_alignment(c, sig.words, sig.media).drop("ord")


_HOOKS = r"""SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(i AS VARCHAR) AS cand_id, CASE WHEN (doc_id + i) % 11 <> 0 THEN ss[i + 1] END AS title,
    CASE WHEN (doc_id + i) % 3 = 0 THEN 540 ELSE 1080 END AS width FROM (
        SELECT doc_id, ss, unnest(range(0, len(ss))) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?\n]') AS ss FROM documents))"""


@query(f"""WITH h AS ({_HOOKS}) SELECT video_id, cand_id, 'SAFE_AREA' AS code, CASE WHEN length(title) > 40 THEN 'hook title is ' || length(title) || ' chars, max 40'
    ELSE 'hook title estimated width ' || length(title) * 20 || 'px > ' || CAST(width * 0.9 AS INT) || 'px (90% of ' || width || 'px frame)' END AS detail, 'drop' AS route_to
    FROM h WHERE length(title) > 40 OR length(title) * 20 > width * 0.9""")
def check_title_fit(spark, d):
    """Every sentence of a document is a title."""
    k, i = F.col("doc_id"), F.col("i")
    titles = D.read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]")).alias("i", "title"))
    docs = titles.select(
        k.cast("string").alias("video_id"), i.cast("string").alias("cand_id"), F.when((k + i) % 11 != 0, F.struct("title")).alias("hook"),
        F.when((k + i) % 3 == 0, 540).otherwise(1080).alias("width"))
    return H.check_title_fit(docs.select("video_id", "cand_id", "hook"), docs.select("video_id", "cand_id", "width")).drop("ord")


_DEF = """SELECT CAST(l_orderkey AS VARCHAR) AS video_id, '1' AS cand_id, CASE WHEN l_returnflag = 'R' THEN 'black' ELSE 'frozen' END AS kind,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_linenumber * 2.5::DOUBLE AS t0, l_linenumber * 2.5::DOUBLE + 0.5 AS t1
    FROM lineitem WHERE l_returnflag IN ('R', 'A')"""


@query(f"""WITH x AS ({_DEF}) SELECT video_id, cand_id, upper(kind) AS code, count(*) || ' ' || kind || ' span(s): [' ||
    string_agg('Span(t0=' || t0 || ', t1=' || t1 || ')', ', ' ORDER BY t0) || ']' AS detail, 'render' AS route_to FROM x GROUP BY video_id, cand_id, kind""")
def check_defects(spark, d):
    li = D.read(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    spans = li.select(F.col("l_orderkey").cast("string").alias("video_id"), F.lit("1").alias("cand_id"), F.when(F.col("l_returnflag") == "R", "black").otherwise("frozen").alias("kind"),
                      F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") * 2.5).alias("t0"), (F.col("l_linenumber") * 2.5 + 0.5).alias("t1"))
    return H.check_defects(spans).drop("ord")


_REPORT = dict(r=_RENDER, f="""SELECT video_id, cand_id, 0 AS ord, 'RES' AS code FROM r WHERE width <> 1080 OR height <> 1920 UNION ALL
    SELECT video_id, cand_id, 1, 'DUR' FROM r WHERE duration_s < 5 OR duration_s > 90 UNION ALL SELECT video_id, cand_id, 2, 'LUFS' FROM r WHERE lufs < -15 OR lufs > -13""")


def _failures(spark, d):
    r = _render(spark, d)
    return r, H.check_resolution(r).unionByName(H.check_duration(r)).unionByName(H.check_loudness(r))


@query(with_(**_REPORT) + """SELECT r.video_id, r.cand_id, count(f.code) = 0 AS passed, string_agg(f.code, '; ' ORDER BY f.ord) AS dropped_reason
    FROM r LEFT JOIN f USING (video_id, cand_id) GROUP BY 1, 2""")
def qa_report(spark, d):
    r, f = _failures(spark, d)
    return H.qa_report(r, f).select("video_id", "cand_id", "passed", "dropped_reason")


@query(with_(**_REPORT) + "SELECT video_id, cand_id, CASE WHEN bool_or(code IN ('RES', 'LUFS')) THEN 'render' ELSE 'drop' END AS route FROM f GROUP BY 1, 2")
def repair_route(spark, d):
    return H.repair_route(_failures(spark, d)[1])


_CODES = "CASE (o_orderkey * 7 + n * 3) % 6 WHEN 0 THEN ['WORD_CLIP', 'BLACK'] WHEN 1 THEN ['BLACK'] WHEN 2 THEN ['DUR'] WHEN 3 THEN ['ALIGN'] WHEN 4 THEN ['LUFS', 'DUR'] ELSE [] END"


@query(f"""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS video_id, CAST(o_orderkey AS VARCHAR) AS cand_id, {_CODES.replace('n * 3', '0')} AS c0, {_CODES.replace('n * 3', '3')} AS c1, {_CODES.replace('n * 3', '6')} AS c2 FROM orders),
    r AS (SELECT *, CASE WHEN len(c0) = 0 THEN NULL WHEN list_has_any(c0, ['WORD_CLIP', 'ALIGN']) THEN 'surgeon' WHEN list_has_any(c0, ['BLACK', 'LUFS']) THEN 'render' ELSE 'drop' END AS r0,
                    CASE WHEN len(c1) = 0 THEN NULL WHEN list_has_any(c1, ['WORD_CLIP', 'ALIGN']) THEN 'surgeon' WHEN list_has_any(c1, ['BLACK', 'LUFS']) THEN 'render' ELSE 'drop' END AS r1 FROM c)
    SELECT video_id, cand_id, 1 AS attempt, array_to_string(c0, ',') AS codes, r0 AS route, CASE WHEN len(c1) = 0 THEN 'fixed' ELSE 'failed' END AS outcome FROM r WHERE r0 IN ('surgeon', 'render')
    UNION ALL SELECT video_id, cand_id, 2, array_to_string(c1, ','), r1, CASE WHEN len(c2) = 0 THEN 'fixed' ELSE 'failed' END FROM r WHERE r0 IN ('surgeon', 'render') AND r1 IN ('surgeon', 'render')""")
def repair_history(spark, d):
    k = F.pmod(F.col("o_orderkey") * 7 + F.col("n") * 3, F.lit(6))
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    codes = (F.when(k == 0, arr("WORD_CLIP", "BLACK")).when(k == 1, arr("BLACK")).when(k == 2, arr("DUR")).when(k == 3, arr("ALIGN"))
             .when(k == 4, arr("LUFS", "DUR")).otherwise(F.array().cast("array<string>")))
    checks = D.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).select(
        F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").cast("string").alias("cand_id"), F.col("n").alias("check_no"), codes.alias("codes"))
    out = H.repair_history(checks).select("video_id", "cand_id", F.inline("repairs"))
    return out.withColumn("codes", F.array_join("codes", ","))
