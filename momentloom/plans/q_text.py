"""Queries over clip texts, captions, metadata and readable reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentloom.operators import text as I
from momentloom.plans import derive as D
from momentloom.plans.q_cuts import _talk
from momentloom.plans.registry import query, with_

_SAID = """SELECT c.video_id, c.cand_id, coalesce(list(w.text ORDER BY w.pos) FILTER (w.text IS NOT NULL), []) AS ws FROM cuts c
    LEFT JOIN words w ON w.video_id = c.video_id AND w.t0 < c.t1 AND w.t1 > c.t0 GROUP BY 1, 2"""
_TR = dict(said=_SAID, tr="SELECT *, array_to_string(ws, ' ') AS tx FROM said")


@query(with_("words", "cuts", **_TR) + "SELECT video_id, cand_id, tx AS transcript FROM tr")
def clip_transcript(spark, d):
    sig, c = _talk(spark, d)
    return I.clip_transcript(c, sig.words).select("video_id", "cand_id", "transcript")


_PHRASES = ["Doctors hate it: ", "It was gone wrong. ", "You Won't  Believe ", "damn! ", "", "", ""]


def _hook_rows(spark, d):
    """Every sentence of a document is a title, every line a caption: row ``i`` of a document has its ``i``-th of both."""
    k, i = F.col("doc_id"), F.col("i")
    text = F.coalesce("text", F.lit(""))
    parts = D.read(spark, d, "documents").select("doc_id", F.posexplode(F.arrays_zip(
        F.split(text, r"[.!?\n\t]").alias("title"), F.split(text, r"\n").alias("body"))).alias("i", "x")).select("doc_id", "i", "x.title", "x.body")
    head = F.get(F.array(*[F.lit(p) for p in _PHRASES]), ((k + i) % 7).cast("int"))
    body = F.col("body")
    caps = F.map_from_arrays(F.array(F.lit("tiktok"), F.lit("reels"), F.lit("shorts")), F.array(body, F.when((k + i) % 4 != 0, body), body))
    return parts.select(k.cast("string").alias("video_id"), i.cast("string").alias("cand_id"), F.concat(head, F.coalesce("title", F.lit(""))).alias("title"), caps.alias("captions"))


@query(r"""WITH p AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?\n\t]') AS ss, string_split_regex(coalesce(text, ''), '\n') AS ls FROM documents),
    q AS (SELECT *, unnest(range(0, greatest(len(ss), len(ls)))) AS i FROM p),
    h AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(i AS VARCHAR) AS cand_id, (doc_id + i) % 4 <> 0 AS has_reels, ls[i + 1] AS body,
        ['Doctors hate it: ', 'It was gone wrong. ', 'You Won''t  Believe ', 'damn! ', '', '', ''][(doc_id + i) % 7 + 1] || coalesce(ss[i + 1], '') AS title FROM q),
    n AS (SELECT *, list_filter(string_split_regex(title, '\s+'), lambda w: w <> '') AS ws FROM h)
    SELECT video_id, cand_id, concat_ws('; ',
        CASE WHEN len(ws) > 8 THEN 'title has ' || len(ws) || ' words, max 8' END,
        CASE WHEN length(title) > 40 THEN 'title is ' || length(title) || ' chars, max 40' END,
        CASE WHEN contains(lower(title), 'doctors hate') THEN 'title contains banned phrase ''doctors hate''' END,
        CASE WHEN contains(lower(title), 'gone wrong') THEN 'title contains banned phrase ''gone wrong''' END,
        CASE WHEN title LIKE 'You Won''t  Believe%' THEN 'title contains banned phrase "you won''t believe"' END,
        CASE WHEN title LIKE 'damn!%' THEN 'title contains profanity: [''damn'']' END,
        CASE WHEN body IS NULL THEN 'tiktok caption missing or not a string' WHEN length(body) > 150 THEN 'tiktok caption is ' || length(body) || ' chars, max 150' END,
        CASE WHEN NOT has_reels OR body IS NULL THEN 'reels caption missing or not a string' WHEN length(body) > 125 THEN 'reels caption is ' || length(body) || ' chars, max 125' END,
        CASE WHEN body IS NULL THEN 'shorts caption missing or not a string' WHEN length(body) > 100 THEN 'shorts caption is ' || length(body) || ' chars, max 100' END) AS violations FROM n""")
def hook_violations(spark, d):
    return I.hook_violations(_hook_rows(spark, d)).withColumn("violations", F.array_join("violations", "; "))


_TITLE6 = r"rtrim(trim(array_to_string(ws[1:6], ' ')), '.,!?;:-')"
_CASED = """array_to_string(list_transform(list_zip(string_split(x, ''), list_concat([''], string_split(x, ''))[1:length(x)]),
            lambda p: CASE WHEN regexp_matches(p[2], '\\p{L}') THEN lower(p[1]) WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END), '')"""


def _cap_sql(n: int) -> str:
    head = f"rtrim(substr(tx, 1, {n - 1}))"
    return f"CASE WHEN length(tx) <= {n} THEN tx ELSE rtrim(CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END) || '…' END"


@query(with_("words", "cuts", **_TR, t6=f"SELECT *, {_TITLE6} AS x FROM tr", tc=f"SELECT *, CASE WHEN x = '' THEN 'Watch This Clip' ELSE {_CASED} END AS ti FROM t6") + f"""
    SELECT video_id, cand_id, CASE WHEN length(ti) > 40 THEN rtrim(substr(ti, 1, 40)) ELSE ti END AS title,
           {_cap_sql(150)} AS tiktok, {_cap_sql(125)} AS reels, {_cap_sql(100)} AS shorts FROM tc""")
def fallback_hook(spark, d):
    sig, c = _talk(spark, d)
    out = I.fallback_hook(c, sig.words)
    return out.select("video_id", "cand_id", "title", *[F.col("captions")[p].alias(p) for p in I.CAPTION_CAPS])


def _hook_replies(c):
    """Stored hooks: short, too long, or unreadable, by turn."""
    ok = F.lit('{"title":"Short and sweet","captions":{"tiktok":"a","reels":"b","shorts":"c"}}')
    long = F.lit('{"title":"this title has far too many words to ever fit in","captions":{"tiktok":"a","reels":"b","shorts":"c"}}')
    k = F.col("turn") % 4
    first = F.when(k == 0, ok).when(k == 3, F.lit("{")).otherwise(long)
    second = F.when(k == 2, long).otherwise(ok)
    return c.select("video_id", "cand_id", F.inline(F.array(
        F.struct(F.lit(1).alias("attempt"), first.alias("reply")), F.struct(F.lit(2).alias("attempt"), second.alias("reply")))))


@query(with_("words", "cuts") + """SELECT video_id, cand_id, CASE WHEN turn % 4 IN (0, 1) THEN 'live' ELSE 'fallback' END AS mode,
    CASE WHEN turn % 4 IN (0, 1) THEN 'Short and sweet' END AS title FROM cuts""")
def choose_hook(spark, d):
    sig, c = _talk(spark, d)
    out = I.choose_hook(_hook_replies(c), c, sig.words)
    return out.select("video_id", "cand_id", "mode", F.when(F.col("mode") == "live", F.col("title")).alias("title"))


_META = dict(
    hk="SELECT tr.*, 'The ' || coalesce(ws[1], '') || ' of ' || coalesce(ws[2], '') || ' it''s' AS hook FROM tr",
    k1="SELECT *, list_transform(list_filter(regexp_extract_all(hook, '[A-Za-z'']+'), lambda w: length(w) > 2), lambda w: lower(w)) AS kw, trim(tx) AS said FROM hk",
    k2="""SELECT *, CASE WHEN length(said) > 300 THEN rtrim(regexp_replace(substr(said, 1, 300), ' [^ ]*$', '')) || '…' ELSE said END AS ex,
          list_filter(list_transform(kw[1:3], lambda w: regexp_replace(w, '[^0-9A-Za-z]', '', 'g')), lambda w: w <> '') AS hs FROM k1""",
    k3="""SELECT *, list_transform(list_filter(list_zip(hs, range(1, len(hs) + 1)), lambda p: list_position(hs, p[1]) = p[2] AND lower(p[1]) <> 'shorts'), lambda p: '#' || p[1]) AS tags1,
          list_transform(list_filter(list_zip(kw, range(1, len(kw) + 1)), lambda p: list_position(kw, p[1]) = p[2] AND p[1] <> 'shorts'), lambda p: p[1]) AS kws FROM k2""")


@query(with_("words", "cuts", **_TR, **_META) + """SELECT video_id, cand_id, hook || ' #Shorts' AS title,
    rtrim(substr(trim(hook) || CASE WHEN ex <> '' THEN chr(10) || chr(10) || ex ELSE '' END || chr(10) || chr(10) || array_to_string(list_concat(['#Shorts'], tags1), ' '), 1, 4900)) AS description,
    array_to_string(list_concat(['#Shorts'], tags1), ' ') AS hashtags, array_to_string(list_concat(kws, ['shorts']), ',') AS tags FROM k3""")
def publish_metadata(spark, d):
    sig, c = _talk(spark, d)
    said = I.clip_transcript(c, sig.words)
    word = lambda i: F.coalesce(F.get("tokens", F.lit(i)), F.lit(""))
    hooks = said.select("video_id", "cand_id", F.concat(F.lit("The "), word(0), F.lit(" of "), word(1), F.lit(" it's")).alias("hook_title"))
    clips = D.settle(c.join(hooks, ["video_id", "cand_id"]).select("video_id", "cand_id", "t0", "t1", "hook_title"), "clips")
    out = I.publish_metadata(clips, sig.words)
    return out.select("video_id", "cand_id", "title", "description", F.array_join("hashtags", " ").alias("hashtags"), F.array_join("tags", ",").alias("tags"))


_INSIDE = """SELECT c.video_id, c.cand_id, w.pos, w.text, w.t0 - c.t0 AS t0, w.t1 - c.t0 AS t1, row_number() OVER v AS n,
    lead(w.t0) OVER v - w.t1 > 1.2 AS gap FROM cuts c JOIN words w ON w.video_id = c.video_id AND w.t0 >= c.t0 AND w.t0 < c.t1
    WINDOW v AS (PARTITION BY c.video_id, c.cand_id ORDER BY w.pos)"""
_LINES = dict(
    cw=_INSIDE,
    ln="""SELECT video_id, cand_id, 1::BIGINT AS n, 0 AS line_no, 0 AS word_no FROM cw WHERE n = 1 UNION ALL
          SELECT l.video_id, l.cand_id, l.n + 1, CASE WHEN l.word_no >= 4 OR (l.word_no >= 2 AND (regexp_matches(p.text, '[.,!?;:]$') OR coalesce(p.gap, false))) THEN l.line_no + 1 ELSE l.line_no END,
                 CASE WHEN l.word_no >= 4 OR (l.word_no >= 2 AND (regexp_matches(p.text, '[.,!?;:]$') OR coalesce(p.gap, false))) THEN 0 ELSE l.word_no + 1 END
          FROM ln l JOIN cw p ON p.video_id = l.video_id AND p.cand_id = l.cand_id AND p.n = l.n JOIN cw x ON x.video_id = l.video_id AND x.cand_id = l.cand_id AND x.n = l.n + 1""",
    lw="SELECT cw.*, ln.line_no, ln.word_no FROM cw JOIN ln USING (video_id, cand_id, n)")


@query(with_("words", "cuts", **_LINES) + "SELECT video_id, cand_id, pos, line_no, word_no, t0 FROM lw")
def caption_lines(spark, d):
    sig, c = _talk(spark, d)
    return I.caption_lines(c, sig.words).select("video_id", "cand_id", "pos", "line_no", "word_no", "t0")


_AT = "CAST(CAST(round_even(greatest({0}, 0) * 100, 0) AS BIGINT) // 360000 AS VARCHAR) || ':' || lpad(CAST(CAST(round_even({0} * 100, 0) AS BIGINT) % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even({0} * 100, 0) AS BIGINT) % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(round_even({0} * 100, 0) AS BIGINT) % 100 AS VARCHAR), 2, '0')"


@query(with_("words", "cuts", **_LINES, ka="SELECT *, coalesce(lead(t0) OVER (PARTITION BY video_id, cand_id, line_no ORDER BY pos), t1) - t0 AS span FROM lw") + f"""
    SELECT video_id, cand_id, line_no, {_AT.format('min(t0)')} AS start, {_AT.format('max(t1)')} AS "end",
           string_agg('{{\\kf' || greatest(CAST(round_even(span * 100, 0) AS BIGINT), 0) || '}}' || replace(replace(replace(text, '\\', '\\\\'), '{{', '('), '}}', ')'), ' ' ORDER BY pos) AS text
    FROM ka GROUP BY 1, 2, 3""")
def karaoke_timing(spark, d):
    sig, c = _talk(spark, d)
    return I.karaoke_timing(D.settle(I.caption_lines(c, sig.words), "lines"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'Scout is scanning…' WHEN event_id % 3 = 1
        OR json_extract(props, '$.k')::INT = 1 THEN 'Scout found 1 moment' ELSE 'Scout found ' || json_extract(props, '$.k') || ' moments' END
    WHEN 'view' THEN 'Critic is scoring candidates' WHEN 'purchase' THEN 'Trimming cuts' WHEN 'signup' THEN 'Quality checks' ELSE 'Orchestrator' END AS line
    FROM events""")
def activity_feed(spark, d):
    e = D.read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id") % 3
    payload = F.when(n == 0, F.lit('{"note":"x"}')).when(n == 1, F.lit('{"count":1}')).otherwise(F.concat(F.lit('{"count":'), k, F.lit("}")))
    agents = e.select("event_id", D.agent_of(F.col("event_type")).alias("agent"), F.when(n == 0, "scan").otherwise("found").alias("action"), payload.alias("payload"))
    return I.activity_feed(agents).select("event_id", "line")
