"""Text made from clips and their words: transcripts, hooks, captions, metadata, readable reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from momentloom.functions.expr import (
    ASCII_PUNCT, capitalise, clock, half_even, held, rstrip, strip, subtitle_time, title_case, truncate_words,
)
from momentloom.operators.cuts import IDS
from momentloom.operators.stored import settle
from momentloom.operators.timeline import interval_pairs, stab_pairs
from momentloom.sources.replies import claims_at, has_type, is_valid

# Hook limits and word lists.
MAX_TITLE_WORDS = 8
MAX_TITLE_CHARS = 40
FALLBACK_WORDS = 6
CAPTION_CAPS = {"tiktok": 150, "reels": 125, "shorts": 100}
BANNED = ["doctors hate", "gone wrong", "number 7 will", "wait for it", "watch till the end", "you won't believe"]
PROFANE = ["asshole", "bitch", "crap", "damn", "fuck", "shit"]

# Publish metadata limits.
TITLE_MAX = 100
DESC_MAX = 4900
TAGS_TOTAL = 480
MAX_HASHTAGS = 5
MAX_TAGS = 12
SHORTS = "#Shorts"
EXCERPT = 300

# Caption grouping.
MIN_GROUP, MAX_GROUP, GAP_S, MARKS = 3, 5, 1.2, ".,!?;:"


def clip_words(cuts: DataFrame, words: DataFrame, width: float = 64.0) -> DataFrame:
    """Words overlapping each cut: ``video_id, cand_id, pos, text, s0, s1``."""
    spans = words.select("video_id", "pos", "text", F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    pairs = interval_pairs(cuts.select(*IDS, "t0", "t1"), spans, "t0", "t1", "s0", "s1",
                           (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0")), width=width)
    return pairs.select(*IDS, "pos", "text", "s0", "s1")


def clip_transcript(cuts: DataFrame, words: DataFrame, width: float = 64.0) -> DataFrame:
    """Words of each cut in order, joined by a space; empty text for a silent cut."""
    spoken = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)
    per = clip_words(cuts, words, width).groupBy(*IDS).agg(spoken.alias("tokens"))
    out = cuts.select(*IDS).join(per, list(IDS), "left")
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    return out.select(*IDS, tokens.alias("tokens"), F.array_join(tokens, " ").alias("transcript"))


def hook_messages(title: Column, captions: Column) -> Column:
    """Every limit a hook breaks, as messages in a fixed order. What they ask of the title is computed once per row."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "['\"]", ""), r"\s+", " "))
    edge = rf"^{ASCII_PUNCT}+|{ASCII_PUNCT}+$"
    tokens = F.transform(words, lambda w: F.regexp_replace(F.lower(w), edge, ""))
    rude = F.array_intersect(F.array(*[F.lit(w) for w in PROFANE]), tokens)
    facts = F.struct(F.size(words).alias("n"), F.length(title).alias("chars"), flat.alias("flat"), rude.alias("rude"))
    return F.transform(F.array(facts), lambda x: _messages(x["n"], x["chars"], x["flat"], x["rude"], captions))[0]


def _messages(n: Column, chars: Column, flat: Column, rude: Column, captions: Column) -> Column:
    out = [
        F.when(n > MAX_TITLE_WORDS, F.format_string(f"title has %d words, max {MAX_TITLE_WORDS}", n)),
        F.when(chars > MAX_TITLE_CHARS, F.format_string(f"title is %d chars, max {MAX_TITLE_CHARS}", chars)),
    ]
    out += [F.when(flat.contains(p.replace("'", "")), F.lit(f"title contains banned phrase {p!r}")) for p in BANNED]
    shown = F.concat(F.lit("title contains profanity: ['"), F.array_join(rude, "', '"), F.lit("']"))
    out.append(F.when(F.size(rude) > 0, shown))
    for platform, cap in CAPTION_CAPS.items():
        c = captions[platform]
        out.append(F.when(c.isNull(), F.lit(f"{platform} caption missing or not a string")).when(
            F.length(c) > cap, F.format_string(f"{platform} caption is %d chars, max {cap}", F.length(c))))
    return F.array_compact(F.array(*out))


def hook_violations(hooks: DataFrame) -> DataFrame:
    """One row per hook ``video_id, cand_id, title, captions`` with its broken limits."""
    return hooks.select(*IDS, hook_messages(F.col("title"), F.col("captions")).alias("violations"))


def fallback_title(tokens: Column) -> Column:
    text = F.regexp_replace(strip(F.array_join(F.slice(tokens, 1, FALLBACK_WORDS), " ")), r"[.,!?;:\-]+$", "")
    title = title_case(text)
    title = F.when(title == "", F.lit("Watch This Clip")).otherwise(title)
    return F.when(F.length(title) > MAX_TITLE_CHARS, rstrip(F.substring(title, 1, MAX_TITLE_CHARS))).otherwise(title)


def fallback_hook(cuts: DataFrame, words: DataFrame, width: float = 64.0) -> DataFrame:
    """Title and captions taken from the cut's own words."""
    caps = F.map_from_arrays(
        F.array(*[F.lit(p) for p in CAPTION_CAPS]), F.array(*[truncate_words("transcript", c) for c in CAPTION_CAPS.values()]))
    said = clip_transcript(cuts, words, width)
    return said.select(*IDS, fallback_title(F.col("tokens")).alias("title"), caps.alias("captions"))


def choose_hook(replies: DataFrame, cuts: DataFrame, words: DataFrame, width: float = 64.0) -> DataFrame:
    """First of two stored replies ``video_id, cand_id, attempt, reply`` that breaks no limit, else the fallback.

    A missing or unreadable first reply goes straight to the fallback.
    """
    v = F.col("_v")
    shape = is_valid(v, ["title", "captions"], {"title": "string", "captions": "object"})
    caption = lambda p: F.when(has_type(v, f"$.captions.{p}", "string"), F.try_variant_get(v, f"$.captions.{p}", "string"))
    read = held(replies.where(F.col("attempt") <= 2), _v=F.try_parse_json("reply")).select(
        *IDS, "attempt", F.when(shape, F.try_variant_get(v, "$.title", "string")).alias("title"),
        F.map_from_arrays(F.array(*[F.lit(p) for p in CAPTION_CAPS]), F.array(*[caption(p) for p in CAPTION_CAPS])).alias("captions"))
    good = F.col("title").isNotNull() & (F.size(hook_messages(F.col("title"), F.col("captions"))) == 0)
    best = read.groupBy(*IDS).agg(
        F.min_by(F.struct("title", "captions"), F.when(good, F.col("attempt"))).alias("live"),
        F.max((F.col("attempt") == 1) & F.col("title").isNotNull()).alias("first_read"))
    out = fallback_hook(cuts, words, width).join(best, list(IDS), "left")
    use = F.coalesce(F.col("first_read"), F.lit(False)) & F.col("live").isNotNull()
    return out.select(*IDS, F.when(use, F.col("live.title")).otherwise(F.col("title")).alias("title"),
                      F.when(use, F.col("live.captions")).otherwise(F.col("captions")).alias("captions"),
                      F.when(use, "live").otherwise("fallback").alias("mode"))


# --- publish metadata ---------------------------------------------------------------------------


def dedupe_text(items: Column) -> Column:
    """First of each text, compared without case."""
    none = F.array().cast("array<string>")
    return F.aggregate(items, none, lambda acc, x: F.when(
        F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def budget_tags(tags: Column) -> Column:
    """Whole tags while count and total length allow; the first that does not fit ends the list."""
    clean = F.filter(F.transform(tags, strip), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("total"), F.lit(False).alias("stop"))

    def step(acc, t):
        add = F.length(t) + F.when(F.size(acc.out) > 0, 1).otherwise(0)
        stop = acc.stop | (F.size(acc.out) >= MAX_TAGS) | (acc.total + add > TAGS_TOTAL)
        return F.struct(F.when(stop, acc.out).otherwise(F.concat(acc.out, F.array(t))).alias("out"),
                        F.when(stop, acc.total).otherwise(acc.total + add).alias("total"), stop.alias("stop"))

    return F.aggregate(clean, start, step)["out"]


def publish_title(hook_title: Column) -> Column:
    base = strip(hook_title)
    room = F.length(base) + 1 + len(SHORTS) <= TITLE_MAX
    title = F.when(F.lower(base).contains(SHORTS.lower()), base).when(room, F.concat(base, F.lit(f" {SHORTS}"))).otherwise(base)
    return rstrip(F.substring(title, 1, TITLE_MAX))


def compose(df: DataFrame) -> DataFrame:
    """Limit and assemble parts ``video_id, cand_id, hook_title, description, hashtags, tags``."""
    words = F.filter(F.transform("hashtags", lambda h: F.regexp_replace(h, "[^0-9A-Za-z]", "")), lambda h: h != "")
    marks = F.slice(dedupe_text(F.concat(F.array(F.lit(SHORTS)), F.transform(words, lambda h: F.concat(F.lit("#"), h)))), 1, MAX_HASHTAGS)
    body = strip(F.regexp_replace(strip(F.col("description")), r"(?U)(?:\s*#\w+)+\s*$", ""))
    full = strip(F.concat(body, F.lit("\n\n"), F.array_join("marks", " ")))
    full = F.when(F.length(full) > DESC_MAX, rstrip(F.substring(full, 1, DESC_MAX))).otherwise(full)
    return df.withColumn("marks", marks).select(
        *IDS, publish_title(F.col("hook_title")).alias("title"), full.alias("description"), F.col("marks").alias("hashtags"),
        budget_tags(dedupe_text(F.concat("tags", F.array(F.lit("shorts"))))).alias("tags"),
        F.lit("24").alias("category_id"), F.lit("unlisted").alias("privacy"))


def publish_metadata(clips: DataFrame, words: DataFrame, replies: DataFrame | None = None, width: float = 64.0) -> DataFrame:
    """Publish record per kept clip ``video_id, cand_id, t0, t1, hook_title``; replies are optional.

    ``replies`` holds ``video_id, cand_id, attempt, reply``; the first readable of two counts.
    """
    said = clip_transcript(clips, words, width).select(*IDS, strip(F.col("transcript")).alias("said"))
    rows = clips.select(*IDS, F.coalesce("hook_title", F.lit("Watch this clip")).alias("hook_title")).join(said, list(IDS))
    head = F.substring("said", 1, EXCERPT)
    cut = rstrip(F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head))
    excerpt = F.when(F.length("said") > EXCERPT, F.concat(cut, F.lit("…"))).otherwise(F.col("said"))
    key = F.filter(F.regexp_extract_all("hook_title", F.lit("([A-Za-z']+)"), F.lit(1)), lambda w: F.length(w) > 2)
    lower = F.transform(key, F.lower)
    rows = rows.select(
        *IDS, "hook_title",
        F.when(excerpt != "", F.concat(strip(F.col("hook_title")), F.lit("\n\n"), excerpt)).otherwise(strip(F.col("hook_title"))).alias("description"),
        F.slice(lower, 1, 3).alias("hashtags"), lower.alias("tags"))
    if replies is not None:
        v = F.col("_v")
        ok = is_valid(v, ["description", "hashtags", "tags"], {"description": "string", "hashtags": "array", "tags": "array"})
        texts = lambda p: F.transform(F.try_variant_get(v, p, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
        live = held(replies.where(F.col("attempt") <= 2), _v=F.try_parse_json("reply")).select(*IDS, "attempt", F.when(ok, F.struct(
            F.try_variant_get(v, "$.description", "string").alias("description"), texts("$.hashtags").alias("hashtags"), texts("$.tags").alias("tags"))).alias("p"))
        live = live.groupBy(*IDS).agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("attempt"))).alias("p"))
        rows = rows.join(live, list(IDS), "left").select(
            *IDS, "hook_title", *[F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in ("description", "hashtags", "tags")])
    return compose(rows)


# --- captions -------------------------------------------------------------------------------------


#: Words of a cut that are folded together.
CAPTION_BLOCK = 64


def caption_lines(cuts: DataFrame, words: DataFrame, min_words: int = MIN_GROUP, max_words: int = MAX_GROUP,
                  gap_s: float = GAP_S, width: float = 64.0, block: int = CAPTION_BLOCK) -> DataFrame:
    """Words starting inside each cut, on the cut's own clock, grouped into lines of 3 to 5.

    Where a line ends depends only on how many words it has so far, of which there are ``max_words`` cases. So a block
    of words is a table from each case to the case and the number of lines after it; the tables of a cut, one after another,
    give every block its start, and within it the words are counted off. No word waits for more than its block.
    """
    spans = words.select("video_id", "pos", "text", F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    inside = stab_pairs(spans, cuts.select(*IDS, "t0", "t1"), "s0", "t0", "t1",
                        (F.col("s0") >= F.col("t0")) & (F.col("s0") < F.col("t1")), width=width, how="inner")
    rel = inside.select(*IDS, "pos", "text", (F.col("s0") - F.col("t0")).alias("t0"), (F.col("s1") - F.col("t0")).alias("t1"))
    order = W.partitionBy(*IDS).orderBy("pos")
    gap = F.coalesce(F.lead("t0").over(order) - F.col("t1"), F.lit(0.0))
    pause = F.substring(rstrip(F.col("text")), -1, 1).isin(*MARKS) | (gap > gap_s)
    blocks = rel.select(*IDS, F.floor((F.row_number().over(order) - 1) / block).cast("int").alias("block"),
                        F.struct("pos", F.coalesce(pause, F.lit(False)).alias("pause"), "text", "t0", "t1").alias("word"))
    blocks = settle(blocks.groupBy(*IDS, "block").agg(F.array_sort(F.collect_list("word")).alias("words")), "blocks")

    at = lambda n, line: F.struct(n.cast("int").alias("n"), line.cast("int").alias("line"))

    def step(s: Column, pause: Column) -> Column:
        n = s.n + 1
        ends = (n >= max_words) | ((n >= min_words) & pause)
        return at(F.when(ends, 0).otherwise(n), s.line + F.when(ends, 1).otherwise(0))

    pauses = F.transform("words", lambda w: w.pause)
    table = F.array(*[F.aggregate(pauses, at(F.lit(n), F.lit(0)), step) for n in range(max_words)])
    tables = blocks.select(*IDS, F.struct("block", table.alias("to")).alias("x")).groupBy(*IDS).agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def follow(held: Column, x: Column) -> Column:
        to = F.element_at(x.to, held.now.n + 1)
        return F.struct(at(to.n, held.now.line + to.line).alias("now"), F.concat(held.starts, F.array(F.struct(x.block.alias("block"), held.now.alias("now")))).alias("starts"))

    start = at(F.lit(0), F.lit(0))
    none = F.array().cast("array<struct<block:int,now:struct<n:int,line:int>>>")
    starts = tables.select(*IDS, F.inline(F.aggregate("xs", F.struct(start.alias("now"), none.alias("starts")), follow, lambda s: s.starts)))

    def count(held: Column, pause: Column) -> Column:
        return F.struct(step(held.now, pause).alias("now"), F.concat(held.places, F.array(held.now)).alias("places"))

    no_place = F.array().cast("array<struct<n:int,line:int>>")
    placed = blocks.join(starts, [*IDS, "block"]).select(*IDS, "words", F.aggregate(pauses, F.struct(F.col("now"), no_place.alias("places")), count, lambda s: s.places).alias("places"))
    each = placed.select(*IDS, F.inline(F.arrays_zip("words", "places")))
    return each.select(*IDS, F.col("words.pos").cast("int").alias("pos"), "words.text", "words.t0", "words.t1", F.col("places.line").alias("line_no"), F.col("places.n").alias("word_no"))


def karaoke_timing(lines: DataFrame) -> DataFrame:
    """Line start, end and marked-up text with one highlight duration per word."""
    w = W.partitionBy(*IDS, "line_no").orderBy("pos")
    span = F.coalesce(F.lead("t0").over(w), F.col("t1")) - F.col("t0")
    centis = F.greatest(half_even(span * 100), F.lit(0).cast("bigint"))
    safe = F.replace("text", F.lit("\\"), F.lit("\\\\"))
    safe = F.translate(F.replace(safe, F.lit("\n"), F.lit(" ")), "{}", "()")
    part = F.concat(F.lit("{\\kf"), centis.cast("string"), F.lit("}"), safe)
    timed = lines.select(*IDS, "line_no", "pos", "t0", "t1", part.alias("part"))
    return timed.groupBy(*IDS, "line_no").agg(
        subtitle_time(F.min_by("t0", "pos")).alias("start"), subtitle_time(F.max_by("t1", "pos")).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x.part), " ").alias("text"))


# --- readable reports -----------------------------------------------------------------------------

# Labels shown for codes.
PART_ORDER = ["hook_strength", "payoff", "emotion", "quotability"]
PART_LABELS = {"hook_strength": "Hook strength", "payoff": "Payoff", "emotion": "Emotion", "quotability": "Quotability"}
SOURCE_LABELS = {
    "rule_a_energy_rate": "Found by: energy + speech-rate rule",
    "llm": "Found by: AI semantic pass",
    "fallback": "Padding (low-signal content)",
}
ROUTE_LABELS = {"surgeon": "re-cut", "render": "re-render"}
QA_LABELS = {
    "RES": "Wrong resolution", "LUFS": "Audio loudness off-target", "BLACK": "Black frame detected",
    "FROZEN": "Frozen frame detected", "WORD_CLIP": "Clipped word at the cut", "ALIGN": "Caption alignment issue",
    "DUR": "Clip duration out of range", "SAFE_AREA": "Caption overflowed safe area",
}
CLAIM_LABELS = {
    "laughter": "Laughter", "applause": "Applause", "rate_surge": "Faster speech",
    "silence": "Natural pause", "scene_stable": "Stable shot",
}
QUOTE_MAX = 60


def label(code: Column, names: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[code], other)


def plain_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def claim_line(c: Column) -> Column:
    """One claim as a readable line; odd values fall back to a plain time."""
    at = F.concat(F.lit(" at "), clock(c.t))
    text = c.value_str
    short = F.when(F.length(text) > QUOTE_MAX, F.concat(F.substring(text, 1, QUOTE_MAX - 1), F.lit("…"))).otherwise(text)
    return (
        F.when(c.kind == "energy_peak", F.when(
            c.value_num.isNotNull(), F.concat(F.lit("Energy spike +"), plain_number(c.value_num), F.lit("σ"), at)
        ).otherwise(F.concat(F.lit("Energy spike"), at)))
        .when(c.kind == "quote", F.when(text.isNotNull(), F.concat(F.lit('Quotable: "'), short, F.lit('"'))).otherwise(
            F.concat(F.lit("Quotable moment"), at)))
        .otherwise(F.concat(label(c.kind, CLAIM_LABELS, c.kind), at))
    )


def repair_line(v: Column) -> Column:
    """One stored repair entry as a readable line; every field may be missing or of another type."""
    attempt = F.when(has_type(v, "$.attempt", "number"), plain_number(F.try_variant_get(v, "$.attempt", "double"))).otherwise("?")
    items = F.filter(F.try_variant_get(v, "$.codes", "array<variant>"), lambda x: has_type(x, "$", "string"))
    codes = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), ", ")
    route = F.when(has_type(v, "$.route", "string"), F.try_variant_get(v, "$.route", "string"))
    way = F.when(route.isNull(), "unknown step").otherwise(label(route, ROUTE_LABELS, route))
    outcome = F.when(has_type(v, "$.outcome", "string") & (F.try_variant_get(v, "$.outcome", "string") == "fixed"), "fixed").otherwise("attempted to fix")
    shown = F.when(F.coalesce(codes, F.lit("")) == "", "an issue").otherwise(codes)
    return F.concat(F.lit("Attempt "), attempt, F.lit(": "), outcome, F.lit(" "), shown, F.lit(" via "), way)


def evidence_report(clips: DataFrame) -> DataFrame:
    """Readable lines ``job_id, clip_index, section, ord, line`` from clip rows with parsed ``candidate, score, repairs, qa``.

    ``candidate`` and ``score`` carry parsed claims (``tables.with_claims``), ``repairs`` JSON text or variants. All lines of a clip come from its one row.
    """
    c = F.col
    none = F.array().cast("array<struct<section:string,ord:int,line:string>>")

    def at(section, ord_, text):
        return F.struct(F.lit(section).alias("section"), ord_.cast("int").alias("ord"), text.alias("line"))

    def each(section, items, text):
        return F.coalesce(F.transform(items, lambda x, i: at(section, i, text(x))), none)

    def component(p):
        rank = F.array_position(F.array(*[F.lit(n) for n in PART_ORDER]), p.key)
        name = label(p.key, PART_LABELS, capitalise(F.replace(p.key, F.lit("_"), F.lit(" "))))
        head = at("component", rank * 1000, F.concat(name, F.lit(": "), plain_number(p.value.score), F.lit("/25")))
        cited = F.transform(p.value.evidence, lambda x, i: at("component", rank * 1000 + 1 + i, claim_line(x)))
        return F.when(rank > 0, F.concat(F.array(head), F.coalesce(cited, none))).otherwise(none)

    source = F.array(at("source", F.lit(0), label(c("candidate.source"), SOURCE_LABELS, F.concat(F.lit("Found by: "), c("candidate.source")))))
    lines = F.concat(
        F.when(c("candidate").isNotNull(), source).otherwise(none),
        each("claim", c("candidate.evidence"), claim_line),
        F.coalesce(F.flatten(F.transform(F.map_entries("score.components"), component)), none),
        each("repair", F.transform("repairs", _as_variant(clips, "repairs")), repair_line),
        each("qa", c("qa.failures"), lambda f: label(f.code, QA_LABELS, f.code)),
    )
    return clips.select("job_id", "clip_index", F.inline(lines))


def _as_variant(df: DataFrame, name: str):
    """What reads an entry of the array ``name``: texts are parsed, variants are."""
    return (lambda x: x) if isinstance(df.schema[name].dataType.elementType, VariantType) else F.try_parse_json


# Activity lines per agent.
AGENT_LINES = {
    "critic": "Critic is scoring candidates", "surgeon": "Trimming cuts", "hooks": "Writing hooks", "qa": "Quality checks",
}


def activity_feed(events: DataFrame) -> DataFrame:
    """Adds a readable ``line`` to agent events ``agent, action, payload``."""
    rows = held(events, _v=F.try_parse_json("payload"))
    v = F.col("_v")
    count = F.when(has_type(v, "$.count", "number"), F.try_variant_get(v, "$.count", "double"))
    found = F.concat(F.lit("Scout found "), plain_number(count), F.when(count == 1, " moment").otherwise(" moments"))
    agent = F.col("agent")
    text = F.when(agent == "scout", F.when((F.col("action") == "found") & count.isNotNull(), found).otherwise("Scout is scanning…")).otherwise(
        label(agent, AGENT_LINES, capitalise(agent)))
    return rows.withColumn("line", text).drop("_v")
