"""Readers of signal documents, run results and agent logs, and the maintenance of the tables they feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.functions.expr import half_up, held, strip
from momentloom.schemas import AGENT_EVENTS, BOX, RUN_RESULT, RUN_ROWS, Signals
from momentloom.sources.replies import read_claims

# Keys a signal document must have, and its version.
INDEX_KEYS = [
    "version", "media", "language", "words", "fillers", "speech", "silences", "energy", "peaks", "rate", "pitch",
    "surges", "monotone", "events", "scenes", "faces", "motion", "defects_black", "defects_frozen",
]
INDEX_VERSION = 1
_SPAN = "array<struct<t0:double,t1:double>>"
_CURVE = "struct<hop_s:double,values:array<double>>"
INDEX_DDL = (
    "struct<version:int,media:struct<duration_s:double,fps:double,width:int,height:int>,language:string,"
    "words:array<struct<text:string,t0:double,t1:double,conf:double,align_err_ms:double>>,"
    f"fillers:{_SPAN},speech:{_SPAN},silences:{_SPAN},energy:{_CURVE},peaks:array<struct<t:double,sigma:double>>,"
    f"rate:{_CURVE},pitch:{_CURVE},surges:{_SPAN},monotone:{_SPAN},"
    "events:array<struct<label:string,t0:double,t1:double,conf:double>>,"
    f"scenes:{_SPAN},faces:array<struct<t:double,boxes:array<{BOX}>,dominant:int>>,motion:{_CURVE},"
    f"defects_black:{_SPAN},defects_frozen:{_SPAN}>"
)


def judge_signal_index(docs: DataFrame) -> DataFrame:
    """``video_id, doc, reason`` of every document ``video_id, raw`` in one pass; ``reason`` is null for good ones."""
    docs = held(docs, keys=F.json_object_keys("raw"), parsed=F.from_json("raw", INDEX_DDL))
    keys, parsed = F.col("keys"), F.col("parsed")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in INDEX_KEYS]), keys))
    reason = (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("signals JSON missing keys: ['"), F.array_join(missing, "', '"), F.lit("']")))
        .when(~parsed["version"].eqNullSafe(F.lit(INDEX_VERSION)),
              F.concat(F.lit("unsupported signals schema version "), F.coalesce(F.get_json_object("raw", "$.version"), F.lit("None"))))
    )
    return docs.select("video_id", parsed.alias("doc"), reason.alias("reason"))


def parse_signal_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good documents as ``video_id, doc`` and rejected ones as ``video_id, reason``, from ``video_id, raw``; reading both reads ``docs`` twice."""
    judged = judge_signal_index(docs)
    return (
        judged.where(F.col("reason").isNull()).select("video_id", "doc"),
        judged.where(F.col("reason").isNotNull()).select("video_id", "reason"),
    )


def read_signal_index(spark: SparkSession, path: str, video_id: Column | None = None) -> tuple[Signals, DataFrame]:
    """Signals of every document under ``path`` and a quarantine table of the rejected ones."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1) if video_id is None else video_id
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(name.alias("video_id"), F.col("value").alias("raw"))
    good, bad = parse_signal_index(raw)
    return flatten_signals(good), bad


def flatten_signals(index: DataFrame) -> Signals:
    """One table per signal kind from ``video_id, doc``; list order becomes ``pos``."""
    def rows(field, *cols):
        return index.select("video_id", F.posexplode(f"doc.{field}").alias("pos", "x")).select("video_id", "pos", *[F.col(f"x.{c}").alias(c) for c in cols])

    kinds = {"speech": "speech", "silences": "silence", "fillers": "filler", "surges": "surge", "monotone": "monotone",
             "scenes": "scene", "defects_black": "black", "defects_frozen": "frozen"}

    def tag(kind):
        return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.t0.alias("t0"), x.t1.alias("t1"))

    tagged = F.array(*[F.transform(f"doc.{f}", tag(k)) for f, k in kinds.items()])
    spans = index.select("video_id", F.inline(F.flatten(tagged)))
    curves = index.select("video_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"doc.{n}.hop_s").alias("hop_s"), F.col(f"doc.{n}.values").alias("vs"))
        for n in ("energy", "rate", "pitch", "motion")])))
    curves = curves.select("video_id", "name", "hop_s", F.posexplode("vs").alias("i", "v"))
    curves = curves.select("video_id", "name", F.col("i").cast("bigint").alias("i"), (F.col("i") * F.col("hop_s")).alias("t"), "v")
    media = index.select("video_id", "doc.media.*", F.col("doc.language").alias("language"))
    return Signals(
        media=media, words=rows("words", "text", "t0", "t1", "conf", "align_err_ms"), spans=spans, peaks=rows("peaks", "t", "sigma"),
        events=rows("events", "label", "t0", "t1", "conf"), curves=curves,
        faces=rows("faces", "t", "boxes", "dominant").drop("pos"),
    )


def write_signals(sig: Signals, path: str) -> None:
    """Parquet sink of every table, spans and curves partitioned by kind."""
    parts = {"spans": ["kind"], "curves": ["name"]}
    for name in ("media", "words", "spans", "peaks", "events", "curves", "faces"):
        df = getattr(sig, name)
        if df is not None:
            df.write.mode("overwrite").partitionBy(*parts.get(name, [])).parquet(f"{path}/{name}")


def parse_agent_events(lines: DataFrame, mode: str = "tolerant") -> DataFrame:
    """Agent events from text lines ``job_id, value``; blank lines are skipped.

    ``tolerant`` drops lines that do not parse; ``strict`` keeps them with ``ok = false`` so that the
    caller can fail the job.
    """
    full = held(lines.where(F.trim("value") != ""), r=F.from_json("value", AGENT_EVENTS))
    ok = F.col("r.agent").isNotNull() & F.col("r.action").isNotNull()
    out = full.select(
        "job_id", "r.agent", "r.action", "r.payload", F.coalesce("r.tokens_in", F.lit(0)).cast("bigint").alias("tokens_in"),
        F.coalesce("r.tokens_out", F.lit(0)).cast("bigint").alias("tokens_out"), ok.alias("ok"))
    return out if mode == "strict" else out.where("ok").drop("ok")


def read_agent_events(spark: SparkSession, path: str, mode: str = "tolerant") -> DataFrame:
    """JSONL logs, one directory per job."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1).alias("job_id"), "value")
    return parse_agent_events(lines, mode)


# --- run results ------------------------------------------------------------------------------------


def judge_run_results(docs: DataFrame, schema: str = RUN_RESULT) -> DataFrame:
    """``job_id, run, error`` of every document ``job_id, raw`` in one pass; ``error`` is null for good runs.

    ``schema`` may leave out parts of clips that the caller does not read (``RUN_FACTS``); the verdict stays the same.
    A strict read that meets its schema is proof of JSON; only what fails it is parsed again, to tell other types from no JSON.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_odd"}
    with_odd = schema[:-1] + ",_odd:string>"
    docs = held(docs, run=F.from_json("raw", with_odd, strict))
    raw, run = F.col("raw"), F.col("run")
    readable = (run.isNotNull() & run["_odd"].isNull()) | F.try_parse_json("raw").isNotNull()
    version = F.get_json_object("raw", "$.version")
    right_version = (raw.rlike(r"^\s*\{") & F.coalesce(run["version"] == 1, F.lit(False))) | version.eqNullSafe(F.lit("1"))
    # a key "error" is written so, or with an escape
    has_error = (raw.contains('"error"') | raw.contains("\\u")) & F.array_contains(F.json_object_keys("raw"), "error")
    shape = (
        run["pipeline_version"].isNotNull() & run["source"].isNotNull() & run["agent_totals"].isNotNull() & run["timings_s"].isNotNull()
        & run["clips"].isNotNull() & F.forall(run["clips"], lambda c: c["index"].isNotNull() & c["cut"].isNotNull() & c["candidate"].isNotNull())
    )
    error = (
        F.when(~readable, "run.json is not valid JSON")
        .when(~right_version, F.concat(F.lit("run.json version mismatch: expected 1, got "), F.coalesce(version, F.lit("undefined"))))
        .when(has_error, F.coalesce(F.get_json_object("raw", "$.error.message"), F.lit("run.json error-shape failed validation")))
        .when(~F.coalesce(shape, F.lit(False)), "run.json failed schema validation")
    )
    return held(docs, error=F.substring(error, 1, 2000)).select("job_id", run.dropFields("_odd").alias("run"), "error")


def parse_run_results(docs: DataFrame, schema: str = RUN_RESULT) -> tuple[DataFrame, DataFrame]:
    """Good runs as ``job_id, run`` and failures as ``job_id, status, error``, from ``job_id, raw``; reading both reads ``docs`` twice."""
    return split_run_results(judge_run_results(docs, schema))


def split_run_results(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good runs and failures of judged documents."""
    return (
        judged.where(F.col("error").isNull()).select("job_id", "run"),
        judged.where(F.col("error").isNotNull()).select("job_id", F.lit("failed").alias("status"), "error"),
    )


def read_run_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1).alias("job_id"), F.col("value").alias("raw"))
    return parse_run_results(raw)


#: Columns of a clip's row that keep whole parts of its record.
WHOLE = ("evidence", "qa")


def rows_schema(columns) -> str:
    """What must be read of a run for these columns of its clips' rows."""
    return RUN_RESULT if set(columns) & set(WHOLE) else RUN_ROWS


def clip_rows(runs: DataFrame, columns=None) -> DataFrame:
    """One row per clip: times from the cut, null-safe score, hook and QA, evidence kept as JSON; all columns or the named ones."""
    c = runs.select("job_id", F.explode("run.clips").alias("c"))
    dropped = F.coalesce(F.col("c.dropped_reason"), F.lit("")) != ""
    cols = {
        "job_id": lambda: F.col("job_id"), "clip_index": lambda: F.col("c.index"), "t_start": lambda: F.col("c.cut.t0"), "t_end": lambda: F.col("c.cut.t1"),
        "score": lambda: F.col("c.score.total").cast("int"), "hook": lambda: F.col("c.hook.title"), "captions": lambda: F.col("c.hook.captions"),
        "evidence": lambda: F.to_json(F.struct(F.col("c.score").alias("score"), F.col("c.candidate").alias("candidate"), F.col("c.repairs").alias("repairs"))),
        "qa": lambda: F.to_json("c.qa"), "media_key": lambda: F.col("c.paths.mp4"), "thumb_key": lambda: F.col("c.paths.thumb"),
        "status": lambda: F.when(dropped, "dropped").otherwise("ready"), "dropped_reason": lambda: F.col("c.dropped_reason"),
    }
    return c.select(*[cols[n]().alias(n) for n in columns or cols])


def with_claims(candidate: Column, read=read_claims) -> Column:
    """A run's candidate with its claims read from JSON text, or by ``read``."""
    return F.when(candidate.isNotNull(), candidate.withField("evidence", read(candidate["evidence"])))


def scored_claims(score: Column, read=read_claims) -> Column:
    """A run's score with the claims of every component read from JSON text, or by ``read``."""
    parts = F.transform_values(score["components"], lambda k, p: F.struct(p.score.alias("score"), read(p.evidence).alias("evidence")))
    return F.when(score.isNotNull(), F.struct(score["total"].alias("total"), score["verdict"].alias("verdict"), parts.alias("components")))


def job_facts(runs: DataFrame) -> DataFrame:
    """Minutes processed and cost in whole cents per run."""
    cost = F.aggregate(F.map_values("run.agent_totals"), F.lit(0.0), lambda a, t: a + F.coalesce(t.cost_cents, F.lit(0.0)))
    return runs.select("job_id", (F.col("run.duration_processed_s") / 60).alias("duration_min"), half_up(cost).alias("cost_cents"))


def upsert_clips(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace existing ones of the same job and index; safe to replay."""
    return existing.join(incoming.select("job_id", "clip_index"), ["job_id", "clip_index"], "left_anti").unionByName(incoming)


def replace_events(existing: DataFrame, incoming: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """All events of the imported jobs give way to the new ones; repeats inside a job stay."""
    which = (incoming if jobs is None else jobs).select("job_id").distinct()
    return existing.join(which, "job_id", "left_anti").unionByName(incoming)


def swap_media_keys(clips: DataFrame, restyled: DataFrame) -> DataFrame:
    """New media keys for clips that exist; unknown indexes are ignored, nothing else changes."""
    new = restyled.select("job_id", "clip_index", F.col("media_key").alias("_m"), F.col("thumb_key").alias("_t"), F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = clips.join(new, ["job_id", "clip_index"], "left")
    swap = {"media_key": "_m", "thumb_key": "_t"}
    return out.select(*[F.when(hit, F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in clips.columns])


# --- logs ---------------------------------------------------------------------------------------------


def parse_defect_logs(logs: DataFrame) -> DataFrame:
    """Black and frozen spans from filter logs ``video_id, log``; a frozen start without an end is dropped."""
    num = r"([\d.]+)"
    black = rf"black_start:{num} black_end:{num}"
    f0, f1 = rf"lavfi\.freezedetect\.freeze_start:\s*{num}", rf"lavfi\.freezedetect\.freeze_end:\s*{num}"
    get = lambda p, g=1: F.regexp_extract_all("log", F.lit(p), F.lit(g))
    zipped = lambda k, a, b: F.transform(
        F.sequence(F.lit(1), F.least(F.size(a), F.size(b))),
        lambda i: F.struct(F.lit(k).alias("kind"), (i - 1).cast("int").alias("pos"), F.element_at(a, i.cast("int")).cast("double").alias("t0"),
                           F.element_at(b, i.cast("int")).cast("double").alias("t1")))
    none = F.array().cast("array<struct<kind:string,pos:int,t0:double,t1:double>>")
    some = lambda k, a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), zipped(k, a, b)).otherwise(none)
    found = logs.select("video_id", get(black).alias("b0"), get(black, 2).alias("b1"), get(f0).alias("f0"), get(f1).alias("f1"))
    return found.select("video_id", F.inline(F.concat(some("black", F.col("b0"), F.col("b1")), some("frozen", F.col("f0"), F.col("f1")))))


def parse_loudness_logs(logs: DataFrame) -> DataFrame:
    """Integrated loudness after the last summary; minus infinity when none is readable."""
    tail = F.substring_index("log", "Summary:", -1)
    value = F.regexp_extract(tail, r"I:\s*(-?[\d.]+) LUFS", 1).try_cast("double")
    return logs.select("video_id", F.coalesce(value, F.lit(float("-inf"))).alias("lufs"))


def loudness_trim_plan(lufs: DataFrame, target: float = -14.0, deadband: float = 0.5, most: float = 3.0) -> DataFrame:
    """Gain that brings an output to the target, where the miss is neither negligible nor suspicious."""
    gain = F.lit(target) - F.col("lufs")
    return lufs.withColumn("gain_db", gain).where((F.abs("gain_db") > deadband) & (F.abs("gain_db") <= most))


# Download failure texts, first match wins.
INGEST_ERRORS = [
    ("not available from your location", "GEO_BLOCKED", "This video isn't available in your region."),
    ("not available in your country", "GEO_BLOCKED", "This video isn't available in your region."),
    ("geo restrict", "GEO_BLOCKED", "This video isn't available in your region."),
    ("confirm your age", "AGE_GATED", "This video is age-restricted and requires sign-in to view."),
    ("age-restrict", "AGE_GATED", "This video is age-restricted and requires sign-in to view."),
    ("inappropriate for some users", "AGE_GATED", "This video is age-restricted and requires sign-in to view."),
    ("video unavailable", "UNAVAILABLE", "This video is unavailable (removed, private, or deleted)."),
    ("this video is private", "UNAVAILABLE", "This video is private."),
    ("has been removed", "UNAVAILABLE", "This video has been removed."),
    ("no longer available", "UNAVAILABLE", "This video is no longer available."),
    ("account associated with this video has been terminated", "UNAVAILABLE", "This video is unavailable (channel terminated)."),
    ("this video does not exist", "UNAVAILABLE", "This video does not exist."),
    ("urlopen error", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("failed to resolve", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("temporary failure in name resolution", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("getaddrinfo failed", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("name or service not known", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("nodename nor servname", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("connection refused", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("network is unreachable", "NETWORK", "Network error while reaching the video source. Try again later."),
    ("timed out", "NETWORK", "Network error while reaching the video source. Try again later."),
]


def classify_ingest_errors(failures: DataFrame, patterns=None, tail_lines: int = 10) -> DataFrame:
    """Code and message per failure ``source, stderr``: the first pattern found, else the end of the text.

    The patterns are a fixed short list, so they are part of the projection and no join is needed.
    """
    patterns = INGEST_ERRORS if patterns is None else patterns
    low = F.lower("stderr")
    hit = lambda i: reduce(lambda acc, p: acc.when(low.contains(p[0]), F.lit(p[i])), patterns[1:], F.when(low.contains(patterns[0][0]), F.lit(patterns[0][i])))
    lines = F.split(strip(F.col("stderr")), r"\r\n|\r|\n")
    n = F.size(lines)
    last = F.array_join(F.slice(lines, F.greatest(F.lit(1), n - tail_lines + 1), F.lit(tail_lines)), "\n")
    return failures.select(
        "source", F.coalesce(hit(1), F.lit("UNAVAILABLE")).alias("code"),
        F.coalesce(hit(2), F.concat(F.lit("Could not download this video: "), last)).alias("message"))


def enforce_caps(media: DataFrame, max_s: float = 3 * 3600, max_bytes: int = 2 * 1024**3) -> DataFrame:
    """Adds ``rejected``: TOO_LONG, then TOO_BIG, null when accepted; unknown values pass."""
    code = F.when(F.col("duration_s") > max_s, "TOO_LONG").when(F.col("size_bytes") > max_bytes, "TOO_BIG")
    return media.withColumn("rejected", code)


def pending_work(inputs: DataFrame, checkpoints: DataFrame, version: int = 1) -> DataFrame:
    """Inputs without a checkpoint of this version for the same source and content fingerprint."""
    done = checkpoints.where(F.col("version") == version).select("source", "fingerprint")
    return inputs.join(done, ["source", "fingerprint"], "left_anti")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``source, fingerprint`` of files as size and modification second, read from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stamp = F.concat_ws(":", F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string"))
    return files.select(F.col("path").alias("source"), stamp.alias("fingerprint"))


def export_manifest(clips: DataFrame, name: str, date: str) -> DataFrame:
    """Target file names of kept clips that have media."""
    title = F.coalesce("hook", F.concat(F.lit("Clip "), F.col("clip_index").cast("string")))
    slug = F.replace(strip(F.regexp_replace(title, r'[/\\:?*"<>|]', "")), F.lit(" "), F.lit("_"))
    num = F.col("clip_index").cast("string")
    base = F.concat(F.lit(f"{date}_{name}/"), F.lpad(num, F.greatest(F.lit(2), F.length(num)), F.lit("0")), F.lit("_"), slug)
    kept = clips.where((F.coalesce("dropped_reason", F.lit("")) == "") & F.col("media_key").isNotNull())
    return kept.select("job_id", "clip_index", F.concat(base, F.lit(".mp4")).alias("target"),
                       F.when(F.col("thumb_key").isNotNull(), F.concat(base, F.lit(".jpg"))).alias("thumb_target"))


# Accepted privacy settings.
PRIVACY = ("public", "unlisted", "private")


def publish_queue(clips: DataFrame, publish_meta: DataFrame, receipts: DataFrame, limit: int | None = None, privacy: str | None = None) -> DataFrame:
    """Kept clips with media and metadata and without a receipt, in clip order, at most ``limit``."""
    kept = clips.where((F.coalesce("dropped_reason", F.lit("")) == "") & F.col("media_key").isNotNull())
    meta = publish_meta.select("job_id", "clip_index", F.col("title").alias("publish_title"), F.col("privacy").alias("_p"))
    rows = kept.select("job_id", "clip_index", "media_key").join(meta, ["job_id", "clip_index"])
    rows = rows.join(receipts.select("job_id", "clip_index"), ["job_id", "clip_index"], "left_anti")
    wanted = F.lit(privacy) if privacy else F.coalesce(F.when(F.col("_p") != "", F.col("_p")), F.lit("unlisted"))
    rows = rows.select("job_id", "clip_index", "media_key", F.coalesce("publish_title", F.lit("clip")).alias("title"),
                       F.when(wanted.isin(*PRIVACY), wanted).otherwise("unlisted").alias("privacy"))
    return rows if limit is None else rows.orderBy("job_id", "clip_index").limit(limit)
