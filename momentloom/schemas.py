"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

CLAIM = "struct<kind:string,t:double,value_num:double,value_str:string>"
CLAIMS = f"array<{CLAIM}>"
COMPONENTS = f"map<string,struct<score:int,evidence:{CLAIMS}>>"

MEDIA = "video_id string, duration_s double, fps double, width int, height int, language string"
WORDS = "video_id string, pos int, text string, t0 double, t1 double, conf double, align_err_ms double"
SPANS = "video_id string, kind string, pos int, t0 double, t1 double"
PEAKS = "video_id string, pos int, t double, sigma double"
CURVES = "video_id string, name string, i bigint, t double, v double"
EVENTS = "video_id string, pos int, label string, t0 double, t1 double, conf double"
BOX = "struct<x:double,y:double,w:double,h:double,conf:double>"
FACES = f"video_id string, t double, boxes array<{BOX}>, dominant int"
CANDIDATES = f"video_id string, cand_id string, pos int, t0 double, t1 double, source string, notes string, evidence {CLAIMS}"
CUTS = "video_id string, cand_id string, t0 double, t1 double, payoff_word_i int"
RENDER_MEDIA = "video_id string, cand_id string, width int, height int, duration_s double, lufs double"
AGENT_EVENTS = "agent string, action string, payload string, tokens_in bigint, tokens_out bigint"
USERS = "id string, email string, plan string, minutes_balance int, created_at timestamp"
JOBS = (
    "id string, user_id string, source_type string, source_url string, status string, stage string, progress double, "
    "error string, duration_min double, cost_cents int, created_at timestamp, updated_at timestamp"
)
CLIPS = (
    "job_id string, clip_index int, t_start double, t_end double, score int, hook string, captions map<string,string>, "
    "evidence string, qa string, media_key string, thumb_key string, status string, dropped_reason string"
)
LEDGER = "id string, user_id string, delta_minutes double, reason string, ref string, created_at timestamp"
PAYMENTS = "user_id string, event_id string, amount_cents int, currency string, created_at timestamp"

# One clip record of a run result.  A claim value is text or number, so each claim stays JSON text.
RUN_CLIP = (
    "struct<index:int,candidate:struct<t0:double,t1:double,source:string,notes:string,evidence:array<string>>,"
    "cut:struct<t0:double,t1:double,payoff_word_i:int>,"
    "score:struct<total:double,verdict:string,components:map<string,struct<score:double,evidence:array<string>>>>,"
    "hook:struct<title:string,captions:map<string,string>>,"
    "qa:struct<passed:boolean,failures:array<struct<code:string,detail:string>>>,"
    "repairs:array<string>,dropped_reason:string,paths:struct<mp4:string,thumb:string>>"
)


def run_result(clip: str) -> str:
    """Schema of a run result with clips of the given schema."""
    return (
        "struct<version:int,pipeline_version:string,"
        "source:struct<input:string,duration_s:double,fps:double,width:double,height:double>,"
        "duration_processed_s:double,"
        "agent_totals:map<string,struct<tokens_in:double,tokens_out:double,cost_cents:double>>,"
        f"timings_s:map<string,double>,clips:array<{clip}>,error:struct<code:string,message:string>>"
    )


RUN_RESULT = run_result(RUN_CLIP)
# What tells a good run from a bad one, and its facts; of a clip only that its parts are there.
RUN_FACTS = run_result("struct<index:int,candidate:struct<source:string>,cut:struct<t0:double>>")
# What a row of a clip shows without its evidence and QA record.
RUN_ROWS = run_result(
    "struct<index:int,candidate:struct<source:string>,cut:struct<t0:double,t1:double>,score:struct<total:double>,"
    "hook:struct<title:string,captions:map<string,string>>,dropped_reason:string,paths:struct<mp4:string,thumb:string>>"
)
# What the readable report shows of a clip; claims and repairs are read where they lie.
RUN_REPORT = run_result(
    "struct<index:int,candidate:struct<source:string,evidence:array<variant>>,cut:struct<t0:double>,"
    "score:struct<total:double,verdict:string,components:map<string,struct<score:double,evidence:array<variant>>>>,"
    "qa:struct<failures:array<struct<code:string>>>,repairs:array<variant>>"
)


@dataclass(frozen=True)
class Signals:
    """Measured tables of a corpus, one row set per kind, all keyed by ``video_id``."""

    media: DataFrame
    words: DataFrame | None = None
    spans: DataFrame | None = None
    peaks: DataFrame | None = None
    events: DataFrame | None = None
    curves: DataFrame | None = None
    faces: DataFrame | None = None

    def kind(self, kind: str) -> DataFrame:
        return self.spans.where(self.spans.kind == kind).select("video_id", "pos", "t0", "t1")

    def curve(self, name: str) -> DataFrame:
        return self.curves.where(self.curves.name == name).select("video_id", "i", "t", "v")
