"""A call as a fold: its rows in order of ``seq`` in, judged windows, alerts and one report out.

``Call`` is all that a call carries from one row to the next, and its size does not grow with the
call. ``calls_judged`` folds stored calls in Spark; ``streaming.onecall`` folds live ones with the
same steps, so both give the same rows.

Rows of a call: session_id, seq (0, 1, ...), at (microseconds), content (PCM16 or null), control
(null, "start", "stop" or "delete"), facts (of a start: JSON with profile, language, identity and
context) and, where the identity is enrolled, centroid, samples and spread.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..streaming.live import HASHES, Chunker
from .layers import Batch, Policy, Registry, fuse, judged, score_100
from .scoring import smooth_step

ROWS = "session_id string, seq long, at long, content binary, control string, facts string, centroid array<double>, samples long, spread double"
OUT = (
    "session_id string, kind string, window_index long, start_s double, end_s double, own double, score double, band string, provisional boolean, "
    "peak double, confidence double, speech_ratio double, at long, seq long, payload string"
)
#: The smoother's constants; codes whose factors a report keeps.
SMOOTHING = (0.35, 8, 0.8)
CODES = 64


@dataclass
class Call:
    """What a call carries on, but for its samples and vectors."""

    profile: str = "default"
    language: str = "auto"
    identity: str | None = None
    context: dict | None = None
    enrolled: list | None = None  # centroid, samples, spread
    created_at: int | None = None
    next: int = 0
    newest: int = 0
    late: int = 0
    lost: int = 0
    consumed: int = 0
    index: int = 0
    total: int = 0
    bytes: int = 0
    hashes: list = field(default_factory=list)
    value: float | None = None
    history: list = field(default_factory=list)
    analyzed: int = 0
    skipped: int = 0
    audio_seconds: float = 0.0
    speech_seconds: float = 0.0
    peak: float = 0.0
    score_sum: float = 0.0
    band: str = "LOW"
    bands: dict = field(default_factory=dict)
    factors: dict = field(default_factory=dict)  # code: [label, count, sum of contributions]
    alerts: int = 0
    failures: int = 0

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Call:
        return cls(**json.loads(text))


@dataclass
class Alerted:
    """The highest band that has alerted and when the last alert was."""

    top: int = -1
    last: int | None = None


def verdict(call: Call) -> str:
    if not call.analyzed or call.audio_seconds < 2:
        return "insufficient_audio"
    names = ("likely_genuine", "inconclusive", "suspicious", "likely_synthetic")
    return names[sum(call.peak >= t for t in (35, 60, 80))]


def report(session: str, call: Call, closed_at: int | None, registry: Registry, policy: Policy, retained: float | None = None) -> dict:
    """The report of a call: figures, verdict, bands, the most frequent reasons."""
    top = sorted(((code, label, n, round(s / max(n, 1), 4)) for code, (label, n, s) in call.factors.items()), key=lambda r: (-r[2], -r[3], r[0]))[:8]
    out = {
        "session_id": session, "profile": call.profile, "language": call.language, "identity": call.identity, "created_at": call.created_at, "closed_at": closed_at,
        "duration_seconds": round(call.audio_seconds, 2), "verdict": verdict(call), "final_score": round(call.value or 0.0, 1), "peak_score": round(call.peak, 1),
        "mean_score": round(call.score_sum / call.analyzed, 1) if call.analyzed else 0.0, "band": call.band, "band_histogram": call.bands,
        "stats": {"windows_analyzed": call.analyzed, "windows_skipped": call.skipped, "bytes_ingested": call.bytes, "audio_seconds": round(call.audio_seconds, 2), "speech_seconds": round(call.speech_seconds, 2), "alerts_raised": call.alerts, "late_rows": call.late, "lost_rows": call.lost, "layer_failures": call.failures},
        "top_factors": [dict(zip(("code", "label", "count", "mean_contribution"), r, strict=True)) for r in top], "call_context": call.context, "chunk_hashes": call.hashes,
        "model": {"degraded": policy.heuristic, "layers": list(registry.layers)},
    }
    return out if retained is None else out | {"retained_seconds": retained}


class Judge:
    """The steps of the fold. ``registry`` and ``policy`` are the same for all calls; with
    ``features`` a window's payload holds its features and the digest of its samples as well."""

    def __init__(self, registry: Registry | None = None, policy: Policy | None = None, features: bool = False):
        self.registry, self.policy, self.features = registry or Registry(), policy or Policy(), features
        self.weights = self.registry.fusion()
        self.priors = {r[0]: r[1:5] for r in dims.LANGUAGES}

    def start(self, call: Call, facts: str | None, enrolled: list | None) -> None:
        told = json.loads(facts) if facts else {}
        call.profile, call.language = told.get("profile") or call.profile, told.get("language") or call.language
        call.identity, call.context = told.get("identity", call.identity), told.get("context", call.context)
        call.enrolled = enrolled or call.enrolled

    def audio(self, session: str, call: Call, held: np.ndarray, vectors: list, alerted: Alerted, content: bytes, at: int, end: bool = False) -> tuple[list[tuple], np.ndarray]:
        """``heard`` of a chunk of PCM16."""
        if content:
            call.bytes += len(content)
            if len(call.hashes) < HASHES:
                call.hashes.append(hashlib.sha256(content).hexdigest())
        return self.heard(session, call, held, vectors, alerted, np.frombuffer(content[:len(content) // 2 * 2], "<i2") / np.float32(32768), at, end)

    def heard(self, session: str, call: Call, held: np.ndarray, vectors: list, alerted: Alerted, samples: np.ndarray, at: int, end: bool = False) -> tuple[list[tuple], np.ndarray]:
        """(rows, samples that fill no window yet) after these samples and, at the ``end``, the
        last short window."""
        c = Chunker(held, call.consumed, call.index, call.total)
        found = list(c.push(samples)) if len(samples) else []
        if end:
            found += c.flush()
        call.consumed, call.index, call.total = c.consumed, c.index, c.total
        return [r for w in found for r in self.window(session, call, vectors, alerted, *w, at)], c.held.astype(np.float32)

    def window(self, session: str, call: Call, vectors: list, alerted: Alerted, index: int, first: int, x: np.ndarray, at: int) -> Iterator[tuple]:
        """A judged window and, if it alerts, the alert. Silence holds the score."""
        from ..kernels import dsp

        call.audio_seconds = call.total / dims.SAMPLE_RATE
        if len(x) < dims.SAMPLE_RATE // 4:
            call.skipped += 1
            return
        values, embedding = dsp.features(np.asarray(x, np.float64)[None], *self.priors.get(call.language, self.priors["auto"]))
        speech = values[0]["speech_ratio"]
        if not speech > 0:
            call.skipped += 1
            return
        call.analyzed += 1
        call.speech_seconds += speech * len(x) / dims.SAMPLE_RATE
        batch = Batch(1, {k: np.array([v]) for k, v in values[0].items()}, [embedding[0]], [list(vectors)], [tuple(call.enrolled) if call.enrolled else None], [call.context])
        votes = self.registry.vote(batch)
        call.failures += sum(str(v.notes[0]).startswith("layer error") for v in votes.values())
        fused = fuse(votes, self.weights, self.policy.calibration)
        own = score_100(fused.probability[0])
        call.value, call.history = smooth_step((call.value, call.history) if call.analyzed > 1 else None, own, *SMOOTHING)
        start, end = first / dims.SAMPLE_RATE, (first + len(x)) / dims.SAMPLE_RATE
        told = judged(votes, fused, 0, self.policy, call.profile, call.context, end, speech, call.value)
        call.peak, call.band = max(call.peak, call.value), told["band"]
        call.score_sum += call.value
        call.bands[told["band"]] = call.bands.get(told["band"], 0) + 1
        for f in told["factors"]:
            if f["code"] in call.factors or len(call.factors) < CODES:
                label, n, s = call.factors.get(f["code"], (f["label"], 0, 0.0))
                call.factors[f["code"]] = [label, n + 1, s + f["contribution"]]
        provisional = call.analyzed <= dims.WARMUP
        if embedding[0].any():
            vectors.append(embedding[0].tolist())
            del vectors[:-dims.HISTORY]
        row = (session, "window", index, start, end, own, call.value, told["band"], provisional, call.peak, told["confidence"], speech, at, None)
        more = {"features": {k: round(v, 6) for k, v in values[0].items()}, "audio_sha256": hashlib.sha256(np.asarray(x, "<f4").tobytes()).hexdigest()} if self.features else {}
        yield (*row, json.dumps(told | more))
        rank = dims.BANDS.index(told["band"])
        if not provisional and rank >= 2 and rank > alerted.top and (alerted.last is None or at - alerted.last >= dims.COOLDOWN_SECONDS * 1_000_000):
            alerted.top, alerted.last, call.alerts = rank, at, call.alerts + 1
            payload = {k: told[k] for k in ("score", "band", "action", "headline", "factors")} | {"session_id": session, "profile": told["policy"], "created_at": at}
            yield (session, "alert", *row[2:], json.dumps(payload))

    def closed(self, session: str, call: Call, at: int | None, retained: float | None = None) -> tuple:
        told = report(session, call, at, self.registry, self.policy, retained)
        return (session, "closed", call.index, 0.0, call.audio_seconds, None, call.value, call.band, call.analyzed <= dims.WARMUP, call.peak, None, None, at, None, json.dumps(told))

    def late(self, session: str, call: Call, seq: int, at: int) -> tuple:
        call.late += 1
        return (session, "late", None, None, None, None, None, None, None, None, None, None, at, seq, None)


NAMES = [x.split()[0] for x in OUT.split(", ")]


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of OUT; whole numbers that may be missing stay whole."""
    whole = {"window_index": "Int64", "at": "Int64", "seq": "Int64"}
    return pd.DataFrame(rows, columns=NAMES).astype({**whole, "provisional": "boolean"})


def enrolment(row) -> list | None:
    """(centroid, samples, spread) of a row, if its identity is enrolled."""
    c = row.centroid
    return None if c is None or not len(c) else [[float(v) for v in c], int(row.samples), 0.0 if row.spread is None or math.isnan(row.spread) else float(row.spread)]


def with_enrolments(events: DataFrame, enrolments: DataFrame | None = None) -> DataFrame:
    """``events`` as ROWS; starts carry their identity's enrolment (identity, centroid, samples,
    spread). Works on a stream: the enrolments are then a static side."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    has = lambda c, kind: F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), micros.alias("at"), has("content", "binary").alias("content"), has("control", "string").alias("control"), has("facts", "string").alias("facts"))
    if enrolments is None:
        return rows.select("*", F.lit(None).cast("array<double>").alias("centroid"), F.lit(None).cast("long").alias("samples"), F.lit(None).cast("double").alias("spread"))
    known = enrolments.select(F.col("identity").cast("string").alias("__identity"), F.col("centroid").cast("array<double>"), F.col("samples").cast("long"), F.col("spread").cast("double"))
    claimed = F.when(F.col("control") == "start", F.get_json_object("facts", "$.identity"))
    return rows.withColumn("__claimed", claimed).join(known, F.col("__claimed") == F.col("__identity"), "left").select(*[x.split()[0] for x in ROWS.split(", ")])


def calls_judged(events: DataFrame, registry: Registry | None = None, policy: Policy | None = None, enrolments: DataFrame | None = None) -> DataFrame:
    """Stored calls (session_id, seq, ts, content, control, facts) to OUT: a row for each judged
    window and alert, for each repeated ``seq`` (``late``), and one report a call (``closed``).

    Calls are dealt by session and their rows stream by in order: a task holds one call's state
    and one Arrow batch, however long the call is. A call ends at its stop or its last row;
    a deleted one leaves nothing from its delete on. Rows without a session or seq are left out.
    """
    judge = Judge(registry, policy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, call, held, vectors, alerted, over, at = None, None, None, None, None, False, None

        def finish() -> list[tuple]:
            if now is None or over:
                return []
            rows, _ = judge.audio(now, call, held, vectors, alerted, b"", at, end=True)
            return [*rows, judge.closed(now, call, at)]

        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if r.session_id != now:
                    out += finish()
                    now, call, held, vectors, alerted, over = r.session_id, Call(created_at=int(r.at)), np.zeros(0, np.float32), [], Alerted(), False
                    call.next = -1
                at = int(r.at)
                if over or r.seq <= call.next:
                    out.append(judge.late(now, call, int(r.seq), at))
                    continue
                call.lost += int(r.seq) - call.next - 1
                call.next = int(r.seq)
                if r.control == "start":
                    judge.start(call, r.facts, enrolment(r))
                if r.control == "delete":
                    over = True
                    continue
                rows, held = judge.audio(now, call, held, vectors, alerted, r.content or b"", at, end=r.control == "stop")
                out += rows
                if r.control == "stop":
                    out.append(judge.closed(now, call, at))
                    over = True
            yield frame(out)
        yield frame(finish())

    rows = with_enrolments(events, enrolments).filter("session_id is not null and seq is not null")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, OUT)


# A recording, its answer -------------------------------------------------------------------

ANSWER = (
    "session_id string, verdict string, score double, peak_score double, band string, action string, headline string, duration_seconds double, windows_analyzed long, "
    "factors array<struct<code:string,label:string,contribution:double,value:double,detail:string>>, caveats array<string>, layers array<struct<layer:string,score:double,confidence:double,weight_share:double,status:string,note:string>>, "
    "timeline array<struct<t:double,score:double,band:string,confidence:double,provisional:boolean>>, n_alerts long"
)
TOLD = "struct<action:string,headline:string,factors:array<struct<code:string,label:string,contribution:double,value:double,detail:string>>,caveats:array<string>,layer_summary:array<struct<layer:string,score:double,confidence:double,weight_share:double,status:string,note:string>>>"
#: Windows of a timeline.
TRAIL = 600


def answers(rows: DataFrame, trail: int = TRAIL) -> DataFrame:
    """One answer a call from the rows of ``calls_judged``: verdict, last reasons and the timeline
    of its last ``trail`` windows. A call without speech says so. Counts, the last window and
    the report are summed up before the shuffle; only the timeline's windows travel, without
    their payloads."""
    from pyspark.sql import Window

    is_window = F.col("kind") == "window"
    told = F.from_json(F.max_by(F.when(is_window, F.col("payload")), F.when(is_window, F.col("window_index"))), TOLD)
    closed = F.from_json(F.max(F.when(F.col("kind") == "closed", F.col("payload"))), "struct<verdict:string,final_score:double,peak_score:double,band:string,duration_seconds:double,stats:struct<windows_analyzed:long>>")
    one = rows.groupBy("session_id").agg(told.alias("t"), closed.alias("r"), F.count_if(F.col("kind") == "alert").alias("n_alerts")).filter("r is not null")
    last = rows.filter(is_window).select("session_id", "window_index", "end_s", "score", "band", "confidence", "provisional").withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("window_index").desc()))).filter(F.col("k") <= trail)
    point = F.struct("window_index", F.struct(F.round("end_s", 2).alias("t"), F.round("score", 1).alias("score"), "band", F.round("confidence", 3).alias("confidence"), "provisional").alias("p"))
    line = last.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]).alias("timeline"))
    none = lambda c, text: F.coalesce(F.col(c), F.lit(text))
    empty = lambda c: F.coalesce(F.col(f"t.{c}"), F.array().cast(one.schema["t"].dataType[c].dataType))
    speechless = F.array(F.lit("The recording contained no detectable speech."))
    return one.join(line, "session_id", "left").select(
        "session_id", "r.verdict", F.col("r.final_score").alias("score"), "r.peak_score", "r.band", none("t.action", "Not enough speech to analyse.").alias("action"), none("t.headline", "No speech detected in this recording.").alias("headline"),
        "r.duration_seconds", F.col("r.stats.windows_analyzed").alias("windows_analyzed"), empty("factors").alias("factors"), F.coalesce(F.col("t.caveats"), speechless).alias("caveats"), empty("layer_summary").alias("layers"),
        F.coalesce("timeline", F.array().cast("array<struct<t:double,score:double,band:string,confidence:double,provisional:boolean>>")).alias("timeline"), "n_alerts",
    )


def recordings_judged(recordings: DataFrame, session: str, content: str, registry: Registry | None = None, policy: Policy | None = None, facts: Column | None = None) -> DataFrame:
    """Whole PCM16 recordings, one a row, to OUT rows: each is replayed as half-second chunks of
    a call, so that its windows are those of a live one."""
    from ..streaming.live import chunked

    told = facts if facts is not None else F.lit(None).cast("string")
    rows = chunked(recordings.select(F.col(session).alias("__s"), F.col(content).alias("__c")), "__s", "__c").withColumn("seq", F.col("seq") + 1)
    starts = recordings.select(F.col(session).cast("string").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("content"), F.lit("start").alias("control"), told.alias("facts"))
    events = starts.unionByName(rows, allowMissingColumns=True)
    return calls_judged(events.withColumn("ts", F.timestamp_micros((F.col("seq") * 500_000).cast("long"))), registry, policy)
