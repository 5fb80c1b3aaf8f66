"""Whole calls: layers and their registry, stored and live calls, any order, time to live, recordings."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbra import dims
from timbra.operators import call as C
from timbra.operators import layers as L

STORE = "spark.sql.streaming.stateStore.providerClass"


def voice(hz, seconds, seed=0):
    """Harmonics with vibrato, syllables and a little noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * 16000)) / 16000
    phase = 2 * np.pi * np.cumsum(hz * (1 + 0.02 * np.sin(2 * np.pi * 5 * t))) / 16000
    x = sum(np.sin(k * phase) / k for k in range(1, 12)) * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t)) * 0.25
    return (x + rng.normal(0, 0.002, len(t))) * (np.sin(2 * np.pi * 0.7 * t) > -0.8)


def pcm(x):
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


HOSTILE = {"transaction_amount": 5e6, "prior_fraud_reports": 3, "known_contact": False, "caller_id_verified": False, "local_hour": 3, "transcript": "urgent, share the code", "claimed_role": "CEO", "origin": "voip"}
CALLS = {
    "a": (voice(140, 5.3), {"profile": "privileged_access", "language": "en-IN", "identity": "ann", "context": HOSTILE}),
    "b": (np.concatenate([voice(110, 1.7), np.zeros(24000), voice(220, 2.4)]), {"profile": "no such", "identity": "bob"}),
    "c": (np.zeros(40000), {}),
    "d": (voice(180, 0.9), {"context": {"known_contact": True}}),
}


def events(rng=None):
    """(session, seq, ts in microseconds, content, control, facts) rows of CALLS, in order."""
    rng = rng or np.random.default_rng(1)
    out = []
    for name, (x, facts) in CALLS.items():
        raw, at, seq = pcm(x), 1_700_000_000_000_000, 1
        out.append((name, 0, at, None, "start", json.dumps(facts)))
        k = 0
        while k < len(raw):
            n = 2 * int(rng.integers(2000, 9000))
            out.append((name, seq, at + seq * 400_000, raw[k:k + n], None, None))
            k, seq = k + n, seq + 1
        out.append((name, seq, at + seq * 400_000, None, "stop", None))
    return out


DDL = "session_id string, seq long, at long, content binary, control string, facts string"


def frame_of(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("ts", F.timestamp_micros("at")).drop("at")


@pytest.fixture(scope="module")
def enrolments(spark):
    from timbra.kernels import dsp

    v = dsp.features(np.stack([voice(140, 1.0, seed=s) for s in range(3)]))[1]
    mean = v.mean(0) / np.linalg.norm(v.mean(0))
    return spark.createDataFrame([("ann", mean.tolist(), 3, 0.002), ("bob", (-mean).tolist(), 1, 0.0)], "identity string, centroid array<double>, samples long, spread double")


@pytest.fixture(scope="module")
def stored(spark, enrolments):
    return C.calls_judged(frame_of(spark, events()), enrolments=enrolments).toPandas()


def plain(pdf, kinds=("window", "alert", "closed")):
    def near(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return None if math.isnan(v) else round(float(v), 5)
        if isinstance(v, list):
            return [near(x) for x in v]
        return {k: near(x) for k, x in v.items()} if isinstance(v, dict) else v

    rows = [r for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records") if r["kind"] in kinds]
    return sorted((json.dumps({k: near(json.loads(v) if k == "payload" and v else v) for k, v in r.items()}, sort_keys=True) for r in rows))


def test_stored_calls(stored):
    by = {s: g for s, g in stored.groupby("session_id")}
    reports = {s: json.loads(g[g.kind == "closed"].payload.iloc[0]) for s, g in by.items()}
    assert set(reports) == set(CALLS) and (stored.kind == "closed").sum() == 4
    a = by["a"][by["a"].kind == "window"].sort_values("window_index")
    assert a.start_s.tolist() == [0.5 * k for k in range(len(a))] and len(a) == 9 + 1  # a short one at the end
    assert reports["c"]["verdict"] == "insufficient_audio" and reports["c"]["stats"]["windows_skipped"] == 5  # four and a tail
    assert reports["d"]["verdict"] == "insufficient_audio" and reports["d"]["stats"]["windows_analyzed"] == 1
    for s in "ab":
        w = by[s][by[s].kind == "window"]
        assert reports[s]["stats"]["windows_analyzed"] == len(w) and reports[s]["peak_score"] == round(w.score.max(), 1)
        assert sum(reports[s]["band_histogram"].values()) == len(w) and reports[s]["mean_score"] == round(w.score.mean(), 1)
        assert reports[s]["final_score"] == round(w.sort_values("window_index").score.iloc[-1], 1)
        assert reports[s]["duration_seconds"] == round(len(CALLS[s][0]) / 16000, 2)
    alerts = by["a"][by["a"].kind == "alert"]
    assert len(alerts) >= 1 and reports["a"]["stats"]["alerts_raised"] == len(alerts) and (alerts.window_index >= dims.WARMUP).all()
    assert {x["layer"] for x in json.loads(a.payload.iloc[-1])["layer_summary"] if x["status"] == "voted"} >= {"acoustic", "speaker", "context"}
    assert reports["a"]["call_context"] == HOSTILE and len(reports["a"]["chunk_hashes"]) <= 64


def test_stored_calls_agree_with_row_expressions(spark, stored, enrolments):
    """The same windows through the column expressions: features, drift, layers, fusion, smoothing."""
    from timbra.operators import assess as A
    from timbra.operators import scoring as S
    from timbra.operators import speaker as K
    from timbra.operators.features import extract

    own = stored[(stored.kind == "window")]
    rows = []
    for r in own.itertuples():
        x, facts = CALLS[r.session_id]
        first, last = round(r.start_s * 16000), round(r.end_s * 16000)
        held = np.frombuffer(pcm(x), "<i2")[first:last] / np.float32(32768)
        rows.append((r.session_id, int(r.window_index), held.astype(float).tolist(), facts.get("language"), facts.get("identity"), facts.get("profile"), r.end_s, r.speech_ratio, *[facts.get("context", {}).get(c) for c in C_FACTS]))
    ddl = "session_id string, window_index long, samples array<double>, language string, identity string, profile string, elapsed_seconds double, speech_ratio double, " + ", ".join(f"{c} {L.CONTEXT_KINDS[c]}" for c in C_FACTS)
    w = spark.createDataFrame(rows, ddl)
    keys = [c for c in w.columns if c not in ("samples", "language")]
    f = extract(w, keys, language="language").withColumnRenamed("embedding", "vector")
    f = K.drift(K.compare(f, enrolments), "session_id", "window_index")
    rules = dims.rules(spark)
    f = K.speaker_layer(f.withColumn("own", S.rule_layers(S.judged_rules(F.col("features"), rules), rules)).withColumn("c", S.context_score(S.context_signals(lambda n: F.col(n) if n in C_FACTS else F.lit(None).cast(L.CONTEXT_KINDS[n])))))
    one = lambda name, score, confidence: F.struct(F.lit(name).alias("layer"), score.alias("score"), confidence.alias("confidence"))
    cycles, speech = F.col("features")["cycle_count"], F.col("features")["speech_ratio"]
    of = lambda name: F.filter("own", lambda x: x["layer"] == name)[0]
    layers = F.array(one("acoustic", of("acoustic")["score"], S.acoustic_confidence(of("acoustic")["confidence"])), one("prosodic", of("prosodic")["score"], S.prosodic_confidence(of("prosodic")["confidence"], cycles, speech)), one("speaker", F.col("score"), F.col("confidence")), one("context", F.col("c.score"), F.col("c.confidence")))
    f = f.select(*keys, layers.alias("layers"))
    told = f.withColumn("own_score", S.score_100(S.fuse(F.col("layers"))["probability"]))
    smooth = S.smoothed(told, "session_id", "window_index", "own_score")
    out = A.assessed(told.join(smooth.select("session_id", "window_index", "smoothed"), ["session_id", "window_index"]), dims.profiles(spark), "smoothed")
    want = {(r.session_id, r.window_index): r for r in out.collect()}
    assert len(want) == len(own) > 15
    for r in own.itertuples():
        x, p = want[r.session_id, r.window_index], json.loads(r.payload)
        assert r.own == x.own_score and r.score == pytest.approx(x.smoothed) and r.band == x.band and p["action"] == x.action
        assert p["probability"] == pytest.approx(x.probability) and p["confidence"] == pytest.approx(x.confidence) and p["threshold_shift"] == pytest.approx(x.threshold_shift)
        assert p["caveats"] == list(x.caveats) and [f["code"] for f in p["counter_factors"]] == [f["code"] for f in x.counter_factors]
        assert [(s["layer"], s["status"], s["weight_share"]) for s in p["layer_summary"]] == [(s.layer, s.status, pytest.approx(s.weight_share, abs=1e-4)) for s in x.layer_summary]


C_FACTS = ["transaction_amount", "prior_fraud_reports", "known_contact", "caller_id_verified", "local_hour", "transcript", "claimed_role", "origin"]


def streamed(spark, tmp_path, parts, pause=None, **how):
    """Rows of ``live_calls`` over ``parts``, one micro-batch each."""
    from timbra.streaming import onecall as O

    spark.conf.set(STORE, O.STORE)
    source, query = str(tmp_path / "in"), None
    out = []
    try:
        for k, part in enumerate(parts):
            frame_of(spark, part).coalesce(1).write.mode("append").parquet(source)
            live = spark.readStream.schema(frame_of(spark, part).schema).option("maxFilesPerTrigger", 1).parquet(source)
            from timbra.streaming.calls import write_once

            query = write_once(O.live_calls(live, **how), str(tmp_path / "out"), str(tmp_path / "state"))
            assert query.awaitTermination(300)
            if pause and k + 1 < len(parts):
                time.sleep(pause)
        return spark.read.parquet(str(tmp_path / "out")).drop("batch").toPandas()
    finally:
        spark.conf.unset(STORE)


@pytest.mark.parametrize("seed", [1, 2])
def test_live_equals_stored_in_any_order(spark, tmp_path, stored, enrolments, seed):
    """Rows shuffled over all batches, with some sent twice: the same windows, alerts and reports,
    and every repeated row counted."""
    rng = np.random.default_rng(seed)
    rows = events()
    twice = [rows[k] for k in rng.choice([k for k, r in enumerate(rows) if r[4] is None], 4, replace=False)]
    mixed = [rows[k] for k in rng.permutation(len(rows))]
    mixed[len(mixed) // 2:len(mixed) // 2] = twice
    parts = [[mixed[k] for k in p] for p in np.array_split(np.arange(len(mixed)), 4)]
    got = streamed(spark, tmp_path, parts, enrolments=enrolments, delay=3600.0)
    late = sorted((r.session_id, r.seq) for r in got[got.kind == "late"].itertuples())
    assert late == sorted((r[0], r[1]) for r in twice)
    counted = {s: json.loads(p)["stats"]["late_rows"] for s, p in got[got.kind == "closed"][["session_id", "payload"]].itertuples(index=False)}
    assert sum(counted.values()) <= len(twice) and set(counted) == set(CALLS)
    same = lambda rows: sorted(json.dumps({**json.loads(r), "payload": drop_late(json.loads(r)["payload"])}, sort_keys=True) for r in rows)
    assert same(plain(got)) == same(plain(stored))


def drop_late(payload):
    if payload and "stats" in payload:
        payload["stats"].pop("late_rows")
    return payload


def test_live_rows_after_their_turn_are_counted(spark, tmp_path):
    """Beyond ``delay`` a gap is lost; what comes then is late, and late rows of an ended call
    open no new one. A start does."""
    rows = [r for r in events() if r[0] == "b"]
    gone = rows[3]
    parts = [rows[:3] + rows[4:7], rows[7:], [gone], [rows[0], rows[-1][:1] + (1,) + rows[-1][2:]]]
    got = streamed(spark, tmp_path, parts, delay=0.5)
    reports = [json.loads(p) for p in got[got.kind == "closed"].sort_values("at").payload]
    assert len(reports) == 2 and reports[0]["stats"]["lost_rows"] == 1 or reports[1]["stats"]["lost_rows"] == 1
    assert [(r.session_id, r.seq) for r in got[got.kind == "late"].itertuples()] == [("b", gone[1])]
    fresh = min(reports, key=lambda r: r["stats"]["bytes_ingested"])
    assert fresh["verdict"] == "insufficient_audio" and fresh["stats"]["bytes_ingested"] == 0


def test_live_raw_audio_is_gone_after_its_time(spark, tmp_path):
    rows = [r for r in events() if r[0] == "a"]
    got = streamed(spark, tmp_path / "short", [rows[:5], rows[5:]], pause=6, raw_ttl=4.0)
    whole = sum(len(r[3] or b"") for r in rows) / 32000
    late_part = sum(len(r[3] or b"") for r in rows[5:]) / 32000
    assert json.loads(got[got.kind == "closed"].payload.iloc[0])["retained_seconds"] == pytest.approx(late_part)
    kept = streamed(spark, tmp_path / "long", [rows[:5], rows[5:]], raw_ttl=600.0)
    assert json.loads(kept[kept.kind == "closed"].payload.iloc[0])["retained_seconds"] == pytest.approx(whole)
    assert "retained_seconds" not in json.loads(streamed(spark, tmp_path / "none", [rows])["payload"].iloc[-1])


def test_live_deleted_call_leaves_nothing(spark, tmp_path):
    rows = [r for r in events() if r[0] == "a"]
    erase = [("a", 99, rows[-1][2], None, "delete", None)]
    got = streamed(spark, tmp_path, [rows[:4], erase, rows[5:7], [rows[0], rows[1]]])
    assert set(got[got["at"] > rows[3][2]].kind) <= {"late"} and not (got.kind == "closed").any()
    assert sorted(got[got.kind == "late"].seq) == [rows[5][1], rows[6][1]]


def test_calls_beyond_the_limit_are_refused(spark, tmp_path):
    """The 501st open call is refused and reported; one that stops makes room; audio of a refused
    call is never judged."""
    at = 1_700_000_000_000_000
    starts = [(f"s{k:03d}", 0, at + k, None, "start", None) for k in range(501)]
    refused_audio = [("s500", 1, at + 600, CALLS["d"][0][:100].tobytes(), None, None)]
    stop = [("s007", 1, at + 700, None, "stop", None)]
    more = [("late", 0, at + 800, None, "start", None), ("again", 0, at + 801, None, "start", None), ("s001", 1, at + 802, None, None, None)]
    got = streamed(spark, tmp_path, [starts, refused_audio + stop, more], limit=500)
    assert sorted(got[got.kind == "refused"].session_id) == ["again", "s500"]
    assert got[got.kind == "closed"].session_id.tolist() == ["s007"]
    assert got[got.kind == "late"].session_id.tolist() == ["s500"] and not (got.kind == "window").any()


def test_a_gate_keeps_count_by_time(spark, tmp_path):
    at = 1_700_000_000_000_000
    rows = [("a", 0, at, None, "start", None), ("b", 0, at + 3, None, "start", None), ("a", 1, at + 2, None, "stop", None), ("c", 0, at + 4, None, "start", None), ("b", 1, at + 9, None, "delete", None), ("d", 0, at + 10, None, "start", None)]
    got = streamed(spark, tmp_path, [rows], limit=1)
    assert sorted(got[got.kind == "refused"].session_id) == ["c"] and got[got.kind == "closed"].session_id.tolist() == ["a"]


# Layers ------------------------------------------------------------------------------------


def window_table(spark, n=40):
    rng = np.random.default_rng(7)
    names = L.Registry().features
    rows = [(k, {f: float(v) for f, v in zip(names, rng.uniform(0, 1, len(names)), strict=True) if rng.random() > 0.2} | {"cycle_count": float(rng.integers(0, 90)), "speech_ratio": float(rng.random())}, "wire_transfer" if k % 3 else None) for k in range(n)]
    return spark.createDataFrame(rows, "id long, features map<string,double>, profile string")


def test_a_layer_that_fails_abstains_alone(spark):
    def odd(b):
        if (b.value("spec_flatness_mean") > 0.5).any():
            raise ValueError("too flat")
        return L.Verdicts(np.full(b.n, 0.9), np.full(b.n, 1.0), [[("odd", "Odd", 1.0, 1.0)]] * b.n, [None] * b.n)

    frame = window_table(spark).cache()
    flat = {r.id for r in frame.filter(F.col("features")["spec_flatness_mean"] > 0.5).collect()}
    failed = spark.sparkContext.accumulator(0)
    registry = L.Registry().register(L.Layer("odd", 0.3, odd, ("spec_flatness_mean",)))
    got = {r.id: r for r in L.verdicts(frame, ["id"], registry, failed=failed).collect()}
    plain_ = {r.id: r for r in L.verdicts(frame, ["id"]).collect()}
    assert 0 < len(flat) < 40 and failed.value == len(flat) and len(got) == 40
    for k, r in got.items():
        own = {s.layer: s for s in r.layer_summary}
        assert (own["odd"].status == "abstained" and own["odd"].note == "layer error: too flat") if k in flat else own["odd"].status == "voted"
        assert {n: (s.score, s.confidence) for n, s in own.items() if n != "odd"} == {s.layer: (s.score, s.confidence) for s in plain_[k].layer_summary}
        assert (r.score == plain_[k].score) == (k in flat) or own["odd"].status == "voted"
    frame.unpersist()


def test_a_registered_layer_votes_in_batch_and_stream(spark, tmp_path, stored):
    def steady(b):
        return L.Verdicts(np.full(b.n, 0.99), np.ones(b.n), [[("steady", "Always sure", 1.0, 0.5)] for _ in range(b.n)], [None] * b.n)

    registry = L.Registry().register(L.Layer("steady", 5.0, steady)).weights({"speaker": 0.0})
    assert registry.fusion()["steady"] == 5.0 and registry.fusion()["speaker"] == 0.0
    rows = [r for r in events() if r[0] == "a"]
    batch = C.calls_judged(frame_of(spark, rows), registry).toPandas()
    live = streamed(spark, tmp_path, [rows[:6], rows[6:]], registry=registry)
    assert plain(batch) == plain(live)
    own = json.loads(batch[batch.kind == "window"].payload.iloc[0])
    assert {s["layer"]: s["status"] for s in own["layer_summary"]}["steady"] == "voted" and own["factors"][0]["code"] == "steady"
    assert batch[batch.kind == "window"].own.min() > stored[(stored.kind == "window") & (stored.session_id == "a")].own.max()
    with pytest.raises(ValueError):
        L.Registry().weights({"acoustic": -1.0})


def test_verdicts_equal_row_expressions(spark):
    """Scores, factors, details, headline and caveats of the Arrow pass and of the expressions."""
    from timbra.operators import assess as A
    from timbra.operators import scoring as S

    frame = window_table(spark, 200)
    rules = dims.rules(spark)
    registry = L.Registry([x for x in L.standard() if x.name in ("acoustic", "prosodic")])
    got = {r.id: r for r in L.verdicts(frame, ["id"], registry, L.Policy(heuristic=True)).collect()}
    cap = lambda x: F.when(x["layer"] == "acoustic", S.acoustic_confidence(x["confidence"])).otherwise(S.prosodic_confidence(x["confidence"], F.col("features")["cycle_count"], F.col("features")["speech_ratio"]))
    layers = F.transform(S.rule_layers(S.judged_rules(F.col("features"), rules), rules), lambda x: F.struct(x["layer"].alias("layer"), x["score"].alias("score"), cap(x).alias("confidence"), x["factors"].alias("factors")))
    want = A.assessed(frame.withColumn("layers", layers).withColumn("heuristic", F.lit(True)), dims.profiles(spark)).collect()
    for x in want:
        r = got[x.id]
        assert (r.band, r.action, r.policy, r.headline, r.caveats) == (x.band, x.action, x.policy, x.headline, x.caveats) and r.score == pytest.approx(x.score)
        assert r.probability == pytest.approx(x.probability) and r.confidence == pytest.approx(x.confidence)
        assert [(f.code, f.label, f.detail) for f in r.factors] == [(f.code, f.label, f.detail) for f in x.factors]
        assert [f.contribution for f in r.factors] == pytest.approx([f.contribution for f in x.factors])


# Recordings --------------------------------------------------------------------------------


def test_a_recording_in_an_answer_out(spark):
    rows = [(n, pcm(x), json.dumps(facts)) for n, (x, facts) in CALLS.items()]
    frame = spark.createDataFrame(rows, "name string, raw binary, facts string")
    rows_ = C.recordings_judged(frame, "name", "raw", facts=F.col("facts"))
    got = {r.session_id: r for r in C.answers(rows_).collect()}
    assert set(got) == set(CALLS)
    assert got["c"].headline == "No speech detected in this recording." and got["c"].action == "Not enough speech to analyse." and got["c"].timeline == [] and len(got["c"].caveats) == 1
    a = got["a"]
    assert a.windows_analyzed == len(a.timeline) == 10 and a.score == a.timeline[-1].score and a.peak_score == max(t.score for t in a.timeline)
    assert [t.t for t in a.timeline][:3] == [1.0, 1.5, 2.0] and a.timeline[0].provisional and not a.timeline[3].provisional
    assert a.headline.startswith(f"Risk {a.score:.0f}/100") and a.factors and a.n_alerts >= 1
    short = {r.session_id: r for r in C.answers(rows_, trail=3).collect()}["a"]
    assert [t.t for t in short.timeline] == [t.t for t in a.timeline][-3:] and short.score == a.score


# What callers see ----------------------------------------------------------------------------


def test_flags_views_and_weights(spark, stored):
    from timbra.operators import reports as R

    rows = spark.createDataFrame(stored.astype(object).where(stored.notna(), None), C.OUT)
    flags = {r.session_id: r for r in R.result_flags(C.answers(rows)).collect()}
    assert flags["a"].is_high_risk and flags["a"].is_synthetic == (flags["a"].peak_score >= 60) and flags["a"].top_factor.code == flags["a"].factors[0].code
    assert flags["c"].inconclusive and not flags["c"].is_high_risk and flags["c"].top_factor is None and flags["c"].explained.splitlines()[0] == "No speech detected in this recording."
    text = flags["a"].explained.splitlines()
    assert text[0] == flags["a"].headline and text[1].startswith("  - ") and text[-1] == f"  -> {flags['a'].action}" and sum(x.startswith("  ! ") for x in text) == len(flags["a"].caveats)
    views = {r.session_id: r for r in R.session_views(rows.filter("not (session_id = 'a' and kind = 'closed')")).collect()}
    last = stored[(stored.session_id == "a") & (stored.kind == "window")].sort_values("window_index").iloc[-1]
    assert views["a"].open and views["a"].score == round(last.score, 1) and views["a"].band == last.band and views["a"].profile is None
    assert not views["b"].open and views["b"].profile == "no such" and views["b"].score == flags["b"].score and views["b"].windows_analyzed == flags["b"].windows_analyzed
    table = {r.layer: (r.weight, r.a, r.b) for r in R.fusion_table(spark, L.Registry().weights({"context": 0.2}), (0.5, -0.1)).collect()}
    assert table["context"] == (0.2, 0.5, -0.1) and list(table) == list(dims.LAYERS)
    decisions = spark.createDataFrame([("allow",), ("block",), ("step_up",), ("not_found",)], "decision string")
    assert [(r.allowed, r.blocked, r.needs_step_up) for r in R.approval_flags(decisions).collect()] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_views_round_ties_half_up(spark):
    """0.35 * 1.1 + 0.65 * 90.1 is a tie that its double lies just below."""
    from timbra.operators import reports as R

    tie = 0.35 * 1.1 + 0.65 * 90.1
    assert tie < 58.95
    rows = spark.createDataFrame([("a", "window", 0, tie, "HIGH", tie, 0, None), ("b", "window", 0, 58.94, "HIGH", 58.94, 0, None)], "session_id string, kind string, window_index long, score double, band string, peak double, at long, payload string")
    assert {r.session_id: (r.score, r.peak_score) for r in R.session_views(rows).collect()} == {"a": (59.0, 59.0), "b": (58.9, 58.9)}


def test_channels_fail_for_themselves(spark, stored):
    import http.server
    import threading

    from timbra.streaming.delivery import Channels, Webhook, delivered

    heard = []

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            heard.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if self.path == "/bad" else 204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def broken(payload):
        raise RuntimeError("no line")

    try:
        channels = Channels(webhook=Webhook(f"{url}/ok"), siem=Webhook(f"{url}/bad"), off=Webhook("")).register("sms", broken)
        own = stored[stored.kind == "alert"]
        alerts = spark.createDataFrame(own.astype(object).where(own.notna(), None), C.OUT).withColumn("wanted", F.array(*map(F.lit, ["webhook", "sms", "siem", "off", "nobody"])))
        got = {(r.session_id, r.channel): (r.delivered, r.status, r.reason) for r in delivered(alerts, channels, "wanted").collect()}
        one = alerts.first().session_id
        assert got[one, "webhook"] == (True, 204, None) and got[one, "sms"] == (False, None, "no line") and got[one, "siem"] == (False, 500, None) and got[one, "off"] == (False, None, "no webhook URL configured")
        assert len(heard) >= 2 and heard[0]["band"] in ("HIGH", "CRITICAL") and (one, "console") not in got
        assert {r.channel for r in delivered(alerts.withColumn("wanted", F.lit(None).cast("array<string>")), channels, "wanted").collect()} == {"console"}
    finally:
        server.shutdown()


def test_speakers_from_audio(spark):
    from timbra.operators import speaker as K

    none = spark.createDataFrame([], "identity string, vector array<double>")
    rows = spark.createDataFrame([("ann", voice(140, 1.5).tolist()), ("ann", voice(141, 1.5, 1).tolist()), ("bob", voice(230, 1.5).tolist()), ("mute", [0.0] * 100)], "identity string, samples array<double>")
    kept = K.enrol_audio(none, rows)
    assert {r.identity: r.samples for r in K.identities(kept).collect()} == {"ann": 2, "bob": 1}
    assert K.identities(K.forget(kept, "ann")).count() == 1 and K.forget(kept).count() == 0


def test_small_expressions(spark, tmp_path):
    """Exports that nothing else names."""
    from timbra.functions import exprs as X
    from timbra.functions import text as T
    from timbra.operators import privacy as P
    from timbra.operators import reports as R
    from timbra.operators import scoring as S
    from timbra.sources import corpus
    from timbra.streaming import calls

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    p, h = 0.8, 0.3
    z = lambda v: math.log(v / (1 - v))
    assert one(S.blended(F.lit(p), F.lit(h))) == pytest.approx(1 / (1 + math.exp(-(0.75 * z(p) + 0.25 * z(h)))))
    told = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "session_id long, window_index long").withColumn("score", F.col("window_index") * 10.0).withColumn("band", F.lit("LOW"))
    trail = {r.session_id: [t.window_index for t in r.trail] if r.trail else None for r in R.report_with_trail(spark.createDataFrame([(1,), (3,)], "session_id long"), told, limit=2).collect()}
    assert trail == {1: [1, 2], 3: None}
    factors = F.array(*[F.struct(F.lit(f"L{k}").alias("label"), (F.lit(f"d{k}") if k else F.lit(None).cast("string")).alias("detail")) for k in range(7)])
    body = one(T.email_body(F.lit("Head"), F.lit(64.5), F.lit("HIGH"), F.lit("Call back."), factors)).split("\n")
    assert body[0] == "Head" and "Risk score: 64/100 (HIGH)" in body and body[-5:] == ["  - L0: "] + [f"  - L{k}: d{k}" for k in range(1, 5)]
    assert one(T.alert_text(F.lit("HIGH"), F.lit("c"), F.lit(65.5), F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit("Act."))) == "[HIGH] Call c: risk 66/100. x; y. Act."
    assert one(T.extra_numbers(F.lit('{"a": 1.5, "b": "x", "known": 3, "c": -2}'), ["known"])) == {"a": 1.5, "c": -2.0}
    assert [one(T.consented(F.lit(v))) for v in ("Recorded", "no", "none-required")] == [True, False, True]
    assert one(R.channels_for(F.array(F.lit("sms"), F.lit("fax")), ["sms"])) == ["sms"] and one(R.channels_for(F.array(F.lit("fax")), ["sms"])) == ["console"] == one(R.channels_for(F.lit(None).cast("array<string>"), ["sms"]))
    out = calls.deliveries(spark.createDataFrame([(1, ["console", "sms"])], "id int, alert_channels array<string>")).collect()
    assert {(r.channel, r.delivered) for r in out} == {("console", True), ("sms", False)}
    stored_ = P.stored_sessions(spark.createDataFrame([({"caller_number": "98765", "origin": "voip"},)], "call_context map<string,string>"), "salt").first().call_context
    assert json.loads(stored_)["origin"] == "voip" and json.loads(stored_)["caller_number"].startswith("h:")
    files = spark.createDataFrame([("a", "real", 1), ("b", "fake", 2)], "path string, label string, mtime long")
    key = corpus.cache_key(files, "v1").first().key
    assert key == corpus.cache_key(files.orderBy("path", ascending=False), "v1").first().key and key != corpus.cache_key(files.withColumn("mtime", F.col("mtime") + 1), "v1").first().key and key != corpus.cache_key(files, "v2").first().key
    frames = lambda *xs: F.array(*[F.array(*map(F.lit, x)) for x in xs])
    assert one(X.float_mono(frames((0.5, 1.5), (3.0, 1.0), (0.0, -1.0)))) == [0.5, 1.0, -0.25] and one(X.float_mono(frames((100, 300), (0, -400)), 1000.0)) == [0.2, -0.2]
    spark.createDataFrame([(1, 0, 100.0), (1, 0, 100.0), (1, 1, 101.0)], "session_id long, window_index long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "w"))
    live = spark.readStream.schema("session_id long, window_index long, ts timestamp").parquet(str(tmp_path / "w"))
    calls.write_once(calls.late_dropped(live), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
