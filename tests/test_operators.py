"""Operators on literal rows and closed-form signals."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbra import dims
from timbra.functions import exprs as X
from timbra.functions import text as T
from timbra.operators import metrics as M
from timbra.operators import reports as R
from timbra.operators import scoring as S
from timbra.operators import speaker as V
from timbra.operators import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ramp_and_logit(spark):
    up = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (99.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in up.select(X.ramp(F.col("v"), 0, 10)).collect()] == [0, 0.5, 1, 1, 0, 0, 0]
    assert [r[0] for r in up.limit(3).select(X.ramp(F.col("v"), 10, 0)).collect()] == [1, 0.5, 0]
    assert one(spark, X.ramp(F.lit(3.0), 3, 3)) == 1.0
    assert one(spark, X.sigmoid(X.logit(F.lit(0.3)))) == pytest.approx(0.3)
    assert one(spark, X.sigmoid(F.lit(-1e9))) > 0


def layers(spark, *rows):
    kind = "array<struct<layer:string,score:double,confidence:double>>"
    return spark.createDataFrame([([tuple(r) for r in rows],)], f"layers {kind}").select(S.fuse(F.col("layers")).alias("f")).first()["f"]


def test_fusion(spark):
    alone = layers(spark, ("acoustic", 0.9, 1.0))
    with_silent = layers(spark, ("acoustic", 0.9, 1.0), ("speaker", 0.5, 0.0))
    assert alone["probability"] == with_silent["probability"] == pytest.approx(0.9)
    assert with_silent["excluded"] == ["speaker"] and with_silent["confidence"] < alone["confidence"]
    none = layers(spark, ("acoustic", 0.9, 0.0))
    assert (none["probability"], none["confidence"]) == (0.5, 0.0)
    assert sum(s["share"] for s in layers(spark, ("acoustic", 0.9, 0.5), ("prosodic", 0.2, 0.7))["shares"]) == pytest.approx(1)


def smoothed(spark, scores):
    rows = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "session_id long, window_index long, score double")
    return [r["smoothed"] for r in S.smoothed(rows, "session_id", "window_index", "score").orderBy("window_index").collect()]


def step(value, history, score, alpha=0.35, memory=8, quantile=0.8):
    """One more score of a call, as it is told: faded, lifted halfway to what the last ones hold."""
    history = [*history, score][-memory:]
    value = score if value is None else alpha * score + (1 - alpha) * value
    held = sorted(history)[int(quantile * (len(history) - 1))]
    return (value + 0.5 * (held - value) if len(history) >= 3 and held > value else value), history


def test_smoother(spark):
    spike, drop = smoothed(spark, [10] * 5 + [95])[-1], smoothed(spark, [85] * 5 + [20])[-1]
    assert 10 < spike < 60 and drop > 45
    rng = np.random.default_rng(0)
    scores = rng.uniform(0, 100, 40).round(1).tolist()
    value, history, want = None, [], []
    for s in scores:
        value, history = step(value, history, s)
        want.append(value)
    assert smoothed(spark, scores) == want


def test_context_and_shift(spark):
    shift = lambda *a: one(spark, X.threshold_shift(*[F.lit(x).cast(t) for x, t in zip(a, ("double", "int", "boolean", "boolean", "int"), strict=True)]))
    assert shift(None, None, None, None, None) == 0 and shift(1e9, 9, False, False, 3) == dims.MAX_SHIFT
    assert shift(0.0, 0, True, True, 12) == -5.0
    fields = {f: F.lit(None) for f in ("caller_id_verified", "known_contact", "first_contact")} | {f: F.lit(None).cast("string") for f in ("origin", "claimed_role", "claimed_identity", "transcript")} | {f: F.lit(None).cast("double") for f in ("prior_fraud_reports", "transaction_amount", "local_hour", "account_age_days")}
    empty = one(spark, S.context_score(S.context_signals(lambda n: fields[n].cast("boolean") if n in ("caller_id_verified", "known_contact", "first_contact") else fields[n])))
    assert (empty["score"], empty["confidence"]) == (0.5, 0.0)


def test_rules_skip_what_cannot_be_judged(spark):
    rules = dims.rules(spark)
    rows = spark.createDataFrame([(1, {"residual_kurtosis": 2.0, "residual_peakiness": 0.0, "comb_strength": 0.9}), (2, {"residual_kurtosis": 2.0, "residual_peakiness": 4.0})], "w long, features map<string,double>")
    got = {(r.w, r.feature): r.strength for r in S.rule_evidence(rows, rules, ["w"]).collect()}
    assert got == {(1, "comb_strength"): 1.0, (2, "residual_kurtosis"): 1.0}


def test_rule_evidence_is_compiled(spark):
    """The rows of ``judged_rules``, without an array function that Spark interprets."""
    rules = dims.rules(spark)
    names = [r.feature for r in rules.collect()]
    rows = spark.createDataFrame([(w, {n: (w * 7 + k) % 5 / 3 - 0.5 for k, n in enumerate(names) if (w + k) % 4}) for w in range(12)] + [(12, {}), (13, None), (14, {names[0]: float("nan"), names[1]: float("inf")})], "w long, features map<string,double>")
    own = S.rule_evidence(rows, rules, ["w"])
    assert "lambda" not in own._jdf.queryExecution().executedPlan().toString()
    want = rows.select("w", F.inline(S.judged_rules(F.col("features"), rules)))
    assert own.columns == want.columns and sorted(map(str, own.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("n", "starts", "tails"), [(48000, [0, 0.5, 1, 1.5, 2, 2.5], 1), (15999, [0], 1), (6399, [], 0), (16000, [0, 0.5], 1), (22000, [0, 0.5], 1), (0, [], 0)])
def test_windows(spark, n, starts, tails):
    rows = W.window_spans(spark.createDataFrame([(1, n)], "call long, n_samples long")).orderBy("window_index").collect()
    assert [r.start_s for r in rows] == starts and sum(r.is_tail for r in rows) == tails


def test_windowed_samples(spark):
    rows = W.windowed(spark.createDataFrame([(1, [float(k) for k in range(25)])], "call long, samples array<double>"), window=10, hop=5, tail_min=4).orderBy("window_index").collect()
    assert [(r.samples[0], len(r.samples)) for r in rows] == [(0, 10), (5, 10), (10, 10), (15, 10), (20, 5)]


def test_masks(spark):
    mask = "0011011100000111010000"
    rows = spark.createDataFrame([(1, i, c == "1") for i, c in enumerate(mask)], "k long, i long, on boolean")
    got = "".join("1" if r.smooth else "0" for r in W.smooth_mask(rows, ["k"], "i", "on", 4, 3).orderBy("i").collect())
    assert got == "0011111100000111110000"
    from timbra.kernels.dsp import bridged

    m = np.array([[c == "1" for c in mask], [c == "0" for c in mask]])
    assert "".join("1" if v else "0" for v in bridged(m, 4, 3)[0]) == got


def test_alerts_escalate_and_cool_down(spark):
    bands = ["CRITICAL", "LOW", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "HIGH"]
    at = [0, 1, 2, 3, 4, 13, 60]
    rows = spark.createDataFrame([(1, i, b, i < 1, t) for i, (b, t) in enumerate(zip(bands, at, strict=True))], "session_id long, window_index long, band string, provisional boolean, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.window_index, r.band) for r in R.alerts(rows).orderBy("window_index").collect()] == [(2, "HIGH"), (5, "CRITICAL")]


def test_no_call_is_gathered(spark):
    """One long call among short ones: smoothing and alerts stream over it in linear time."""
    n = 60000
    rows = spark.range(n + 50).select(F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("session_id"), F.when(F.col("id") < n, F.col("id")).otherwise(0).alias("window_index"), (F.col("id") * 7919 % 1000 / 10).alias("score"))
    frame = S.smoothed(rows, "session_id", "window_index", "score")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
    value, history, want = None, [], []
    for i in range(n):
        value, history = step(value, history, i * 7919 % 1000 / 10)
        want.append(value)
    got = frame.collect()
    assert len(got) == n + 50 and [r.smoothed for r in sorted((r for r in got if r.session_id == 0), key=lambda r: r.window_index)] == want
    windows = frame.select("*", F.lit("HIGH").alias("band"), F.lit(False).alias("provisional"), F.timestamp_seconds("window_index").alias("ts"))
    fired = R.alerts(windows)
    assert "collect_list" not in fired._jdf.queryExecution().optimizedPlan().toString()
    assert fired.count() == 51 and fired.filter("session_id = 0").first().window_index == 0


def test_approvals(spark):
    sessions = spark.createDataFrame([(1, 85.0, 9, 9.0), (2, 10.0, 9, 9.0), (3, 10.0, 1, 0.5), (4, 65.0, 9, 9.0)], "session_id long, score double, windows_analyzed long, audio_seconds double")
    asks = [(1, 5.0), (2, 5.0), (2, 2e6), (3, 5.0), (4, 5.0), (4, 2e6), (9, 5.0)]
    got = R.approvals(spark.createDataFrame([(i, a, "default") for i, a in asks], "session_id long, amount double, profile string"), sessions, dims.profiles(spark))
    assert {(r.session_id, r.amount): r.decision for r in got.collect()} == dict(zip(asks, ["block", "allow", "step_up", "step_up", "step_up", "block", "not_found"], strict=True))


def test_approval_gate_knows_every_session(spark, sf):
    from timbra.plans import proxies
    from timbra.plans.catalog import QUERIES

    stored = {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    asked = {r.request_id: r.session_id for r in proxies.requests(spark, sf).select("request_id", "session_id").collect()}
    got = {r.request_id: r.decision for r in QUERIES["approval_gate"](spark, sf).collect()}
    assert got.keys() == asked.keys() and any(s % 10 == 7 for s in stored)
    assert {k for k, d in got.items() if d == "not_found"} == {k for k, s in asked.items() if s not in stored} != set()


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    rows = spark.createDataFrame([(int(a), float(b), "m") for a, b in zip(y, s, strict=True)], "y int, score double, method string")
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert M.auc(rows).first()["auc"] == pytest.approx(pairs)
    from timbra.operators.prefix import quantiles

    assert quantiles(rows, [], "score", [0.1, 0.5, 0.77]).first()["q"] == pytest.approx(np.quantile(s, [0.1, 0.5, 0.77]).tolist())
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, score double")
    e = M.eer(M.roc(perfect)).first()
    assert e["eer"] == 0 and math.isfinite(e["eer_threshold"])
    assert M.auc(perfect.filter("y = 1")).first()["auc"] == 0.5
    a, b = M.platt(rows.withColumn("y", (F.rand(1) < F.col("score")).cast("int")))
    assert a > 0


def test_enrolment(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(2, 8))
    rows = [(i, k, (base[k] + rng.normal(0, 0.05, 8)).tolist()) for i, k in enumerate([0, 0, 0, 1])]
    v = V.enrol(spark.createDataFrame([], "vec_id long, identity long, vector array<double>"), spark.createDataFrame([*rows, (9, 1, [0.0] * 8)], "vec_id long, identity long, vector array<double>"))
    assert v.count() == 4
    p = V.spreads(v, V.centroids(v))
    got = {r.identity: r for r in p.collect()}
    assert got[1].spread == 0 and got[0].spread > 0 and np.linalg.norm(got[0].centroid) == pytest.approx(1)
    claims = spark.createDataFrame([(1, 0, base[0].tolist()), (2, 0, base[1].tolist()), (3, 7, base[0].tolist())], "vec_id long, identity long, vector array<double>")
    near = {r.vec_id: r.distance for r in V.compare(claims, p).collect()}
    assert near[1] < 0.01 < near[2] and near[3] is None
    assert V.forget(v, 0).count() == 1


def test_redaction_covers_every_document(spark, tmp_path):
    import hashlib
    import re

    from timbra.plans.catalog import QUERIES

    texts = [None, "", "plain 12345 a.b@c.org", "Rufen Sie 0170 1234567 an, schön: jürgen.müller@straße.de", "écrivez à élodie@exemple.fr, é12345 reste", "señal ١٢٣٤٥ y año 2024", "漢字123456 漢字 123456", "12\u00a034 56ß"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    brute = lambda t: re.sub(r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[email]", re.sub(r"\b\d[\d\s-]{3,}\b", "[number]", t or ""))
    got = {r.doc_id: r.redacted for r in QUERIES["redact_text"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(brute(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_text(spark):
    say = lambda t: one(spark, F.size(T.urgency_hits(F.lit(t))))
    assert say("Please share the code, it is URGENT") == 2 and say("hello") == 0 and one(spark, F.size(T.urgency_hits(F.lit(None).cast("string")))) == 0
    assert one(spark, T.redact(F.lit("call 98765 43210, or a.b@c.org"))) == "call [number], or [email]"


def test_redaction_edges_and_time(spark):
    """The patterns as they are told, in Python's engine; and ten megabytes of what they could walk."""
    import re
    import time

    from timbra.functions import text as T

    def told(t):
        return re.sub(r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[email]", re.sub(r"\b\d[\d\s-]{3,}\b", "[number]", t))

    rng = np.random.default_rng(8)
    texts = ["..a@b.c", "a@b@c.org", "a@b.c-d@e.f", "--@x.y", "x a.b+c-d@e-f.g.h. y", "a@b....", "é@ü.de", "1 2 3 4 5 x", "12   ", "a@b.c,-d@e.f"] + ["".join(rng.choice(list("ab1.+-@ _,"), 40)) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.redact(F.col("t"))).collect()]
    assert got == [told(t) for t in texts]
    units = ["a.", "a-", "a.a-", "1 ", "1-", "-", ".", "a@", "@", "a@b", "a@b.", "+", " ", "1", "_"]
    frame = spark.createDataFrame([(u * (10_000_000 // len(u)),) for u in units], "t string").repartition(len(units))
    began = time.time()
    assert frame.select(F.length(T.redact(F.col("t"))).alias("n")).count() == len(units)
    assert frame.agg(F.sum(F.length(T.redact(F.col("t"))))).first()[0] > 0 and time.time() - began < 120
    assert one(spark, T.mask_number(F.lit("+91 98765-43210"))) == "********3210" and one(spark, T.mask_number(F.lit("12"))) == "***"
    assert one(spark, T.hash_identifier(F.lit("x"), "s")).startswith("h:")
    assert one(spark, T.retention_banner(F.lit("features_only"), F.lit(7200), F.lit(60))).endswith("after 2 h.")


def test_profiles(spark):
    p = dims.profiles(spark)
    new = spark.createDataFrame([("default", 10.0, 20.0, 30.0, ["sms"])], p.schema)
    assert dims.upsert_profile(p, new).filter("profile = 'default'").first()["high"] == 20 and dims.upsert_profile(p, new).count() == 5
    with pytest.raises(Exception, match="rise"):
        dims.upsert_profile(p, spark.createDataFrame([("x", 50.0, 20.0, 30.0, ["sms"])], p.schema)).collect()
    with pytest.raises(ValueError, match="default"):
        dims.delete_profile(p, "default")


def tone(hz, seconds=1.0, harmonics=11):
    t = np.arange(int(16000 * seconds)) / 16000
    return sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, harmonics + 1)) * 0.2


@pytest.mark.parametrize("hz", [110, 180, 250])
def test_pitch(hz):
    from timbra.kernels import dsp

    f0, _ = dsp.pitch(tone(hz)[None])
    assert np.median(f0[f0 > 0]) == pytest.approx(hz, rel=0.05)


def test_kernels(spark):
    from timbra.kernels import dsp
    from timbra.operators.features import extract

    rng = np.random.default_rng(5)
    t = np.arange(16000) / 16000
    am = (1 + np.sin(2 * np.pi * 4 * t)) * rng.normal(0, 0.1, 16000)
    rows, emb = dsp.features(np.stack([tone(180), np.zeros(16000), np.ones(16000), am]))
    assert all(math.isfinite(v) for r in rows for v in r.values()) and len({tuple(r) for r in rows}) == 1
    assert rows[3]["mod_peak_hz"] == pytest.approx(4, abs=1) and rows[1]["silence_exact_zero_ratio"] == 1
    assert rows[0]["f0_mean"] == pytest.approx(180, rel=0.05) and rows[0]["harmonic_count"] >= 10 and np.linalg.norm(emb[0]) == pytest.approx(1)
    assert sum(rows[0][f"band_{a}_{b}"] for a, b in dsp.BANDS) == pytest.approx(1, abs=0.01)
    a = dsp.predictor((tone(180) * np.hanning(16000))[None, :512], 4)
    r = np.correlate(tone(180)[:512] * np.hanning(16000)[:512], tone(180)[:512] * np.hanning(16000)[:512], "full")[511:516]
    r[0] *= 1 + 1e-6
    assert a[0] == pytest.approx(np.linalg.solve([[r[abs(i - j)] for j in range(4)] for i in range(4)], r[1:5]), rel=1e-4)
    df = spark.createDataFrame([(1, tone(180).tolist()), (2, [0.0] * 10), (3, None)], "w long, samples array<double>")
    got = {x.w: x for x in extract(df, ["w"]).collect()}
    assert got[1].features["f0_mean"] == pytest.approx(180, rel=0.05) and got[2].features == got[3].features == {}


def test_speech_mask():
    from timbra.kernels import dsp

    t = np.arange(48000) / 16000
    x = np.sin(2 * np.pi * 180 * t) * (1 + 0.5 * np.sin(2 * np.pi * 4 * t)) * 0.3
    x[20000:30000] = np.random.default_rng(6).normal(0, 1e-4, 10000)
    mask, _ = dsp.speech(x[None])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[0].astype(int), [0]])))
    assert len(edges) == 4


def test_rhythm():
    from timbra.kernels import dsp

    mask = np.array([[c == "#" for c in "##......####......#."], [False] * 20])
    db = np.where(mask, np.arange(20) * 1.0, -60.0)
    got = dsp.rhythm(mask, db, hop=0.01)
    assert got["pause_count"].tolist() == [2, 1] and got["pause_mean"] == pytest.approx([0.06, 0.2]) and got["pause_std"] == pytest.approx([0, 0])
    assert got["speech_run_mean"] == pytest.approx([0.07 / 3, 0]) and got["speech_run_std"][0] == pytest.approx(np.std([0.02, 0.04, 0.01]))
    assert got["energy_range_db"] == pytest.approx([18, 0]) and got["pause_ratio"] == pytest.approx([13 / 20, 1])


def test_audio_bytes(spark):
    from timbra.sources import audio as A

    def wav(x, rate=16000, channels=1, width=2):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
            w.writeframes((x * 32767).astype("<i2").tobytes())
        return out.getvalue()

    x = 0.4 * np.sin(2 * np.pi * 220 * np.arange(16000) / 16000)
    assert A.decoded(wav(x), "auto", None) == pytest.approx(x, abs=1e-4)
    assert A.decoded(wav(np.repeat(x, 2), channels=2), "auto", None) == pytest.approx(x, abs=1e-4)
    y = A.decoded(wav(x[::2], rate=8000), "auto", None)
    assert len(y) == 16000 and np.abs(y[200:-200] - x[200:-200]).max() < 0.02
    assert len(A.decoded(b"RIFFbroken", "auto", None)) == len(A.decoded(b"", "auto", None)) == 0
    assert A.decoded(np.array([1, -2], "<i2").tobytes() + b"x", "pcm16", None) == pytest.approx([1 / 32768, -2 / 32768])
    rows = spark.createDataFrame([(1, bytearray(wav(x))), (2, bytearray(b"")), (3, bytearray(wav(x[:100]))), (4, bytearray(b"RIFFxxxx"))], "i int, content binary").withColumn("samples", A.samples(F.col("content")))
    assert {r.i: r.status for r in A.checked(rows).collect()} == {1: "ok", 2: "empty", 3: "too_short", 4: "undecodable"}
    back = rows.filter("i = 1").withColumn("again", A.samples(A.to_wav(F.col("samples")))).first()
    assert back.again == pytest.approx(back.samples, abs=1e-4)


def test_corpora(spark, tmp_path):
    import json

    from timbra.sources import corpus as C

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text(json.dumps({"utterances": [{"path": "a.wav", "label": "spoof", "speaker_id": "s1", "method": "x", "duration": 2.0, "seed": 4}]}, indent=1))
    assert C.load(spark, str(tmp_path / "m")).first()["method"] == "x"
    for p in ("f/bonafide/spk1/u1.wav", "f/fake/voc/u2.wav", "f/other/u3.wav"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[-1]: (r.label, r.speaker_id, r.method) for r in C.load(spark, str(tmp_path / "f")).collect()}
    assert rows == {"u1.wav": ("bonafide", "spk1", "human"), "u2.wav": ("spoof", "voc", "voc")}
    for k, name in enumerate([*C.GENUINE_FOLDERS, *C.SPOOF_FOLDERS]):
        (tmp_path / "g" / name).mkdir(parents=True)
        (tmp_path / "g" / name / f"v{k}.flac").write_bytes(b"x")
    rows = {r.path.rsplit("/", 2)[-2]: (r.label, r.speaker_id, r.method) for r in C.load(spark, str(tmp_path / "g")).collect()}
    assert len(rows) == 11 and all(rows[n] == ("bonafide", "unknown", "human") for n in C.GENUINE_FOLDERS) and all(rows[n] == ("spoof", "unknown", "unknown") for n in C.SPOOF_FOLDERS)
    (tmp_path / "p.txt").write_text("LA1 u1 - - bonafide\nLA2 u2 - A07 spoof\nLA3 gone - A08 spoof\n")
    rows = {r.utterance: (r.label, r.method) for r in C.load(spark, str(tmp_path / "f"), protocol=str(tmp_path / "p.txt")).collect()}
    assert rows == {"u1": ("bonafide", "human"), "u2": ("spoof", "A07")}
    assert [r.utterance for r in C.missing(spark, str(tmp_path / "f"), str(tmp_path / "p.txt")).collect()] == ["gone"]
    (tmp_path / "f" / "x").mkdir()
    (tmp_path / "f" / "x" / "LA.cm_protocol.train.txt").write_text("LA1 u1 - - bonafide\nLA2 u2 - A07 spoof\n")
    assert {r.utterance for r in C.load(spark, str(tmp_path / "f")).collect()} == {"u1", "u2"}  # found by itself
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError, match="no labelled"):
        C.load(spark, str(tmp_path / "e"))


def test_stream_equals_batch(spark, sf, tmp_path):
    from timbra.plans import proxies as Q
    from timbra.streaming import calls

    w = Q.windows(spark, sf).select("session_id", "window_index", F.col("ts").cast("timestamp").alias("ts"), "score")
    w.repartition(3, "session_id").sortWithinPartitions("window_index").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = calls.write_once(calls.judged(live), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    got = {(r.session_id, r.window_index): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = S.trail(S.smoothed(w, "session_id", "window_index", "score"), "session_id", "window_index")
    banded = S.banded(batch.withColumn("profile", F.lit("default")), dims.profiles(spark))
    want = {(r.session_id, r.window_index): r for r in banded.collect()}
    assert got.keys() == want.keys()
    assert all(got[k].smoothed == want[k].smoothed and got[k].band == want[k].band and got[k].provisional == want[k].provisional for k in want)
    alerts = {(r.session_id, r.window_index) for r in R.alerts(banded.join(w.select("session_id", "window_index", "ts"), ["session_id", "window_index"])).collect()}
    assert {k for k, r in got.items() if r.alert} == alerts


def test_training(spark):
    from timbra.ml import training as L

    rng = np.random.default_rng(7)
    rows = [(int(k % 20), "real" if k % 2 == 0 else f"m{k % 3}", k % 2, float(rng.normal(k % 2 * 2)), float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "speaker long, method string, y int, a double, b double").withColumn("speaker", F.col("speaker") % 10)
    model, (a, _), figures = L.train(df, ["a", "b", "missing"], "gradient_boosting", size=5)
    assert figures["auc"] > 0.8 and a > 0 and max(L.importances(model, ["a", "b", "missing"]).items(), key=lambda kv: kv[1])[0] == "a"
    unseen = L.unseen_methods(df, ["a", "b"])
    assert set(unseen) == {"m0", "m1", "m2"} and all(v["eer"] < 0.35 for v in unseen.values())


def pulses(f0, jitter=0.0, shimmer=0.0, n=16000):
    """A voice of decaying pulses whose periods and amplitudes alternate by given shares."""
    x, at, sign = np.zeros(n), 0.0, 1
    while at < n - 100:
        i = np.arange(int(np.ceil(at)), min(int(at) + 400, n))
        d = (i - at) / 16000
        x[i] += 0.4 * (1 + sign * shimmer) * np.exp(-d * 300) * np.sin(2 * np.pi * f0 * d)
        at, sign = at + 16000 / f0 * (1 + sign * jitter), -sign
    return x


def test_jitter_and_shimmer():
    """Alternating periods p (1 +- j) differ by 2 j p each time, amplitudes alike. The low-pass
    filter takes some of so fast an alternation away, and the next pulse hides some of a small
    one, but the same share at every depth."""
    from timbra.kernels import dsp

    rows, _ = dsp.features(np.stack([pulses(150), pulses(150, jitter=0.01), pulses(150, jitter=0.02), pulses(150, shimmer=0.04), pulses(150, shimmer=0.08), np.zeros(16000)]))
    even, some, twice, shimmer, deeper, none = rows
    assert even["jitter_local"] < 0.001 and even["shimmer_local"] < 0.005 and even["cycle_count"] == pytest.approx(149, abs=3)
    assert 0.6 * 0.02 < some["jitter_local"] < 0.021 and all(twice[k] == pytest.approx(2 * some[k], rel=0.15) for k in ("jitter_local", "jitter_ppq5", "period_cv"))
    assert some["period_cv"] == pytest.approx(some["jitter_local"] / 2, rel=0.3)
    assert 0.6 * 0.08 < shimmer["shimmer_local"] < 0.084 and shimmer["jitter_local"] < 0.01 and all(deeper[k] == pytest.approx(2 * shimmer[k], rel=0.2) for k in ("shimmer_local", "shimmer_apq3", "amplitude_cv"))
    assert none["cycle_count"] == none["jitter_local"] == none["hnr_db"] == 0
    assert even["hnr_db"] > 3


def test_lowpass_and_peaks():
    from timbra.kernels import dsp

    t = np.arange(4000) / 16000
    slow, fast = np.sin(2 * np.pi * 100 * t), np.sin(2 * np.pi * 2000 * t)
    out = dsp.lowpass(slow + fast, 400)
    assert np.abs(out - slow)[200:-200].max() < 0.01  # no delay, and the fast part is gone
    half = dsp.lowpass(np.sin(2 * np.pi * 400 * t), 400)
    assert np.abs(half[400:-400]).max() == pytest.approx(0.5, abs=0.01)  # half at the cut-off: the response squared
    x = np.array([0, 3, 0, 5, 0, 4, 0, 0, 0, 2, 0.0])
    assert dsp.peaks(x, 1).tolist() == [1, 3, 5, 9] and dsp.peaks(x, 3).tolist() == [3, 9]


def test_beats_and_priors():
    from timbra.kernels import dsp

    db = -30 + 10 * np.sin(2 * np.pi * 5 * np.arange(200) * 0.01)[None]
    mask = np.ones((1, 200), bool)
    got = dsp.rhythm(mask, db, syllables=4.0, pauses=0.2)
    assert got["syllable_rate"][0] == pytest.approx(5, abs=0.6)
    assert got["syllable_rate_z"][0] == pytest.approx((got["syllable_rate"][0] - 4) / 4) and got["pause_ratio_z"][0] == -1


def test_all_features_in_a_fixed_order(spark):
    """123 names, the same for every window; a voiced window lets the prosodic layer vote."""
    from pyspark.sql import functions as F

    from timbra.operators.features import extract, feature_names, vector
    from timbra.operators.scoring import prosodic_confidence

    names = feature_names()
    assert len(names) == len(set(names)) == 123
    windows = spark.createDataFrame([(0, [float(v) for v in pulses(140, 0.01, 0.05)], "hi-IN"), (1, [0.0] * 16000, None), (2, [0.1] * 100, None)], "k long, samples array<double>, language string")
    rows = extract(windows, ["k"], language="language").select("k", "features", vector(F.col("features"), names).alias("v"), prosodic_confidence(F.lit(1.0), F.coalesce(F.col("features")["cycle_count"], F.lit(0.0)), F.coalesce(F.col("features")["speech_ratio"], F.lit(0.0))).alias("c")).orderBy("k").collect()
    assert [sorted(r.features) for r in rows] == [sorted(names), sorted(names), []]
    assert all(len(r.v) == 123 for r in rows) and rows[0].v[names.index("cycle_count")] > 100
    assert rows[0].c > 0.9 and rows[1].c == rows[2].c == 0


def test_corpus_features(spark, tmp_path):
    """First eight windows of recordings of a second or more, silent windows left out."""
    from timbra.operators.features import feature_names
    from timbra.sources import corpus as C

    def wav(x):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    t = np.arange(16000 * 6) / 16000
    voice = np.sin(2 * np.pi * 180 * t) * (1 + 0.5 * np.sin(2 * np.pi * 4 * t)) * 0.3 * (t % 0.8 < 0.5)
    for name, x in {"real/s1/long.wav": voice, "real/s1/short.wav": voice[:15000], "fake/m1/silent.wav": np.zeros(32000), "fake/m1/one.wav": voice[:16000]}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(wav(x))
    (tmp_path / "fake" / "m1" / "broken.wav").write_bytes(b"RIFFxxxx")
    rows = C.corpus_features(C.load(spark, str(tmp_path))).select("path", "label", "window_index", "vector").collect()
    seen = sorted((r.path.rsplit("/", 1)[-1], r.label, r.window_index) for r in rows)
    assert seen == [("long.wav", "bonafide", k) for k in range(8)] + [("one.wav", "spoof", 0), ("one.wav", "spoof", 1)]  # its tail is long enough
    assert all(len(r.vector) == len(feature_names()) for r in rows)


def test_assessment(spark):
    """One row through fusion, policy, factors, caveats, JSON and text."""
    import json

    from timbra.operators import assess as A

    factor = lambda code, share, value: (code, code.replace("_", " ").title(), share, value)
    layers = [("acoustic", 0.9, 0.8, [factor("hf_cliff_depth_db", 0.7, 61.2), factor("silence_exact_zero_ratio", 0.3, 0.125)]), ("prosodic", 0.2, 0.5, [factor("jitter_ppq5", 0.001, 0.0)]), ("speaker", 0.5, 0.0, []), ("context", 0.5, 0.5, [factor("own_code", 1.0, 3.0)])]
    kind = "array<struct<layer:string,score:double,confidence:double,factors:array<struct<code:string,label:string,contribution:double,value:double>>>>"
    rows = spark.createDataFrame([(1, layers, "wire_transfer", 4_200_000.0, 10.0, 50.0), (2, layers, "no such", None, 1.0, None), (3, [], None, None, 9.0, None)], f"id int, layers {kind}, profile string, transaction_amount double, elapsed_seconds double, shown double")
    out = A.assessed(rows, dims.profiles(spark), "shown").withColumns({"j": A.assessment_json(), "v": A.assessment_json(True), "t": A.explanation_text(), "a": A.alert_json(F.col("id"), F.lit(1.5))})
    one, two, none = out.orderBy("id").collect()
    shift = 10 * (4.2e6 - 1e5) / 4.9e6
    assert one.threshold_shift == pytest.approx(shift) and one.policy == "wire_transfer" and one.score == 50.0 and one.band == "HIGH"  # 45 - 8.4 <= 50 < 65 - 8.4
    power = {"acoustic": 0.45 * 0.8, "prosodic": 0.28 * 0.5, "context": 0.08 * 0.5}
    z = sum(p * math.log(s / (1 - s)) for p, s in zip(power.values(), (0.9, 0.2, 0.5), strict=True)) / sum(power.values())
    assert one.probability == pytest.approx(1 / (1 + math.exp(-z))) and two.score == pytest.approx(round(100 / (1 + math.exp(-z)), 1))
    assert [f.code for f in one.factors] == ["hf_cliff_depth_db", "silence_exact_zero_ratio", "own_code"] and one.factors[0].detail == "spectrum collapses by 61 dB above the cut-off" and one.factors[1].detail == "12.5% of samples are numerically zero" and one.factors[2].detail == "own_code = 3.000"
    assert one.headline.startswith("Risk 50/100 — this voice shows several") and "hf cliff depth db" in one.headline
    assert [c.code for c in one.counter_factors] == ["prosodic_genuine"] and any("lowered by 8 points" in c for c in one.caveats) and any("enrolled" in c for c in one.caveats)
    j, v, alert = json.loads(one.j), json.loads(one.v), json.loads(one.a)
    assert j["band"] == "HIGH" and j["threshold_shift"] == round(shift, 2) and [x["status"] for x in j["layers"]] == ["voted", "voted", "abstained", "voted"] and "explanation" not in j
    assert v["explanation"]["headline"] == one.headline and "layers" not in v and alert["session_id"] == 1 and alert["created_at"] == 1.5
    assert one.t.splitlines()[0] == one.headline and "Why:" in one.t and one.t.endswith(dims.ACTIONS["HIGH"])
    assert two.policy == "default" and two.threshold_shift == 0 and any(c.startswith("Only 1.0 s") for c in two.caveats)
    assert none.probability == 0.5 and none.confidence == 0 and none.factors == [] and none.band == "ELEVATED"


def test_details_match_their_rules():
    assert {r[0] for r in [*dims.ACOUSTIC_RULES, *dims.PROSODIC_RULES]} == set(dims.DETAILS)


def test_chunker():
    from timbra.streaming.live import Chunker

    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, 16000 * 3 + 9000).astype(np.float32)
    want = [(k, k * 8000) for k in range(6)]
    for _ in range(5):
        c, got, at = Chunker(), [], 0
        while at < len(x):
            n = int(rng.integers(1, 20000))
            got += list(c.push(x[at:at + n]))
            at += n
        assert [g[:2] for g in got] == want and all((x[s:s + 16000] == w).all() for _, s, w in got)
        last, = c.flush()
        assert last[0] == 6 and last[1] == 48000 and (last[2] == x[48000:]).all() and not list(c.flush()) and c.total == len(x)
    c = Chunker(cap=20000)
    got = list(c.push(x[:30000]))  # the oldest beyond the cap are lost
    assert [g[:2] for g in got] == [(0, 10000)] and not list(Chunker().flush())


def test_live_windows_equal_batch(spark, tmp_path):
    """Chunks of any size, out of order within a batch, over several batches; calls that stop and
    one that is erased."""
    from timbra.operators.windows import windowed
    from timbra.streaming import live as L

    rng = np.random.default_rng(4)
    calls = {f"c{k}": (rng.normal(0, 0.1, n) * 32767).clip(-32768, 32767).astype("<i2") for k, n in enumerate((50000, 16000, 9000, 3000, 40000))}
    recordings = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in calls.items()], "id string, content binary")
    chunks = L.chunked(recordings, "id", "content", 6002)
    assert chunks.count() == sum(max(1, -(-2 * len(v) // 6002)) for v in calls.values())
    rows = [r.asDict() for r in chunks.collect()]
    rows = [r | {"control": "delete"} if r["session_id"] == "c4" and r["control"] == "stop" else r for r in rows]
    for part in range(3):
        own = [r for r in rows if r["seq"] * 3 // (1 + max(x["seq"] for x in rows if x["session_id"] == r["session_id"])) == part]
        if own:
            spark.createDataFrame(sorted(own, key=lambda r: -r["seq"]), chunks.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from timbra.streaming.calls import write_once

    q = write_once(L.windows_of(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(r.id, r.window_index): r.samples for r in windowed(recordings.filter("id <> 'c4'").select("id", F.lit(0).alias("z")).join(spark.createDataFrame([(k, (v / np.float32(32768)).tolist()) for k, v in calls.items()], "id string, samples array<float>"), "id")).collect()}
    mine = {(r.session_id, r.window_index): r.samples for r in got if r.kind == "window" and r.session_id != "c4"}
    assert mine == want
    closed = {r.session_id: r for r in got if r.kind == "closed"}
    assert set(closed) == {"c0", "c1", "c2", "c3"} and closed["c0"].audio_seconds == 50000 / 16000 and len(closed["c0"].chunk_hashes) == -(-100000 // 6002)
    assert closed["c3"].windows == 0 and L.late_rows([{"stateOperators": [{"numRowsDroppedByWatermark": 2}]}, {}]) == 2


def test_idle_call_closes_with_its_figures():
    import pandas as pd

    from timbra.streaming.calls import judge

    class State:
        hasTimedOut, exists, get = False, False, None

        def update(self, x):
            self.get, self.exists = x, True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.ms = ms

    state, f = State(), judge({"default": (35, 60, 80), "strict": (5, 10, 20)})
    windows = pd.DataFrame({"window_index": [1, 0], "score": [30.0, 10.0], "ts": [pd.Timestamp("2026-01-01")] * 2, "profile": [None, "strict"]})
    a, = f((7,), iter([windows]), state)
    assert a["band"].tolist() == ["HIGH", "HIGH"] and a["window_index"].tolist() == [0, 1] and not a["closed"].any()
    state.hasTimedOut = True
    last, = f((7,), iter([]), state)
    assert last["closed"].tolist() == [True] and last["peak"][0] == a["peak"].max() and last["band"][0] == "HIGH" and not state.exists


def test_upserts(spark, tmp_path):
    from timbra.streaming import live as L

    schema = "id string, t int, opened int, closed int, verdict string"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("a", 1, 10, None, None), ("b", 1, 11, None, None)], [("a", 2, None, 20, "suspicious"), ("c", 2, 12, None, None), ("c", 3, 13, None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        L.write_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), ["id"], "t").awaitTermination(120)
        got = sorted((tuple(r) for r in L.version(spark, str(tmp_path / "out")).select("id", "opened", "closed", "verdict").collect()), key=str)
        assert got == ([("a", 10, None, None), ("b", 11, None, None)], [("a", 10, 20, "suspicious"), ("b", 11, None, None), ("c", 13, None, None)])[k]
    assert L.version(spark, str(tmp_path / "none")) is None


def test_model_bundles(spark, tmp_path):
    """A stored model judges as the fitted one; anything unreadable leaves the rules to judge."""
    from timbra.ml import registry as G
    from timbra.ml import training as L

    rng = np.random.default_rng(9)
    rows = [(int(k % 12), k % 2, {"a": float(rng.normal(k % 2 * 3)), "b": float(rng.normal())}, (0.6, 0.7, [("a", "A", 0.4, 1.0), ("b", "B", 0.6, 1.0)])) for k in range(240)]
    df = spark.createDataFrame(rows, "speaker long, y int, features map<string,double>, own struct<score:double,confidence:double,factors:array<struct<code:string,label:string,contribution:double,value:double>>>")
    flat = df.select("speaker", "y", *[F.col("features")[n].alias(n) for n in "ab"])
    model, calibration, figures = L.train(flat, ["a", "b"], "random_forest", size=10)
    bundle = G.Bundle(model, ["a", "b"], "m1", calibration, L.importances(model, ["a", "b"]), metrics={"auc": figures["auc"]})
    path = str(tmp_path / "bundle")
    G.save(bundle, path, spark)
    again, amiss = G.load(spark, path)
    assert not amiss and (again.model_id, again.feature_names, again.calibration, again.importances) == ("m1", ["a", "b"], bundle.calibration, bundle.importances)
    one, two = (G.acoustic_layer(df, b).select("y", "heuristic", "own.*").collect() for b in (bundle, again))
    assert one == two and not one[0].heuristic and one[0].confidence == 0.95
    assert np.mean([r.score for r in one if r.y]) > np.mean([r.score for r in one if not r.y]) + 0.2
    f = {x.code: x.contribution for x in one[0].factors}
    lift = {n: w * (1 + bundle.importances[n]) for n, w in (("a", 0.4), ("b", 0.6))}
    assert f == {n: pytest.approx(v / sum(lift.values())) for n, v in lift.items()} and [x.contribution for x in one[0].factors] == sorted(f.values(), reverse=True)
    none, amiss = G.load(spark, str(tmp_path / "nowhere"))
    assert none is None and "rules" in amiss[0]
    rules = G.acoustic_layer(df, None).select("heuristic", "own.*").first()
    assert rules.heuristic and rules.score == 0.6 and rules.confidence == pytest.approx(0.56)
    (tmp_path / "bundle" / "facts" / "part-x.txt").write_text("{")
    G.save(G.Bundle(model, ["a", "b"], format=0), path, spark)
    assert "train again" in G.load(spark, path)[1][0]


def test_full_stack_and_summary(spark):
    from timbra.ml import registry as G

    rng = np.random.default_rng(10)
    rows = [(c, w, c % 2, [("acoustic", float(np.clip(0.25 + 0.5 * (c % 2) + rng.normal(0, 0.05), 0.01, 0.99)), 0.9), ("context", 0.5, 0.3)]) for c in range(20) for w in range(6)]
    windows = spark.createDataFrame(rows, "session_id long, window_index long, y int, layers array<struct<layer:string,score:double,confidence:double>>")
    got = G.full_stack(windows)
    assert got["auc"] == 1.0 and got["accuracy"] == 1.0 and got["tp"] == 10 and got["eer"] == 0
    fitted = spark.createDataFrame([("a", "refitted"), ("c", "pruned"), ("b", "pruned"), ("d", "kept defaults (too few samples)")], "feature string, action string")
    assert G.fit_summary(fitted) == "refitted: 1   pruned: 2   defaults kept: 1\npruned rules: b, c"
    told = fitted.withColumn("auc", F.when(F.col("feature") != "d", F.lit(0.5) + F.ascii("feature") / 1000))
    assert G.fit_summary(told).splitlines()[2:] == ["most discriminative rules:", f"  {'c':28s} AUC 0.599", f"  {'b':28s} AUC 0.598", f"  {'a':28s} AUC 0.597"]


def test_enrolments_speech_and_context(spark):
    import json

    from timbra.operators import speaker as V
    from timbra.operators.features import speech_only

    v = spark.createDataFrame([("a", [0.5, 0.25]), ("b", [0.0, 0.0])], "identity string, vector array<double>")
    kept = V.stored(v).unionByName(spark.createDataFrame([("c", "nonsense"), ("d", None)], "identity string, vector string"))
    assert [tuple(r) for r in V.loaded(kept).collect()] == [("a", [0.5, 0.25])]
    x = tone(180) * (np.arange(16000) < 9000)
    rows = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 16000), (3, None)], "k int, samples array<double>").select("k", F.size(speech_only(F.col("samples"))).alias("n")).orderBy("k").collect()
    assert 0.9 * 18000 < rows[0].n < 1.15 * 18000 and rows[1].n == rows[2].n == 0  # frames overlap by half
    c = spark.range(1).withColumns({n: F.lit(None).cast("string") for n in T.CONTEXT_FIELDS} | {"origin": F.lit("voip")})
    assert json.loads(one(spark, T.context_json(lambda n: F.lit("voip") if n == "origin" else F.lit(None).cast("string")))) == {"origin": "voip"} and c.count() == 1


def test_assessments_of_a_batch_at_once():
    """All windows as columns give what each gives alone, unknown facts and empty windows included."""
    import pyarrow as pa

    from timbra.operators import layers as J

    n, rng = 200, np.random.default_rng(3)
    registry = J.rules_only().register(J.Layer("context", 0.08, J.context, (), ("context",)))
    rules = {r[0]: r for r in dims.ACOUSTIC_RULES + dims.PROSODIC_RULES}
    values = np.array([[rng.choice([np.nan, 0.0, rules[f][2], rules[f][3], (rules[f][2] + rules[f][3]) / 2, rng.normal()]) if f in rules else rng.choice([np.nan, 0.0, 60.0]) for f in registry.features] for _ in range(n)])
    values[0], values[1] = np.nan, 0.0
    some = {
        "claimed_identity": ["", None, "the CEO"], "claimed_role": ["", None, "clerk", "Managing Director"], "origin": ["", None, "VoIP", "pstn", "moon"], "known_contact": [True, False, None], "caller_id_verified": [True, False, None],
        "transcript": [None, "", "hello", "URGENT, share the code, right now"], "transaction_amount": [None, 0.0, 2.5e6, 1e9], "prior_fraud_reports": [None, 0, 2, 9], "local_hour": [None, 3, 12, 22], "account_age_days": [None, 3, 300], "first_contact": [True, False, None],
    }
    facts = {f"c:{k}": pa.array([xs[rng.integers(len(xs))] for _ in range(n)], {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64()}[J.CONTEXT_KINDS[k]]) for k, xs in some.items()}
    facts = {k: v.take(pa.array([None, *range(1, n)], pa.int64())) for k, v in facts.items()}  # nothing is known of the first
    profile = pa.array([["default", "consumer", None, "no such"][k % 4] for k in range(n)])
    elapsed, speech, override = [0.5, 4.0] * (n // 2), [1.0] * (n // 2) + [0.1] * (n // 2), [None, 35.0, None, 88.8] * (n // 4)
    columns = {"f": pa.ListArray.from_arrays(pa.array(range(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), from_pandas=True)), **facts}
    batch, policy = J.batch_of(columns, registry, n), J.Policy(heuristic=True)
    votes = registry.vote(batch)
    fused = J.fuse(votes, registry.fusion())
    whole = J.judged_columns(votes, fused, policy, profile, batch.context, elapsed, speech, override)
    whole = [dict(zip("score band action probability confidence policy threshold_shift headline factors counter_factors layer_summary caveats".split(), r, strict=True)) for r in zip(*(c.to_pylist() for c in whole), strict=True)]
    plain = J.Batch(n, batch.features, batch.vectors, batch.past, batch.enrolled, list(batch.context))
    alone = registry.vote(plain)
    again = J.fuse(alone, registry.fusion())
    for i in range(n):
        assert whole[i] == J.judged(alone, again, i, policy, profile[i].as_py(), plain.context[i], elapsed[i], speech[i], override[i])
    assert {len(r["factors"]) for r in whole} >= {0, 4} and {r["band"] for r in whole} == set(dims.BANDS) and {len(r["counter_factors"]) for r in whole} >= {0, 1, 2}


def test_windows_reach_python_in_pieces(spark):
    """A row to Python holds a bounded part of a window, and batches that cut windows change nothing."""
    from timbra.operators import features as E

    rng = np.random.default_rng(5)
    rows = [(w, None if w == 3 else [float(x) for x in rng.normal(size=(16000, 4000, 3999, 0, 7777)[w % 5])]) for w in range(19)]
    df = spark.createDataFrame(rows, "w long, samples array<double>").coalesce(1)
    own = E.extract(df, ["w"])
    assert "posexplode" in own._jdf.queryExecution().executedPlan().toString() and E.PIECE <= 1000
    whole = {r.w: r for r in own.collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = {r.w: r for r in E.extract(df, ["w"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole == cut and sorted(whole) == list(range(19))
    from timbra.kernels import dsp

    for w, x in rows:
        if x is None or len(x) < E.MIN_SAMPLES:
            assert whole[w].features == {} and not any(whole[w].embedding)
        else:
            alone, _ = dsp.features(np.array(x)[None], *next(r[1:5] for r in dims.LANGUAGES if r[0] == "auto"))
            assert whole[w].features == pytest.approx(alone[0])
