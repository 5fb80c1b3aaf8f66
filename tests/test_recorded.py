"""Recordings by seek: formats, rates, windows, replay, sampling and the full stack."""

import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbra import dims
from timbra.operators import call as C
from timbra.operators.layers import Layer, Registry, Verdicts
from timbra.sources import audio as A
from timbra.sources import corpus
from timbra.sources import recorded as R

from .test_calls import pcm, voice


def wav(x, rate=16000, channels=1, width=2, extra=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        full = (1 << (8 * width - 1)) - 1
        v = np.repeat(np.clip(x, -1, 1) * full, channels)
        raw = (v + 128).astype(np.uint8).tobytes() if width == 1 else v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() if width == 3 else v.astype(f"<i{width}").tobytes()
        w.writeframes(raw)
    raw = out.getvalue()
    return raw[:4] + struct.pack("<I", len(raw) - 8 + len(extra)) + raw[8:12] + extra + raw[12:]


def float_wav(x, rate=16000):
    data = np.asarray(x, "<f4").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, rate * 4, 4, 32) + b"data" + struct.pack("<I", len(data)) + data


def au(x, kind=3, rate=16000):
    data = np.asarray(x, ">f4").tobytes() if kind == 6 else (x * 32767).astype(">i2").tobytes()
    return b".snd" + struct.pack(">5I", 28, 0xFFFFFFFF, kind, rate, 1) + b"\0" * 4 + data


@pytest.mark.parametrize(("rate", "channels", "width", "extra"), [(16000, 1, 2, b""), (16000, 2, 3, b"LIST\x04\0\0\0abcd"), (8000, 1, 1, b""), (44100, 2, 2, b"junk\x03\0\0\0abc\0"), (48000, 1, 4, b"")])
def test_seeks_give_what_decoding_the_whole_gives(tmp_path, rate, channels, width, extra):
    x = voice(150, 2.7)[: int(2.7 * 16000)]
    x = np.interp(np.arange(int(2.7 * rate)) / rate, np.arange(len(x)) / 16000, x)
    raw = wav(x, rate, channels, width, extra)
    (tmp_path / "x.wav").write_bytes(raw)
    r, whole = R.Recording(f"file:{tmp_path}/x.wav"), A.decoded(raw, "container", None)
    assert r.samples == len(whole)
    for a, b in ((0, 16000), (8000, 24000), (12345, 12346), (len(whole) - 700, len(whole) + 999), (0, len(whole))):
        assert r.heard(a, b) == pytest.approx(whole[a:b], abs=1e-6)


def test_other_formats(tmp_path):
    x = voice(150, 1.2)
    for name, raw, want in (("f.wav", float_wav(x), x), ("loud.wav", float_wav(x * 8), x / np.abs(x).max()), ("a.au", au(x), x), ("b.au", au(x, 6), x)):
        (tmp_path / name).write_bytes(raw)
        r = R.Recording(str(tmp_path / name))
        assert (r.samples, r.rate) == (len(x), 16000) and r.heard(100, 9000) == pytest.approx(want[100:9000], abs=2e-4), name
    for name, raw in (("x.wav", b"RIFFxxxxWAVE"), ("y.wav", b""), ("z.wav", b"fLaC" + bytes(50)), ("alaw.wav", float_wav(x).replace(struct.pack("<HH", 3, 1), struct.pack("<HH", 6, 1), 1))):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises((R.Unreadable, OSError)):
            R.Recording(str(tmp_path / name))


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """Recordings in folders: real and fake voices, one silent, one short, one broken."""
    top = tmp_path_factory.mktemp("library")
    for k in range(6):
        for kind, x in (("real/s1", voice(120 + 9 * k, 2.2, k)), ("fake/m1", voice(200 + 9 * k, 2.2, k))):
            (top / kind).mkdir(parents=True, exist_ok=True)
            (top / kind / f"{k}.wav").write_bytes(wav(x, 8000 if k == 5 else 16000) if k != 5 else wav(x[::2], 8000))
    (top / "real/s1/silent.wav").write_bytes(wav(np.zeros(32000)))
    (top / "real/s1/short.wav").write_bytes(wav(voice(130, 0.8)))
    (top / "fake/m1/broken.wav").write_bytes(b"RIFFxxxx")
    return str(top)


def test_windows_of_a_library(spark, library):
    rows = corpus.load(spark, library)
    got = R.windows(rows, most=3, least_seconds=1.0)
    own = {}
    for r in got.collect():
        own.setdefault(r.path, []).append((r.window_index, r.start_s, r.end_s, len(r.samples)))
    assert len(own) == 13 and all(sorted(v) == [(0, 0.0, 1.0, 16000), (1, 0.5, 1.5, 16000), (2, 1.0, 2.0, 16000)] for p, v in own.items())
    assert R.windows(rows.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "content" not in plan
    assert [b - a for _, a, b in R.spans(22400)] == [16000, 14400] and list(R.spans(6400)) == [(0, 0, 6400)] and list(R.spans(6399)) == []


def test_long_recordings_are_read_in_parts(tmp_path, monkeypatch):
    """Twenty minutes: no read is larger than two windows."""
    (tmp_path / "long.wav").write_bytes(wav(np.tile(voice(150, 1.0), 1200)))
    most, read = [], R.Recording.read
    monkeypatch.setattr(R.Recording, "read", lambda self, a, b: (most.append(b - a), read(self, a, b))[1])
    r = R.Recording(str(tmp_path / "long.wav"))
    assert sum(len(r.heard(a, b)) > 0 for _, a, b in R.spans(r.samples)) == 2400 and max(most) <= 2 * dims.WINDOW


def test_recordings_as_calls_equal_chunks_of_them(spark, library):
    rows = corpus.load(spark, library)
    got = {}
    for r in R.judged(rows).filter("kind = 'closed'").collect():
        got[r.session_id.rsplit("/", 2)[-2] + r.session_id.rsplit("/", 1)[-1]] = json.loads(r.payload)
    assert len(got) == 13 and got["s1silent.wav"]["verdict"] == "insufficient_audio"
    content = spark.createDataFrame([("x", pcm(voice(120, 2.2, 0)))], "s string, c binary")
    same = json.loads(C.recordings_judged(content, "s", "c").filter("kind = 'closed'").first().payload)
    for k in ("final_score", "peak_score", "mean_score", "verdict", "band_histogram", "duration_seconds", "top_factors"):
        assert same[k] == got["s10.wav"][k], k


def test_stratified_samples_are_exact_and_seeded(spark):
    rows = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") % 10 == 0, "spoof").otherwise("bonafide").alias("label"))
    one = R.stratified(rows, "label", 40, ["bonafide", "spoof"]).collect()
    assert sorted(one) == sorted(R.stratified(rows.repartition(7), "label", 40, ["bonafide", "spoof"]).collect())
    assert [sum(r.label == k for r in one) for k in ("spoof", "bonafide")] == [40, 40]
    assert {r.path for r in one} != {r.path for r in R.stratified(rows, "label", 40, ["bonafide", "spoof"], 12).collect()}
    assert R.stratified(rows, "label", 9999, ["spoof"]).count() == 300


def test_full_stack_from_recordings(spark, library):
    """From bytes to AUC and EER in one call, with a layer that knows the pitch of the fakes."""
    def high(b):
        sure = b.value("f0_mean") > 180 if "f0_mean" in b.features else np.zeros(b.n, bool)
        return Verdicts(np.where(sure, 0.99, 0.01), np.ones(b.n), [[] for _ in range(b.n)], [None] * b.n)

    from timbra.operators.features import feature_names

    assert "f0_mean" in feature_names()
    rows = corpus.load(spark, library)
    whole = R.full_stack(rows, Registry([Layer("high", 1.0, high, ("f0_mean",))]))
    assert whole["calls"] == 12 and whole["metrics"]["auc"] == 1.0 and whole["metrics"]["eer"] == 0.0 and whole["metrics"]["accuracy"] == 1.0
    assert whole["per_method"]["m1"]["flag_rate"] == 1.0 and whole["per_method"]["bonafide"]["n"] == 6 and whole["windows"] >= 40
    plain = R.full_stack(rows, limit=8)
    assert plain["calls"] <= 8 and 0 <= plain["metrics"]["auc"] <= 1
    assert "one class" in R.full_stack(rows.filter("label = 'spoof'"))["error"] and "no recording" in R.full_stack(rows.limit(0))["error"]
