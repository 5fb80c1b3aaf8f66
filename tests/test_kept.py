"""Kept tables: buckets, versions, retries, crashes, erasure; live calls recorded."""

import json
import os

import pytest
from pyspark.sql import functions as F

from timbra.operators import call as C
from timbra.sources import kept as K

from .test_calls import HOSTILE, events, frame_of, streamed


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def sessions(spark, ids, **values):
    return spark.createDataFrame([(i,) for i in ids], "session_id string").select("session_id", *[F.lit(v).alias(k) for k, v in values.items()])


@pytest.fixture
def kept(spark, tmp_path):
    k = K.Kept(spark, str(tmp_path / "kept"), buckets=32)
    ids = [f"s{n}" for n in range(2000)]
    rows = sessions(spark, ids, created_at=1.0, profile="default", report="r" * 200)
    alerts = sessions(spark, ids[:500], created_at=2.0, band="HIGH", score=70.0)
    k.write({"sessions": (rows, "created_at")}, {"alerts": alerts, "assessments": alerts.withColumn("window_index", F.lit(3))})
    return k


def test_a_write_follows_what_it_touches(spark, kept):
    before = size(kept.path)
    kept.write({"sessions": (sessions(spark, ["s7"], created_at=5.0, closed_at=9.0, verdict="suspicious"), "created_at")})
    assert size(kept.path) - before < before / 10
    row = kept.of("sessions", "s7").collect()
    assert len(row) == 1 and (row[0].closed_at, row[0].verdict, row[0].profile, row[0].report) == (9.0, "suspicious", "default", "r" * 200)
    assert kept.counts() == {"sessions": 2000, "assessments": 500, "alerts": 500}
    assert len(kept.of("alerts", "s7", "s8", "nobody").collect()) == 2
    plan = kept.of("sessions", "s7")
    assert len(plan.inputFiles()) <= 2  # one bucket's files


def test_of_several_rows_the_last_counts_and_null_keeps(spark, kept):
    rows = spark.createDataFrame([("x", 1.0, "a", None), ("x", 3.0, None, 5.0), ("x", 2.0, "b", 4.0)], "session_id string, created_at double, profile string, final_score double")
    kept.write({"sessions": (rows, "created_at")})
    r = kept.of("sessions", "x").first()
    assert (r.created_at, r.profile, r.final_score) == (3.0, "b", 5.0)


def test_a_tagged_write_is_done_once(spark, kept):
    row = sessions(spark, ["s1"], created_at=8.0, band="HIGH", score=90.0)
    assert kept.write(appends={"alerts": row}, tag=("q", 4)) is not None
    assert kept.write(appends={"alerts": row}, tag=("q", 4)) is None and kept.write(appends={"alerts": row}, tag=("q", 3)) is None
    assert kept.counts()["alerts"] == 501 and kept.write(appends={"alerts": row}, tag=("other", 0)) is not None


def test_a_crash_between_tables_leaves_one_version(spark, kept, monkeypatch):
    versions, counts = kept.versions(), kept.counts()
    monkeypatch.setattr(K.Kept, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        kept.write({"sessions": (sessions(spark, ["new"], created_at=1.0), "created_at")}, {"alerts": sessions(spark, ["new"], created_at=1.0)})
    with pytest.raises(OSError, match="gone"):
        kept.erase(sessions(spark, ["s3"]))
    monkeypatch.undo()
    assert kept.versions() == versions and kept.counts() == counts
    assert kept.vacuum() >= 3 and kept.counts() == counts and kept.vacuum() == 0


def test_erasure_takes_all_tables_at_once(spark, kept):
    parts = {n: {b: list(f) for b, f in held.items()} for n, held in kept.manifest()["tables"].items()}
    before = kept.versions()
    assert kept.erase(sessions(spark, ["s3", "s4", "s1999", "nobody"])) == {"sessions": 3, "assessments": 2, "alerts": 2}
    assert len(kept.versions()) == len(before) + 1 and kept.counts() == {"sessions": 1997, "assessments": 498, "alerts": 498}
    assert kept.of("sessions", "s3", "s1999").count() == 0 and kept.of("sessions", "s5").count() == 1
    after = kept.manifest()["tables"]
    for n, most in (("sessions", 3), ("assessments", 2), ("alerts", 2)):
        assert 0 < sum(after[n][b] != parts[n][b] for b in parts[n]) <= most
    assert kept.read("sessions", version=before[-1]).count() == 2000  # the version before is whole until it is vacuumed
    kept.vacuum()
    assert kept.erase(sessions(spark, ["s3"])) == {"sessions": 0, "assessments": 0, "alerts": 0}
    assert K.Kept(spark, kept.path + "-none").erase(sessions(spark, ["s3"])) == {"sessions": 0, "assessments": 0, "alerts": 0}


def test_appends_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "PARTS", 3)
    k = K.Kept(spark, str(tmp_path / "k"), buckets=2)
    for n in range(8):
        k.write(appends={"alerts": sessions(spark, [f"s{m}" for m in range(6)], created_at=float(n))})
    assert k.counts()["alerts"] == 48 and max(map(len, k.manifest()["tables"]["alerts"].values())) <= 3


def test_a_second_writer_fails(spark, kept, monkeypatch):
    there = kept.versions()
    monkeypatch.setattr(kept, "versions", lambda: there[:-1])
    with pytest.raises(RuntimeError, match="another"):
        kept.write(appends={"alerts": sessions(spark, ["s1"], created_at=1.0)})


def test_live_calls_are_recorded(spark, tmp_path):
    """Micro-batches of a live query into the kept tables; a batch that is tried again changes nothing."""
    rows = [r for r in events() if r[0] in "ad"]
    got = streamed(spark, tmp_path, [rows[:6], rows[6:]])
    k = K.Kept(spark, str(tmp_path / "kept"), buckets=4)
    parts = [spark.createDataFrame(got[got["at"] <= rows[5][2]].astype(object).where(got.notna(), None), C.OUT), spark.createDataFrame(got[got["at"] > rows[5][2]].astype(object).where(got.notna(), None), C.OUT)]
    for n, part in ((0, parts[0]), (1, parts[1]), (1, parts[1])):
        K.record(k, part, n, salt="salt")
    assert k.counts() == {"sessions": 2, "assessments": int((got.kind == "window").sum()), "alerts": int((got.kind == "alert").sum())}
    a = k.of("sessions", "a").first()
    report = json.loads(got[(got.kind == "closed") & (got.session_id == "a")].payload.iloc[0])
    assert (a.verdict, a.final_score, a.peak_score, a.profile) == (report["verdict"], report["final_score"], report["peak_score"], "privileged_access") and a.closed_at and json.loads(a.report) == report
    assert json.loads(a.call_context)["claimed_role"] == HOSTILE["claimed_role"] and len(a.identity) == 64
    w = k.of("assessments", "a").orderBy("window_index").collect()
    assert [json.loads(x.layers)[0]["layer"] for x in w] == ["acoustic"] * len(w) and all(x.features is None for x in w)
    assert k.erase(sessions(spark, ["a"]))["assessments"] == len(w) and k.counts()["sessions"] == 1
