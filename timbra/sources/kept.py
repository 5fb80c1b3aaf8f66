"""Kept tables of calls: sessions, assessments and alerts that are upserted, appended to and erased.

Rows lie in buckets by a hash of their key. A write makes new files for the buckets it touches
and then one manifest, which names the files of every bucket of all tables: a reader sees a whole
version or the one before. A write that breaks off before its manifest leaves files that no
version names, and ``vacuum`` takes them. A tagged write that is tried again is done once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that a bucket may have before an append writes it anew.
PARTS = 16
#: The tables of calls, and the columns that name a row.
CALLS = {
    "sessions": ("session_id string, created_at double, closed_at double, profile string, language string, identity string, verdict string, final_score double, peak_score double, duration_seconds double, call_context string, report string", ["session_id"]),
    "assessments": ("session_id string, created_at double, window_index long, score double, band string, confidence double, factors string, layers string, features string, audio_sha256 string", ["session_id", "window_index"]),
    "alerts": ("session_id string, created_at double, band string, score double, payload string", ["session_id", "created_at"]),
}


class Kept:
    """``tables`` maps a name to its columns and key columns; the first key column decides the
    bucket, so rows of one call lie in one bucket of each table. One writer at a time: a second
    one fails at its manifest and may try again."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]] | None = None, buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path, tables or CALLS, buckets

    # -- files -------------------------------------------------------------------------------

    def _place(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        there, fs = self._place(path)
        return [x.getPath().getName() for x in fs.listStatus(there)] if fs.exists(there) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: {bucket: [folder, ...]}}, "tags": {stream: last number}}."""
        there = self.versions()
        if not there:
            return {"tables": {n: {} for n in self.tables}, "tags": {}}
        path, fs = self._place(f"{self.path}/manifests/{there[-1] if version is None else version}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Write the next version; fails if it is there already."""
        number = (self.versions() or [-1])[-1] + 1
        path, fs = self._place(f"{self.path}/manifests/{number}")
        part, _ = self._place(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(part, path):
            fs.delete(part, False)
            raise RuntimeError(f"version {number} was written by another; try again")
        return number

    # -- rows --------------------------------------------------------------------------------

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` as the table's columns; what they lack is null, what is not its is left out."""
        fields = [x.split(" ", 1) for x in self.tables[name][0].split(", ")]
        return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])

    def _bucketed(self, name: str, rows: DataFrame) -> DataFrame:
        return self._shaped(name, rows).withColumn("bucket", self._bucket(self.tables[name][1][0]))

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _merged(self, name: str, before: DataFrame, rows: DataFrame, order: str) -> DataFrame:
        keys = self.tables[name][1]
        fields = [c for c in before.columns if c not in keys]
        at = F.coalesce(F.col(order).cast("double"), F.lit(0.0))
        last = rows.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields if c in rows.columns])
        was = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
        both = was.join(last, keys, "full")
        return both.select(*keys, *[F.coalesce(c, f"__{c}").alias(c) if c in rows.columns else F.col(f"__{c}").alias(c) for c in fields])

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets, as of a version (the last)."""
        ddl = self.tables[name][0]
        held = self.manifest(version)["tables"].get(name, {})
        paths = [f"{self.path}/data/{name}/{folder}/bucket={b}" for b, folders in held.items() if buckets is None or int(b) in buckets for folder in folders]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def of(self, name: str, *keys: str) -> DataFrame:
        """The rows of some calls: only their buckets are read."""
        key = self.tables[name][1][0]
        own = self._touched(self.spark.createDataFrame([(k,) for k in keys], f"{key} string").withColumn("bucket", self._bucket(key)))
        return self.read(name, own).filter(F.col(key).isin(*keys))

    def _written(self, name: str, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{name}/{folder}")
        return folder

    def write(self, upserts: dict[str, tuple[DataFrame, str]] | None = None, appends: dict[str, DataFrame] | None = None, tag: tuple[str, int] | None = None) -> int | None:
        """One version with all of it. ``upserts``: name to (rows, order column): rows in place of
        those with their keys, of several the last by the order; what a new row leaves null keeps
        its value. ``appends``: name to rows. A ``tag`` (stream, number) not above the stream's
        last one has been written: nothing happens."""
        manifest = self.manifest()
        if tag and manifest["tags"].get(tag[0], -1) >= tag[1]:
            return None
        for name, (rows, order) in (upserts or {}).items():
            touched = self._touched(self._bucketed(name, rows))
            if not touched:
                continue
            folder = self._written(name, self._bucketed(name, self._merged(name, self.read(name, touched), rows, order)))
            manifest["tables"].setdefault(name, {}).update({str(b): [folder] for b in touched})
        for name, rows in (appends or {}).items():
            new = self._bucketed(name, rows)
            touched = self._touched(new)
            if not touched:
                continue
            held = manifest["tables"].setdefault(name, {})
            full = [b for b in touched if len(held.get(str(b), [])) >= PARTS]
            folder = self._written(name, new.unionByName(self._bucketed(name, self.read(name, full))) if full else new)
            held.update({str(b): [*([] if b in full else held.get(str(b), [])), folder] for b in touched})
        if tag:
            manifest["tags"][tag[0]] = tag[1]
        return self._commit(manifest)

    def erase(self, ids: DataFrame) -> dict[str, int]:
        """Take everything of the calls ``ids`` (session_id) out of all tables at once; only their
        buckets are written anew. How many rows of each table went."""
        manifest, gone = self.manifest(), {}
        wanted = ids.select(F.col("session_id").cast("string").alias("session_id")).distinct()
        for name, (_, keys) in self.tables.items():
            touched = self._touched(wanted.withColumn("bucket", self._bucket("session_id")))
            own = self.read(name, touched)
            hit = own.join(wanted.withColumnRenamed("session_id", keys[0]), keys[0], "left_semi")
            gone[name] = hit.count()
            if gone[name]:
                mine = self._touched(self._bucketed(name, hit))
                stay = self.read(name, mine).join(wanted.withColumnRenamed("session_id", keys[0]), keys[0], "left_anti")
                stay = self._bucketed(name, stay)
                left = self._touched(stay)
                folder = self._written(name, stay)
                for b in mine:
                    manifest["tables"][name][str(b)] = [folder] if b in left else []
        if any(gone.values()):
            self._commit(manifest)
        return gone

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() for n in self.tables}

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last ``keep``, and every folder that none of those names.
        Not beside a writer: its files have no version yet."""
        there = self.versions()
        for old in there[:-keep]:
            path, fs = self._place(f"{self.path}/manifests/{old}")
            fs.delete(path, False)
        named = {(n, f) for v in there[-keep:] for n, held in self.manifest(v)["tables"].items() for folders in held.values() for f in folders}
        gone = 0
        for name in self.tables:
            for folder in self._names(f"{self.path}/data/{name}"):
                if (name, folder) not in named:
                    path, fs = self._place(f"{self.path}/data/{name}/{folder}")
                    fs.delete(path, True)
                    gone += 1
        return gone


def record(kept: Kept, rows: DataFrame, number: int, stream: str = "calls", salt: str = "", mode: str = "none") -> int | None:
    """A micro-batch of ``call.OUT`` rows into the kept tables, as one version: a session is opened
    by its first window and completed by its report, windows and alerts are appended. Context is
    anonymised; features are kept only where the retention ``mode`` allows it."""
    from ..functions.text import anonymize_map

    held = rows.persist()
    try:
        second = F.col("at") / 1e6
        closed = held.filter(F.col("kind") == "closed").withColumn("r", F.from_json("payload", "struct<created_at:bigint,profile:string,language:string,identity:string,verdict:string,final_score:double,peak_score:double,duration_seconds:double,call_context:map<string,string>>"))
        facts = F.to_json(anonymize_map(F.col("r.call_context"), salt))
        done = closed.select("session_id", (F.col("r.created_at") / 1e6).alias("created_at"), second.alias("closed_at"), "r.profile", "r.language", F.sha2(F.concat(F.lit(salt), F.col("r.identity")), 256).alias("identity"), "r.verdict", "r.final_score", "r.peak_score", "r.duration_seconds", facts.alias("call_context"), F.col("payload").alias("report"))
        opened = held.filter(F.col("kind") == "window").groupBy("session_id").agg((F.min("at") / 1e6).alias("seen"))
        known = kept.read("sessions", sorted(r[0] for r in opened.select(kept._bucket("session_id").alias("b")).distinct().collect())).select("session_id")
        fresh = opened.join(known, "session_id", "left_anti").select("session_id", F.col("seen").alias("created_at"))
        told = F.from_json("payload", "struct<factors:string,layer_summary:string,features:string,audio_sha256:string>")
        features = told["features"] if mode in ("features_only", "raw_audio") else F.lit(None).cast("string")
        windows = held.filter(F.col("kind") == "window").select("session_id", second.alias("created_at"), "window_index", "score", "band", "confidence", told["factors"].alias("factors"), told["layer_summary"].alias("layers"), features.alias("features"), told["audio_sha256"].alias("audio_sha256"))
        alerts = held.filter(F.col("kind") == "alert").select("session_id", second.alias("created_at"), "band", "score", "payload")
        sessions = done.unionByName(fresh, allowMissingColumns=True)
        return kept.write({"sessions": (sessions, "created_at")}, {"assessments": windows, "alerts": alerts}, (stream, number))
    finally:
        held.unpersist()
