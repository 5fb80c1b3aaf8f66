"""Corpora of labelled recordings: manifests, folders, protocol files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

UTTERANCE = T.StructType([T.StructField(n, t) for n, t in (
    ("path", T.StringType()), ("label", T.StringType()), ("speaker_id", T.StringType()), ("method", T.StringType()),
    ("language", T.StringType()), ("duration", T.DoubleType()), ("condition", T.StringType()), ("seed", T.LongType()),
)])
# fixed values: folder names that mean genuine and synthetic speech
GENUINE_FOLDERS = ["bonafide", "bona_fide", "genuine", "real", "human"]
SPOOF_FOLDERS = ["spoof", "synthetic", "fake", "clone", "tts", "deepfake"]
# fixed values: names of protocol files
PROTOCOL_FILES = ["*cm_protocol*.txt", "*.trn.txt", "*trial_metadata*.txt", "*.trl.txt"]
AUDIO_GLOB = "*.{wav,flac,ogg,mp3,m4a}"


def _not_empty(rows: DataFrame, root: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no labelled recordings under {root}")
    return rows


def from_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each entry of ``utterances`` in manifest.json."""
    whole = spark.read.schema(T.StructType([T.StructField("utterances", T.ArrayType(UTTERANCE))])).option("multiLine", True).json(f"{root}/manifest.json")
    return whole.select(F.inline("utterances"))


def from_folders(spark: SparkSession, root: str) -> DataFrame:
    """Label from the first folder below ``root``; speaker from the next one, which for synthetic
    speech also names the method. Without it both are unknown; genuine speech is human."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", AUDIO_GLOB).load(root).select("path")
    rest = F.split(F.element_at(F.split("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", 2), 2), "/")
    nested = F.when(F.size(rest) > 2, rest[1]).otherwise("unknown")
    label = F.when(rest[0].isin(*GENUINE_FOLDERS), "bonafide").when(rest[0].isin(*SPOOF_FOLDERS), "spoof")
    return files.select("path", label.alias("label"), nested.alias("speaker_id"), F.when(label == "bonafide", "human").otherwise(nested).alias("method")).filter("label is not null")


def _lines(spark: SparkSession, protocol: str) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    between = F.slice(part, 3, F.greatest(F.size(part) - 3, F.lit(0)))
    lines = spark.read.text(protocol).select(part.alias("p"), F.get(F.filter(between, lambda x: x.startswith("A")), F.lit(0)).alias("method")).filter(F.size("p") >= 3)
    label = F.element_at("p", -1)
    return lines.select(F.col("p")[0].alias("speaker_id"), F.col("p")[1].alias("utterance"), label.alias("label"), F.coalesce("method", F.when(label == "bonafide", "human").otherwise("unknown")).alias("method"))


def _recordings(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", AUDIO_GLOB).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("utterance"))


def from_protocol(spark: SparkSession, root: str, protocol: str) -> DataFrame:
    """White-space separated lines: speaker, utterance, ..., label last, attack the first field
    in between that starts with A. Lines without a recording are dropped (``missing`` has them)."""
    return _lines(spark, protocol).join(_recordings(spark, root), "utterance").select("path", "label", "speaker_id", "method", "utterance")


def missing(spark: SparkSession, root: str, protocol: str) -> DataFrame:
    """The protocol's lines for which no recording lies below ``root``."""
    return _lines(spark, protocol).join(_recordings(spark, root), "utterance", "left_anti")


def protocols(spark: SparkSession, root: str) -> list[str]:
    """Protocol files below ``root``, at any depth, in order of their paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(PROTOCOL_FILES) + "}").load(root)
    return [r[0] for r in found.select("path").orderBy("path").collect()]


def load(spark: SparkSession, root: str, layout: str = "auto", protocol: str | None = None) -> DataFrame:
    """One of the three layouts; ``auto`` takes a protocol if named, then a manifest, then a
    protocol that lies there, then folders."""
    if layout == "auto":
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")
        manifest = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        layout = "protocol" if protocol else "manifest" if manifest else "protocol" if protocols(spark, root) else "folders"
    if layout == "manifest":
        return _not_empty(from_manifest(spark, root), root)
    if layout == "protocol":
        there = [protocol] if protocol else protocols(spark, root)
        if not there:
            raise ValueError(f"no protocol file under {root}")
        return _not_empty(from_protocol(spark, root, there[0]), root)
    return _not_empty(from_folders(spark, root), root)


def corpus_features(rows: DataFrame, max_windows: int = 8, min_seconds: float = 1.0) -> DataFrame:
    """Features of every recording's first windows: the columns of ``rows`` (path, label, ...),
    window_index, ``features``, ``embedding`` and ``vector`` in the order of ``feature_names``.

    Recordings that cannot be read or are shorter than ``min_seconds`` give no rows, windows
    without speech neither. Recordings are read where they lie, windows by seek: no path passes
    the driver, no content is moved and no more than a few windows are in memory.
    """
    from ..operators.features import extract, feature_names, vector
    from .recorded import windows

    w = windows(rows, max_windows, min_seconds)
    language = "language" if "language" in rows.columns else None
    out = extract(w, [*rows.columns, "window_index"], language=language)
    return out.filter(F.col("features")["speech_ratio"] > 0).withColumn("vector", vector(F.col("features"), feature_names()))


def summary(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by the first two columns, each alone, and in all, with distinct values of the third."""
    a, b, c = columns
    return rows.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"), F.count_distinct(c).alias("lengths"), F.grouping(a).cast("long").alias("no_lang"), F.grouping(b).cast("long").alias("no_source"))


def cache_key(rows: DataFrame, version: str) -> DataFrame:
    """A name for a corpus that changes with any path, label or time of change: hashes of the
    rows are combined without gathering them."""
    h = F.xxhash64("path", "label", "mtime")
    return rows.agg(F.substring(F.sha2(F.concat_ws(":", F.lit(version), F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)), 256), 1, 20).alias("key"))
