"""Retention, erasure and anonymised storage. Tables are rewritten as filters over what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import anonymize_map, redact


def feature_ttl(ttl_seconds: float, raw_ttl_seconds: float) -> float:
    """Feature vectors live shorter than scores."""
    return min(ttl_seconds, max(4 * raw_ttl_seconds, 3600))


def swept(assessments: DataFrame, alerts: DataFrame, sessions: DataFrame, now: float, ttl_seconds: float, raw_ttl_seconds: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a sweep at ``now`` leaves: old rows go, open sessions stay, old features become null."""
    cut, feature_cut = now - ttl_seconds, now - feature_ttl(ttl_seconds, raw_ttl_seconds)
    a = assessments.filter(F.col("created_at") >= cut)
    if "features" in a.columns:
        a = a.withColumn("features", F.when(F.col("created_at") >= feature_cut, F.col("features")))
    return a, alerts.filter(F.col("created_at") >= cut), sessions.filter((F.col("created_at") >= cut) | F.col("closed_at").isNull())


def sweep_counts(assessments: DataFrame, now: float, ttl_seconds: float, raw_ttl_seconds: float) -> DataFrame:
    cut, feature_cut = now - ttl_seconds, now - feature_ttl(ttl_seconds, raw_ttl_seconds)
    return assessments.agg(F.count_if(F.col("created_at") < cut).alias("assessments"), F.count_if(F.col("features").isNotNull() & (F.col("created_at") >= cut) & (F.col("created_at") < feature_cut)).alias("feature_blobs"))


def purged(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def erasure_counts(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """How many rows of each table an erasure takes."""
    parts = [t.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored_sessions(sessions: DataFrame, salt: str, store_pii: bool = False) -> DataFrame:
    return sessions.withColumn("call_context", F.to_json(anonymize_map(F.col("call_context"), salt, store_pii)))


def redacted(rows: DataFrame, column: str, max_chars: int = 0) -> DataFrame:
    return rows.withColumn(column, redact(F.col(column), max_chars))
