"""Enrolment profiles and drift of speaker vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import cosine_distance, dot, ramp, sigmoid


def enrol(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Append the vectors that are not all zero."""
    return vectors.unionByName(new.filter(F.exists("vector", lambda v: v != 0)))


def stored(vectors: DataFrame) -> DataFrame:
    """Enrolments as they are kept: the vector as JSON."""
    return vectors.withColumn("vector", F.to_json("vector"))


def loaded(rows: DataFrame) -> DataFrame:
    """Kept enrolments (identity, vector as JSON) as vectors; rows that cannot be read, or are
    empty or all zero, are left out."""
    out = rows.withColumn("vector", F.from_json("vector", "array<double>"))
    return out.filter(F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0))


def forget(vectors: DataFrame, identity: str | None = None) -> DataFrame:
    """Without one identity, or without any."""
    return vectors.filter(F.col("identity") != identity) if identity is not None else vectors.filter(F.lit(False))


def identities(vectors: DataFrame) -> DataFrame:
    """Who is enrolled, with how many vectors."""
    return vectors.groupBy("identity").agg(F.count("*").alias("samples"))


def enrol_audio(vectors: DataFrame, recordings: DataFrame, samples: str = "samples") -> DataFrame:
    """Append the embedding of each recording (identity, samples at 16 kHz); those too short or
    silent give none."""
    from .features import extract

    new = extract(recordings, ["identity"], samples).select("identity", F.col("embedding").alias("vector"))
    return enrol(vectors, new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in vectors.columns]))


def centroids(vectors: DataFrame) -> DataFrame:
    """identity, centroid (mean, unit length), samples. Means are taken by position, so an
    identity with many vectors is summed up before the shuffle."""
    parts = vectors.select("identity", F.posexplode("vector").alias("p", "v")).groupBy("identity", "p").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    mean = parts.groupBy("identity").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("mean"), F.max("n").alias("samples"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return mean.select("identity", F.when(norm > 1e-12, F.transform("mean", lambda v: v / norm)).otherwise(F.col("mean")).alias("centroid"), "samples")


def spreads(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """identity, centroid, samples, spread: mean distance of the members, 0 for one member."""
    own = vectors.join(profiles, "identity").groupBy("identity").agg(F.avg(cosine_distance(F.col("vector"), F.col("centroid"))).alias("spread"))
    return profiles.join(own, "identity").withColumn("spread", F.when(F.col("samples") < 2, 0.0).otherwise(F.col("spread")))


def compare(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Windows (identity, vector) against their claimed profile; null where there is none.
    z is the distance in spreads. Spark broadcasts the profiles where they are small."""
    joined = windows.join(profiles, "identity", "left")
    d = F.when(F.col("centroid").isNotNull() & F.exists("vector", lambda v: v != 0), cosine_distance(F.col("vector"), F.col("centroid")))
    return joined.withColumn("distance", d).withColumn("similarity", 1 - F.col("distance")).withColumn("z", F.col("distance") / F.greatest("spread", F.lit(dims.MIN_SPREAD))).drop("centroid")


def drift(windows: DataFrame, session: str, order: str, history: int = dims.HISTORY) -> DataFrame:
    """Add ``drift``, the largest distance to the last ``history`` non-zero vectors of the
    call, and ``seen``, how many there were."""
    live = windows.filter(F.exists("vector", lambda v: v != 0))
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-history, -1)
    past = live.withColumn("__past", F.collect_list("vector").over(w))
    far = F.array_max(F.transform("__past", lambda v: cosine_distance(F.col("vector"), v)))
    return past.withColumn("seen", F.size("__past")).withColumn("drift", far).drop("__past")


def speaker_layer(rows: DataFrame) -> DataFrame:
    """score and confidence from distance, z, samples, spread, drift and seen; a row with
    neither an enrolment nor a past abstains with confidence 0."""
    enrolled, past = F.col("distance").isNotNull(), F.col("seen") > 0
    many = (F.col("samples") >= 3) & (F.col("spread") > dims.MIN_SPREAD)
    match = F.when(many, ramp(F.col("z"), dims.MATCH_Z, dims.MISMATCH_Z)).otherwise(ramp(F.col("distance"), dims.MATCH_DISTANCE, dims.MISMATCH_DISTANCE))
    moved = ramp(F.col("drift"), dims.DRIFT_LOW, dims.DRIFT_HIGH)
    one, other = F.when(enrolled, 1.0).otherwise(0.0), F.when(past, 0.6).otherwise(0.0)
    evidence = (F.when(enrolled, match).otherwise(0.0) + F.when(past, 0.6 * moved).otherwise(0.0)) / F.nullif(one + other, F.lit(0.0))
    trust = F.when(enrolled, F.when(F.col("samples") < 3, 0.85 * 0.75).otherwise(0.85)).otherwise(F.when(F.col("seen") < 3, 0.45 * 0.6).otherwise(0.45))
    none = ~enrolled & ~past
    return rows.withColumn("score", F.when(none, 0.5).otherwise(sigmoid(-0.9 + 3.6 * (evidence - 0.15)))).withColumn("confidence", F.when(none, 0.0).otherwise(trust))
