"""How the driver's tables stand in for calls: shared by the queries and, word for word in
meaning, by their SQL. They exercise the operators; they say nothing about voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE_OF_EVENT = {"click": "default", "view": "wire_transfer", "signup": "contact_center", "error": "consumer", "purchase": "no such profile"}
PROFILE_OF_SEGMENT = {"AUTOMOBILE": "default", "BUILDING": "wire_transfer", "FURNITURE": "contact_center", "MACHINERY": "consumer", "HOUSEHOLD": "privileged_access"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def windows(spark: SparkSession, d: str) -> DataFrame:
    """events as windows: a user is a call, events in order are its windows."""
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("window_index"), "event_id", "ts", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "value", F.least(F.lit(100.0), F.floor(F.col("value") * 5) / 10).alias("score"),
    )


WINDOWS = """w AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS window_index, event_id, ts, event_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, least(100.0, floor(value * 5) / 10) AS score FROM events)"""


def layered(w: DataFrame) -> DataFrame:
    """Windows with ARRAY<STRUCT<layer, score, confidence>>; two layers abstain at times."""
    one = lambda name, s, c: F.struct(F.lit(name).alias("layer"), s.cast("double").alias("score"), c.cast("double").alias("confidence"))
    kind, v, k = F.col("event_type"), F.col("value"), F.col("k")
    return w.withColumn("layers", F.array(
        one("acoustic", 1 / (1 + F.exp(1 - v / 100)), 0.3 + k / 200), one("prosodic", k / 100, F.when(kind == "error", 0.0).otherwise(0.8)),
        one("speaker", F.least(F.lit(1.0), v / 400), F.when(kind.isin("click", "signup"), 0.85).otherwise(0.0)), one("context", 0.5 - k / 400, F.when(kind == "view", 0.0).otherwise(0.55)),
    ))


LAYERS = """l AS (SELECT session_id, window_index, 'acoustic' AS layer, 1 / (1 + exp(1 - value / 100)) AS score, 0.3 + k / 200 AS confidence, CAST(0.45 AS DOUBLE) AS weight FROM w
    UNION ALL SELECT session_id, window_index, 'prosodic', k / 100, CASE WHEN event_type = 'error' THEN 0.0 ELSE 0.8 END, 0.28 FROM w
    UNION ALL SELECT session_id, window_index, 'speaker', least(1.0, value / 400), CASE WHEN event_type IN ('click', 'signup') THEN 0.85 ELSE 0.0 END, 0.19 FROM w
    UNION ALL SELECT session_id, window_index, 'context', 0.5 - k / 400, CASE WHEN event_type = 'view' THEN 0.0 ELSE 0.55 END, 0.08 FROM w),
 v AS (SELECT *, CAST(weight AS DOUBLE) * CAST(confidence AS DOUBLE) AS power, ln(least(greatest(score, 1e-4), 1 - 1e-4) / (1 - least(greatest(score, 1e-4), 1 - 1e-4))) AS z FROM l),
 f AS (SELECT session_id, window_index, sum(power * z) / sum(power) AS z, sum(power) AS mass, sum(weight) AS all_weight,
    max(score) FILTER (power > 1e-9) - min(score) FILTER (power > 1e-9) AS spread, count(*) FILTER (power > 1e-9) AS voters FROM v GROUP BY ALL),
 fused AS (SELECT session_id, window_index, 1 / (1 + exp(-z)) AS probability, greatest(0.05, least(1.0, mass / all_weight * (1 - 0.35 * spread))) AS confidence, voters FROM f)"""


def smoother(source: str) -> str:
    """SQL of the smoothing recursion over ``source`` (session_id, window_index, score)."""
    return f"""s AS (SELECT session_id, window_index, score, score AS smoothed, [score] AS h FROM {source} WHERE window_index = 0
    UNION ALL SELECT session_id, window_index, score, CASE WHEN len(h) >= 3 AND held > faded THEN faded + 0.5 * (held - faded) ELSE faded END, h FROM
      (SELECT *, list_sort(h)[CAST(floor(0.8 * (len(h) - 1)) AS INTEGER) + 1] AS held FROM
        (SELECT x.session_id, x.window_index, x.score, CAST(0.35 AS DOUBLE) * x.score + CAST(0.65 AS DOUBLE) * s.smoothed AS faded, list_append(s.h, x.score)[greatest(1, len(s.h) - 6):] AS h
         FROM s JOIN {source} x ON x.session_id = s.session_id AND x.window_index = s.window_index + 1)))"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """orders as approval requests with call metadata; some facts are unknown (null)."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    segment = F.create_map(*[F.lit(x) for kv in PROFILE_OF_SEGMENT.items() for x in kv])
    third = lambda n: F.when(k % n == 0, True).when(k % n == 1, False)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        k.alias("request_id"), segment[F.col("c_mktsegment")].alias("profile"), (F.col("o_totalprice") * 10).alias("amount"), (F.col("o_custkey") % 5).alias("prior_fraud_reports"),
        third(3).alias("known_contact"), third(4).alias("caller_id_verified"), F.when(k % 7 != 0, k % 24).alias("local_hour"), (k % 150).alias("session_id"),
        F.element_at(F.array(*map(F.lit, ["pstn", "voip", "International", "", "satellite"])), (k % 5 + 1).cast("int")).alias("origin"), F.when(k % 6 == 0, "Managing Director").otherwise("clerk").alias("claimed_role"),
        F.when(k % 11 == 0, "please share the code, it is urgent").when(k % 11 == 1, "hello").alias("transcript"), F.when(k % 4 != 3, k % 60).alias("account_age_days"), (k % 2 == 0).alias("first_contact"), "o_totalprice", "o_orderdate",
    )


REQUESTS = """r AS (SELECT o_orderkey AS request_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'default' WHEN 'BUILDING' THEN 'wire_transfer' WHEN 'FURNITURE' THEN 'contact_center' WHEN 'MACHINERY' THEN 'consumer' WHEN 'HOUSEHOLD' THEN 'privileged_access' END AS profile,
    o_totalprice * 10 AS amount, o_custkey % 5 AS prior_fraud_reports, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS known_contact, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS caller_id_verified,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 24 END AS local_hour, o_orderkey % 150 AS session_id, ['pstn', 'voip', 'International', '', 'satellite'][o_orderkey % 5 + 1] AS origin,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Managing Director' ELSE 'clerk' END AS claimed_role, CASE o_orderkey % 11 WHEN 0 THEN 'please share the code, it is urgent' WHEN 1 THEN 'hello' END AS transcript,
    CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 60 END AS account_age_days, o_orderkey % 2 = 0 AS first_contact, o_totalprice, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

RAMP = "least(greatest(({v} - {a}) / ({b} - {a}), 0.0), 1.0)"


def ramp_sql(v: str, a: float, b: float) -> str:
    return RAMP.format(v=f"CAST({v} AS DOUBLE)", a=f"CAST({a!r} AS DOUBLE)", b=f"CAST({b!r} AS DOUBLE)")


SHIFT = f"""sh AS (SELECT *, greatest(least(CASE WHEN amount > 0 THEN 10 * {ramp_sql('amount', 1e5, 5e6)} ELSE 0 END + CASE WHEN prior_fraud_reports > 0 THEN 6 * {ramp_sql('prior_fraud_reports', 0.0, 3.0)} ELSE 0 END
    + CASE WHEN known_contact IS FALSE THEN 3 ELSE 0 END + CASE WHEN caller_id_verified IS FALSE THEN 3 WHEN caller_id_verified THEN -2 ELSE 0 END + CASE WHEN local_hour < 7 OR local_hour >= 21 THEN CAST(2.5 AS DOUBLE) ELSE 0 END
    - CASE WHEN known_contact AND prior_fraud_reports = 0 THEN 3 ELSE 0 END, 18.0), -18.0) AS shift FROM r)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """orders as windows with a map of feature values; some features are missing or zero."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    cores = spark.sparkContext.defaultParallelism
    if o.rdd.getNumPartitions() < cores:  # one small file would keep one core busy
        o = o.repartition(cores, "o_orderkey")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    values = {name: f(k, p) for name, f in FEATURES.items()}
    whole = F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("double"))])
    return o.select(k.alias("window_id"), F.map_filter(whole, lambda n, v: v.isNotNull()).alias("features"))


FEATURES = {
    "hf_cliff_depth_db": lambda k, p: k % 101, "hf_energy_ratio": lambda k, p: (k % 53) / 1000, "spec_rolloff95_mean": lambda k, p: p / 80, "mel_frame_corr": lambda k, p: 0.7 + (k % 31) / 100,
    "digital_silence_score": lambda k, p: (k % 17) / 20, "residual_kurtosis": lambda k, p: (k % 9) * 1.0, "residual_peakiness": lambda k, p: (k % 3) * 1.0, "spec_flatness_mean": lambda k, p: F.when(k % 4 != 0, (k % 19) / 100),
    "f0_micro_var": lambda k, p: (k % 29) / 1000, "jitter_ppq5": lambda k, p: (k % 23) / 5000, "cycle_count": lambda k, p: (k % 5) * 30.0, "pause_std": lambda k, p: (k % 13) / 60, "energy_range_db": lambda k, p: p / 20000, "period_cv": lambda k, p: F.when(k % 6 != 1, (k % 37) / 1000),
}
FEATURES_SQL = {
    "hf_cliff_depth_db": "k % 101", "hf_energy_ratio": "(k % 53) / 1000", "spec_rolloff95_mean": "p / 80", "mel_frame_corr": "CAST(0.7 AS DOUBLE) + (k % 31) / 100", "digital_silence_score": "(k % 17) / 20", "residual_kurtosis": "k % 9", "residual_peakiness": "k % 3",
    "spec_flatness_mean": "CASE WHEN k % 4 <> 0 THEN (k % 19) / 100 END", "f0_micro_var": "(k % 29) / 1000", "jitter_ppq5": "(k % 23) / 5000", "cycle_count": "(k % 5) * 30", "pause_std": "(k % 13) / 60", "energy_range_db": "p / 20000", "period_cv": "CASE WHEN k % 6 <> 1 THEN (k % 37) / 1000 END",
}
EVIDENCE = "o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), feat AS (" + " UNION ALL ".join(f"SELECT k AS window_id, '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM o" for n, e in FEATURES_SQL.items()) + ")"


def rules_sql() -> str:
    """The rules as a VALUES table, with the one required feature of each or null."""
    from .. import dims

    rows = [f"('{layer}', '{f}', {low!r}::DOUBLE, {high!r}::DOUBLE, {w!r}::DOUBLE, {repr(need[0]) if need else 'NULL'})" for layer, t in (("acoustic", dims.ACOUSTIC_RULES), ("prosodic", dims.PROSODIC_RULES)) for f, _, low, high, w, need in t]
    return "rules(layer, feature, low, high, weight, need) AS (VALUES " + ", ".join(rows) + ")"


def marks(spark: SparkSession, d: str) -> DataFrame:
    """labels joined to documents as scored rows: y, score (from the length), method, language."""
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("y"), (F.col("n_chars") % 211 / 210).alias("score"), F.col("source").alias("method"), F.col("lang").alias("language"), "n_chars", "quality")


MARKS = "m AS (SELECT l.doc_id, toxic AS y, n_chars % 211 / 210 AS score, source AS method, lang AS language, n_chars, quality FROM labels l JOIN documents USING (doc_id))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("identity"), F.col("embedding").cast("array<double>").alias("vector"))


VECTORS = "e AS (SELECT vec_id, label AS identity, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
CENTROIDS = """parts AS (SELECT identity, unnest(vector) AS v, generate_subscripts(vector, 1) AS p FROM e), means AS (SELECT identity, p, avg(v) AS m, count(*) AS n FROM parts GROUP BY ALL),
 c AS (SELECT identity, list(m / norm ORDER BY p) AS centroid, max(n) AS samples FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY identity)) AS norm FROM means) GROUP BY identity)"""
