"""Detection metrics: ranks, curves, rates, quantiles, leakage and calibration.

Inputs are (y, score) rows, y 1 for synthetic. Sums over distinct scores come first, so
running totals go over distinct scores only; ``by`` columns keep groups apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import logit, sigmoid
from .prefix import quantiles, running


def score_counts(rows: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    return rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def auc(rows: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    """Area under the curve with average ranks for ties; 0.5 where a class is missing."""
    c = running(score_counts(rows, by, score), by, "score", ["neg"])
    sums = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / F.col("n_pos") / F.col("n_neg")).otherwise(0.5).alias("auc"), "n_pos", "n_neg")


def roc(rows: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    """A point for each distinct score, from the highest, after the point that flags nothing
    (threshold null): threshold, fpr, tpr."""
    c = running(score_counts(rows, by, score), by, "score", ["neg", "pos"])
    share = lambda v: (F.col(f"all_{v}") - F.col(f"before_{v}")) / F.greatest(F.col(f"all_{v}"), F.lit(1))
    p = c.select(*by, F.col("score").alias("threshold"), share("neg").alias("fpr"), share("pos").alias("tpr"))
    start = c.select(*by).distinct() if by else c.limit(1).select()
    return p.unionByName(start.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def eer(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """Where false alarms and misses cross, interpolated at the first change of sign; a
    threshold without bound gives way to its finite neighbour."""
    d = points.withColumn("d", F.col("fpr") - 1 + F.col("tpr"))
    # d rises as the threshold falls: the last point below 0 and the first that is not
    key = F.coalesce("threshold", F.lit(float("inf")))
    point, low = F.struct("d", "fpr", "threshold"), F.col("d") < 0
    ends = d.groupBy(*by).agg(F.min_by(F.when(low, point), F.when(low, key)).alias("a"), F.max_by(F.when(~low, point), F.when(~low, key)).alias("b"))
    first = ends.select(*by, F.struct(F.col("a.d").alias("d"), F.col("b.d").alias("next_d"), F.col("a.fpr").alias("fpr"), F.col("b.fpr").alias("next_fpr"), F.col("a.threshold").alias("threshold"), F.col("b.threshold").alias("next_threshold")).alias("x"))
    t = F.when(F.col("x.next_d") == F.col("x.d"), 0.0).otherwise(-F.col("x.d") / (F.col("x.next_d") - F.col("x.d")))
    value = F.col("x.fpr") + t * (F.col("x.next_fpr") - F.col("x.fpr"))
    at = F.when(F.col("x.threshold").isNull(), F.col("x.next_threshold")).otherwise(F.col("x.threshold") + t * (F.col("x.next_threshold") - F.col("x.threshold")))
    return first.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("eer"), at.alias("eer_threshold"))


def confusion(rows: DataFrame, by: list[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    c = rows.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    n = F.greatest(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.lit(1))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.select("*", ((F.col("tp") + F.col("tn")) / n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).alias("f1"))


def threshold_rates(rows: DataFrame, thresholds=(0.35, 0.50, 0.60, 0.80)) -> DataFrame:
    """threshold, fpr, tpr: one pass, a pair of sums for each threshold."""
    share = lambda y, t: (F.count_if((F.col("score") >= t) & (F.col("y") == y)) / F.greatest(F.count_if(F.col("y") == y), F.lit(1)))
    cells = [F.struct(F.lit(t).alias("threshold"), share(0, t).alias("fpr"), share(1, t).alias("tpr")) for t in thresholds]
    return rows.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def method_breakdown(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rate of flags, count and mean score of the genuine rows and of each method's others."""
    name = F.when(F.col("y") == 0, "bonafide").otherwise(F.col("method"))
    return rows.groupBy(name.alias("method")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)).alias("flag_rate"), F.avg("score").alias("mean_score"))


def utterance_scores(windows: DataFrame, utterance: str, q: float = 0.75) -> DataFrame:
    """An exact interpolated quantile of each utterance's window scores, its label and method."""
    return windows.groupBy(utterance).agg(F.percentile("score", q).alias("score"), F.first("y").alias("y"), F.first("method").alias("method"))


def leakage(rows: DataFrame, features: list[str], threshold: float = 0.90) -> DataFrame:
    """Features that alone separate the classes by ``threshold`` or more; constant ones and
    those with values that are not finite are left out."""
    long = rows.select("y", *[F.col(f).cast("double").alias(f) for f in features]).unpivot("y", features, "feature", "score")
    ok = long.groupBy("feature").agg(F.stddev_pop("score").alias("sd"), F.bool_and(~F.isnan("score") & (F.abs("score") < float("inf"))).alias("finite"), F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("genuine_mean"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("spoof_mean"))
    out = auc(long, ["feature"]).join(ok.filter("finite and sd >= 1e-12"), "feature")
    oriented = F.greatest("auc", 1 - F.col("auc"))
    return out.filter(oriented >= threshold).select("feature", oriented.alias("auc"), F.when(F.col("auc") > 0.5, "higher_in_spoof").otherwise("higher_in_genuine").alias("direction"), "genuine_mean", "spoof_mean")


def fitted_rules(values: DataFrame, rules: DataFrame, low_tail: float = 0.25, high_tail: float = 0.02, min_samples: int = 40, min_auc: float = 0.55) -> DataFrame:
    """Anchors at tails of the genuine values (feature, y, value), weights by separation.

    Rules with few samples or no spread keep their defaults; rules that separate too little
    are marked pruned with weight 0.
    """
    up = F.col("high") > F.col("low")
    tails = [low_tail, high_tail, 1 - low_tail, 1 - high_tail]
    fine = values.filter(~F.isnan("value") & (F.abs("value") < float("inf")))
    q = quantiles(fine.filter("y = 0"), ["feature"], "value", tails)
    a = auc(fine.select("feature", "y", F.col("value").alias("score")), ["feature"])
    r = rules.join(q, "feature", "left").join(a, "feature", "left")
    at = lambda i, j: F.when(up, F.get("q", F.lit(j))).otherwise(F.get("q", F.lit(i)))
    low, high = at(0, 2), at(1, 3)
    few, flat = F.coalesce(F.col("samples"), F.lit(0)) < min_samples, F.abs(high - low) < 1e-9
    thin = (F.coalesce(F.col("n_pos"), F.lit(0)) < 5) | (F.coalesce(F.col("n_neg"), F.lit(0)) < 5)
    own = F.when(thin, 0.5).when(up, F.col("auc")).otherwise(1 - F.col("auc"))
    keep = few | flat
    action = F.when(few, "kept defaults (too few samples)").when(flat, "kept defaults (no spread in genuine speech)").when(own < min_auc, "pruned").otherwise("refitted")
    weight = F.when(keep, F.col("weight")).when(own < min_auc, 0.0).otherwise(F.col("weight") * F.least(F.greatest(0.6 + 1.6 * (own - 0.5), F.lit(0.6)), F.lit(1.6)))
    return r.select("feature", action.alias("action"), F.when(keep, F.col("low")).otherwise(low).alias("fitted_low"), F.when(keep, F.col("high")).otherwise(high).alias("fitted_high"), weight.alias("fitted_weight"), F.coalesce("samples", F.lit(0)).alias("samples"), F.when(~keep, own).alias("auc"))


def platt(rows: DataFrame, steps: int = 200, rate: float = 0.15, clip: float = 1e-6, bins: int = 4096) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit(score) + b) by gradient steps on the log loss. The rows are
    first summed into ``bins`` equal steps of the logit, a bounded table whatever the input."""
    import numpy as np

    z = logit(F.col("score"), clip)
    edge = float(np.log((1 - clip) / clip))
    k = F.floor((z + edge) / (2 * edge) * bins)
    t = rows.groupBy(k.alias("k")).agg(F.avg(z).alias("z"), F.count("*").alias("n"), F.sum("y").alias("pos")).toPandas()
    a, b, n = 1.0, 0.0, float(t["n"].sum())
    if not n:
        return a, b
    z, n_z, pos = t["z"].to_numpy(float), t["n"].to_numpy(float), t["pos"].to_numpy(float)
    for _ in range(steps):
        error = n_z / (1 + np.exp(-np.clip(a * z + b, -60, 60))) - pos
        a, b = a - rate * float((error * z).sum()) / n, b - rate * float(error.sum()) / n
    return a, b


def calibrated(score: Column, a: float, b: float) -> Column:
    return sigmoid(a * logit(score) + b)


def latency_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """p50 (median), p95 and p99 (by position), mean and max."""
    own = rows.select(F.col(value).cast("double").alias("v"))
    c = running(own.groupBy("v").agg(F.count("*").alias("c")), [], "v", ["c"])
    at = lambda q: F.max(F.when((F.col("before_c") <= F.floor(F.col("all_c") * q)) & (F.floor(F.col("all_c") * q) < F.col("before_c") + F.col("c")), F.col("v")))
    some = c.agg(at(0.95).alias("p95"), at(0.99).alias("p99"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.max("v").alias("max"))
    return quantiles(own, [], "v", [0.5]).select(F.get("q", F.lit(0)).alias("p50")).join(some)


def split_by_speaker(rows: DataFrame, speaker: str = "speaker", test_fraction: float = 0.3, seed: int = 7) -> DataFrame:
    """Add ``is_test``: whole speakers, the first share of them in a seeded order."""
    names = rows.select(speaker).distinct()
    n = names.count()
    few = names.orderBy(F.xxhash64(F.lit(seed), speaker)).limit(max(1, round(n * test_fraction)))
    return rows.join(few.withColumn("is_test", F.lit(True)), speaker, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def holdout_method(rows: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): one method's rows only in the test, genuine rows in both."""
    return rows.filter(F.col("method") != method), rows.filter((F.col("method") == method) | (F.col("y") == 0))
