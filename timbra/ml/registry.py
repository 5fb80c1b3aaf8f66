"""Trained models as stored bundles, what takes their place, and what they say of a window."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import let
from ..operators import metrics as M
from ..operators import scoring as S
from .training import aligned, predict

FORMAT = 1


@dataclass
class Bundle:
    """A fitted model and what is needed to use it on any window."""

    model: PipelineModel
    feature_names: list[str]
    model_id: str = "acoustic-model"
    calibration: tuple[float, float] = (1.0, 0.0)
    importances: dict[str, float] = field(default_factory=dict)
    fusion_weights: dict[str, float] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    format: int = FORMAT


def save(bundle: Bundle, path: str, spark: SparkSession) -> None:
    """The model in Spark's own format, the rest as one line of JSON beside it."""
    facts = {n: getattr(bundle, n) for n in ("feature_names", "model_id", "calibration", "importances", "fusion_weights", "metrics", "format")}
    bundle.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark: SparkSession, path: str) -> tuple[Bundle | None, list[str]]:
    """(bundle, what is amiss). Without a readable bundle there is none, and the rules alone
    judge; an older format is used, with a warning."""
    try:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        model = PipelineModel.load(f"{path}/model")
        bundle = Bundle(model, list(facts["feature_names"]), facts.get("model_id", "acoustic-model"), tuple(facts.get("calibration", (1.0, 0.0))), dict(facts.get("importances", {})), dict(facts.get("fusion_weights", {})), dict(facts.get("metrics", {})), int(facts.get("format", FORMAT)))
    except Exception as e:  # whatever is wrong with it, calls must go on being judged
        return None, [f"no usable model at {path} ({type(e).__name__}); the rules judge alone"]
    return bundle, [] if bundle.format == FORMAT else [f"model format {bundle.format} is not {FORMAT}; train again"]


def explained(factors: Column, importances: dict[str, float]) -> Column:
    """A window's rule factors as the model's reasons: those of features that weigh in the model
    count for more, shares sum to one, the largest first."""
    lift = F.create_map(*[F.lit(x) for kv in importances.items() for x in kv]) if importances else F.create_map().cast("map<string,double>")
    raised = F.transform(factors, lambda f: f.withField("contribution", f["contribution"] * (1 + F.coalesce(F.try_element_at(lift, f["code"]), F.lit(0.0)))))
    order = lambda a, b: F.signum(b["contribution"] - a["contribution"]).cast("int")

    def shares(rows: Column, total: Column) -> Column:
        return F.array_sort(F.transform(rows, lambda f: f.withField("contribution", F.when(total == 0, f["contribution"]).otherwise(f["contribution"] / total))), order)

    return let(raised, lambda rows: let(F.aggregate(rows, F.lit(0.0), lambda a, f: a + f["contribution"]), lambda total: shares(rows, total)))


def acoustic_layer(rows: DataFrame, bundle: Bundle | None, layer: str = "own") -> DataFrame:
    """``rows`` (a map ``features``, and the rules' verdict as the struct ``layer``: score,
    confidence, factors) with that struct replaced by the model's: the calibrated probability
    blended with the rules' score, their factors as reasons. Without a bundle the rules'
    verdict stays, its confidence capped. Adds ``heuristic``."""
    own = F.col(layer)
    if bundle is None:
        return rows.withColumn(layer, own.withField("confidence", S.acoustic_confidence(own["confidence"]))).withColumn("heuristic", F.lit(True))
    columns = rows.columns
    wide = rows.withColumns({f"__f{k}": F.try_element_at("features", F.lit(n)) for k, n in enumerate(bundle.feature_names)})
    named = aligned(wide.withColumnsRenamed({f"__f{k}": n for k, n in enumerate(bundle.feature_names)}), bundle.feature_names)
    p = M.calibrated(F.col("score"), *bundle.calibration)
    blended = F.when(own["confidence"] > 0, S.blended(p, own["score"])).otherwise(p)
    verdict = F.struct(blended.alias("score"), F.lit(0.95).alias("confidence"), explained(own["factors"], bundle.importances).alias("factors"))
    return predict(bundle.model, named).withColumn(layer, verdict).select(*columns).withColumn("heuristic", F.lit(False))


def full_stack(windows: DataFrame, call: str = "session_id", order: str = "window_index", calibration: tuple[float, float] = (1.0, 0.0), threshold: float = 0.5) -> dict[str, float]:
    """Whole calls through the whole chain: (call, order, layers, y) windows are fused, smoothed
    and judged by their call's highest score. Accuracy, precision, recall, F1, AUC and EER of
    the calls."""
    fused = windows.select(call, order, "y", S.score_100(S.fuse(F.col("layers"), calibration)["probability"]).alias("score"))
    peaks = S.smoothed(fused, call, order, "score").groupBy(call).agg((F.max("smoothed") / 100).alias("score"))
    rows = peaks.join(fused.groupBy(call).agg(F.max("y").alias("y")), call)
    figures = M.confusion(rows, threshold=threshold).join(M.auc(rows).select("auc")).join(M.eer(M.roc(rows)))
    return figures.first().asDict()


def fit_summary(fitted: DataFrame) -> str:
    """Of ``fitted_rules``: how many rules were refitted, pruned and kept, which were pruned, and
    the five that tell the classes apart best."""
    names = F.collect_list(F.when(F.startswith("action", F.lit("pruned")), F.col("feature")))
    n = lambda start: F.count_if(F.startswith("action", F.lit(start)))
    r = fitted.agg(n("refitted"), n("pruned"), n("kept"), F.array_sort(names), *([F.slice(F.array_sort(F.collect_list(F.when(F.col("auc").isNotNull(), F.struct((-F.col("auc")).alias("k"), "feature")))), 1, 5)] if "auc" in fitted.columns else [])).first()
    best = "".join(f"\n  {x.feature:28s} AUC {-x.k:.3f}" for x in (r[4] if len(r) > 4 else []))
    return f"refitted: {r[0]}   pruned: {r[1]}   defaults kept: {r[2]}" + (f"\npruned rules: {', '.join(r[3])}" if r[3] else "") + (f"\nmost discriminative rules:{best}" if best else "")
