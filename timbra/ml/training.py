"""Classifiers over window features: pipelines, held-out evaluation, unseen methods."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M

KINDS = ("gradient_boosting", "random_forest", "logistic", "mlp")


def build(names: list[str], kind: str = "gradient_boosting", seed: int = 7, size: int | None = None) -> Pipeline:
    """Assembler, scaler where the model needs one, classifier. ``size`` shrinks the ensemble."""
    inputs = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
    if kind == "gradient_boosting":
        return Pipeline(stages=[inputs, GBTClassifier(featuresCol="raw", labelCol="y", maxIter=size or 250, stepSize=0.08, maxDepth=3, subsamplingRate=0.85, seed=seed)])
    if kind == "random_forest":
        return Pipeline(stages=[inputs, RandomForestClassifier(featuresCol="raw", labelCol="y", numTrees=size or 300, seed=seed)])
    if kind == "logistic":
        return Pipeline(stages=[inputs, scale, LogisticRegression(featuresCol="scaled", labelCol="y")])
    if kind == "mlp":
        return Pipeline(stages=[inputs, scale, MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", layers=[len(names), 128, 64, 2], seed=seed)])
    raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def aligned(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns that the model wants: missing ones are 0, others are dropped from view."""
    return rows.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in names})


def importances(model: PipelineModel, names: list[str], top: int = 25) -> dict[str, float]:
    found = getattr(model.stages[-1], "featureImportances", None)
    if found is None:
        return {}
    pairs = sorted(zip(names, found.toArray().tolist(), strict=True), key=lambda p: -p[1])[:top]
    total = sum(v for _, v in pairs) or 1.0
    return {n: v / total for n, v in pairs}


def train(rows: DataFrame, names: list[str], kind: str = "gradient_boosting", speaker: str = "speaker", seed: int = 7, size: int | None = None) -> tuple[PipelineModel, tuple[float, float], dict[str, float]]:
    """(model, calibration, held-out figures): no speaker is on both sides, nor in the split
    that fits the calibration."""
    split = M.split_by_speaker(aligned(rows, names), speaker, 0.3, seed)
    rest = M.split_by_speaker(split.filter(~F.col("is_test")).drop("is_test"), speaker, 0.25, seed + 1)
    model = build(names, kind, seed, size).fit(rest.filter(~F.col("is_test")))
    calibration = M.platt(predict(model, rest.filter("is_test")).select("y", "score"))
    held = predict(model, split.filter("is_test")).select("y", M.calibrated(F.col("score"), *calibration).alias("score"))
    figures = M.confusion(held).join(M.auc(held).select("auc")).join(M.eer(M.roc(held))).first().asDict()
    return model, calibration, figures


def unseen_methods(rows: DataFrame, names: list[str], kind: str = "logistic", seed: int = 7, size: int | None = None) -> dict[str, dict[str, float]]:
    """For each synthetic method: a model that never saw it, judged on it and the genuine rows."""
    out = {}
    for (method,) in rows.filter("y = 1").select("method").distinct().collect():
        fit, test = M.holdout_method(aligned(rows, names), method)
        scored = predict(build(names, kind, seed, size).fit(fit), test).select("y", "score", "method")
        out[method] = {"eer": M.eer(M.roc(scored)).first()["eer"], "detection": scored.filter("y = 1").agg(F.avg((F.col("score") >= 0.5).cast("double"))).first()[0]}
    return out
