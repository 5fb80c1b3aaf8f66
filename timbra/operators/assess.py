"""One assessment of a window: fusion, policy, explanation and its JSON, as row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import band, let, lookup, lowered, threshold_shift
from . import scoring as S

#: Facts of a call's context that move the thresholds.
CONTEXT = ("transaction_amount", "prior_fraud_reports", "known_contact", "caller_id_verified", "local_hour")


def layer_factors(layers: Column, shares: Column) -> Column:
    """The factors of all layers, each with its layer's confidence and share of the vote."""
    share = lambda name: F.coalesce(F.get(F.filter(shares, lambda s: s["layer"] == name), F.lit(0))["share"], F.lit(0.0))
    of = lambda x: F.transform(x["factors"], lambda f: F.struct(f["code"].alias("code"), f["label"].alias("label"), f["contribution"].alias("contribution"), f["value"].alias("value"), x["confidence"].alias("confidence"), share(x["layer"]).alias("share")))
    return F.flatten(F.transform(layers, of))


def assessed(rows: DataFrame, profiles: DataFrame, score_override: str | None = None, calibration: tuple[float, float] = (1.0, 0.0), weights: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with score, band, action, probability, confidence, threshold_shift, headline,
    factors, counter_factors, layer_summary and caveats.

    ``rows`` has ``layers`` (layer, score, confidence and, where there are any, factors with
    code, label, contribution, value), and may have ``profile`` (null or unknown: the default
    one), the CONTEXT facts, ``elapsed_seconds``, ``speech_ratio`` and ``heuristic``; what is
    missing counts as unknown. ``score_override`` names a column, such as the smoothed score,
    that is shown and judged in place of the window's own.
    """
    has = lambda name, default: F.col(name) if name in rows.columns else default
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(zip(CONTEXT, ("double", "long", "boolean", "boolean", "long"), strict=True))
    facts = [has(c, null(kinds[c])) for c in CONTEXT]
    out = rows.withColumn("__fusion", S.fuse(F.col("layers"), calibration, weights)).withColumn("__shift", threshold_shift(*facts))
    limits = profiles.select(F.col("profile").alias("__profile"), "elevated", "high", "critical")
    out = out.withColumn("__profile", has("profile", F.lit("default"))).join(limits, "__profile", "left")
    default = next(p for p in dims.PROFILES if p[0] == "default")
    e, h, c = (lowered(F.coalesce(n, F.lit(v)), F.col("__shift")) for n, v in zip(("elevated", "high", "critical"), default[1:4], strict=True))
    own = S.score_100(F.col("__fusion.probability"))
    out = out.withColumn("score", F.coalesce(F.col(score_override), own) if score_override else own)
    out = out.withColumn("band", band(F.col("score"), e, h, c)).withColumn("action", lookup(F.col("band"), dims.ACTIONS, ""))
    typed = "factors" in rows.schema["layers"].dataType.elementType.names
    merged = S.merged_factors(layer_factors(F.col("layers"), F.col("__fusion.shares"))) if typed else F.array().cast("array<struct<code:string,label:string,rank:int,contribution:double,value:double>>")
    told = lambda f: F.struct(f["code"].alias("code"), f["label"].alias("label"), f["contribution"].alias("contribution"), f["value"].alias("value"), S.detail(f["code"], f["value"]).alias("detail"))
    out = out.withColumn("factors", F.transform(let(merged, S.explanation_factors), told))
    elapsed, speech = has("elapsed_seconds", F.lit(0.0)), has("speech_ratio", F.lit(1.0))
    return out.select(
        *rows.columns, *([] if "score" in rows.columns else ["score"]), "band", "action", F.col("__fusion.probability").alias("probability"), F.col("__fusion.confidence").alias("confidence"),
        F.when(F.col("elevated").isNull(), "default").otherwise(F.col("__profile")).alias("policy"), F.col("__shift").alias("threshold_shift"), S.headline(F.col("score"), F.col("band"), F.col("factors")).alias("headline"), "factors",
        S.counter_evidence(F.col("layers")).alias("counter_factors"), S.layer_summary(F.col("layers"), F.col("__fusion.shares")).alias("layer_summary"),
        S.caveats(elapsed, speech, F.col("__fusion.excluded"), F.col("__fusion.confidence"), has("heuristic", F.lit(False)), F.col("__shift")).alias("caveats"),
    )


def assessment_json(verbose: bool = False) -> Column:
    """An assessed row as JSON: figures rounded as they are shown, reasons, and either the
    layers or the whole explanation."""
    parts = [
        F.round("score", 1).alias("score"), F.col("band"), F.col("action"), F.round("probability", 4).alias("probability"), F.round("confidence", 4).alias("confidence"), F.col("policy").alias("profile"),
        F.round("threshold_shift", 2).alias("threshold_shift"), F.col("headline"), F.col("factors"), F.col("caveats"),
    ]
    if verbose:
        parts.append(F.struct("headline", "band", "action", "factors", "counter_factors", F.col("layer_summary").alias("layers"), "caveats").alias("explanation"))
    else:
        parts.append(F.col("layer_summary").alias("layers"))
    return F.to_json(F.struct(*parts))


def explanation_text() -> Column:
    """An assessed row's explanation as lines: headline, reasons, what speaks against, caveats
    and the action."""
    lines = lambda head, xs, f: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(head)), F.transform(xs, f))).otherwise(F.array().cast("array<string>"))
    bullet = lambda x: F.concat(F.lit("  • "), x)
    return F.array_join(F.concat(
        F.array(F.col("headline"), F.lit("")), lines("Why:", F.col("factors"), lambda f: bullet(F.concat(f["label"], F.lit(" — "), f["detail"]))), lines("Against:", F.col("counter_factors"), lambda f: bullet(f["code"])),
        lines("Caveats:", F.col("caveats"), bullet), F.array(F.concat(F.lit("Recommended action: "), F.col("action"))),
    ), "\n")


def alert_json(session: Column, created_at: Column, metadata: Column | None = None) -> Column:
    """An assessed row as the payload of an alert."""
    return F.to_json(F.struct(session.alias("session_id"), F.round("score", 1).alias("score"), "band", "action", "headline", "factors", F.col("policy").alias("profile"), created_at.alias("created_at"), (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata")))
