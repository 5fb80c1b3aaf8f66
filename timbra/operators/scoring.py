"""Rule scores, context, fusion, smoothing, bands and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import band, let, logit, lookup, off_hours, ramp, sigmoid
from ..functions.text import urgency_hits
from .fold import folded

EPS = 1e-9


def judged_rules(features: Column, rules: DataFrame) -> Column:
    """ARRAY<STRUCT<layer, feature, label, value, weight, strength, contribution>> of the rules
    that a window's map ``features`` lets judge. A rule is left out where its feature is
    missing or a required one is about 0. The rules are a few dozen rows: they become part of
    the expression, so no window is moved or copied."""
    value = lambda name: F.try_element_at(features, F.lit(name))
    found = []
    for x in rules.collect():
        v = value(x.feature)
        here = v.isNotNull()
        for need in x.requires or ():
            here = here & (F.abs(F.coalesce(value(need), F.lit(0.0))) > EPS)
        strength = ramp(v, F.lit(x.low), F.lit(x.high))
        own = F.struct(F.lit(x.layer).alias("layer"), F.lit(x.feature).alias("feature"), F.lit(x.label).alias("label"), v.alias("value"), F.lit(x.weight).alias("weight"), strength.alias("strength"), (strength * F.lit(x.weight)).alias("contribution"))
        found.append(F.when(here, own))
    return F.array_compact(F.array(*found))


def rule_evidence(features: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each window and rule that can be judged: strength and weighted contribution.

    The map is read once a feature and leaves before the rules are dealt out as (rule, value)
    rows; what a rule says of a value is worked out there, once for all rules, in compiled code."""
    table = rules.collect()
    names = list(dict.fromkeys(n for x in table for n in (x.feature, *(x.requires or ()))))
    value = {n: F.col(f"__f{k}") for k, n in enumerate(names)}
    read = features.select(*keys, *[F.try_element_at("features", F.lit(n)).cast("double").alias(f"__f{k}") for k, n in enumerate(names)])

    def judged(x) -> Column:
        needs = [F.abs(F.coalesce(value[n], F.lit(0.0))) > EPS for n in x.requires or ()]
        return F.when(reduce(lambda a, b: a & b, needs), value[x.feature]) if needs else value[x.feature]

    dealt = read.select(*keys, F.posexplode(F.array(*map(judged, table))).alias("__rule", "value")).filter("value is not null")
    of = lambda name: F.get(F.array(*[F.lit(x[name]) for x in table]), F.col("__rule"))
    strength = ramp(F.col("value"), of("low"), of("high"))
    return dealt.select(*keys, of("layer").alias("layer"), of("feature").alias("feature"), of("label").alias("label"), "value", of("weight").alias("weight"), strength.alias("strength"), (strength * of("weight")).alias("contribution"))


def rule_layers(evidence: Column, rules: DataFrame) -> Column:
    """ARRAY<STRUCT<layer, score, confidence, factors, features_used>> from a window's judged
    rules, for each layer that has any. Sums of weights are freed of rounding, so that equal
    shares stay equal in whatever order rules come."""
    add = lambda own, c: F.aggregate(own, F.lit(0.0), lambda a, x: a + x[c])

    def scored(own: Column, total: Column, layer: str, all_weight: float) -> Column:
        bias, gain = dims.SCORERS.get(layer, (0.0, 0.0))
        score = sigmoid(F.lit(bias) + F.lit(gain) * (2 * add(own, "contribution") / total - 0.5))
        confidence = F.least(F.lit(1.0), 0.35 + 0.65 * total / F.lit(all_weight))
        factors = F.transform(own, lambda x: F.struct(x["feature"].alias("code"), x["label"].alias("label"), (x["contribution"] / total).alias("contribution"), x["value"].alias("value")))
        return F.when(F.size(own) > 0, F.struct(F.lit(layer).alias("layer"), score.alias("score"), confidence.alias("confidence"), factors.alias("factors"), F.size(own).alias("features_used")))

    def of(rows: Column, layer: str, all_weight: float) -> Column:
        return let(F.filter(rows, lambda x: x["layer"] == layer), lambda own: let(F.round(add(own, "weight"), 9), lambda total: scored(own, total, layer, all_weight)))

    whole = sorted((r[0], float(r[1])) for r in rules.groupBy("layer").agg(F.sum("weight")).collect())
    return let(evidence, lambda rows: F.array_compact(F.array(*[of(rows, *x) for x in whole])))


def rule_scores(features: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """score, confidence and factors of each window and layer."""
    rows = features.select(*keys, judged_rules(F.col("features"), rules).alias("__e"))
    return rows.select(*keys, F.inline(rule_layers(F.col("__e"), rules)))


def acoustic_confidence(confidence: Column) -> Column:
    """The rules are a prior: their confidence is capped at four fifths."""
    return confidence * 0.8


def prosodic_confidence(confidence: Column, cycles: Column, speech_ratio: Column) -> Column:
    """0 (abstains) without enough voiced speech; more cycles, more trust."""
    thin = (cycles < dims.MIN_CYCLES) | (speech_ratio < dims.MIN_SPEECH_RATIO)
    return F.when(thin, 0.0).otherwise(confidence * (0.55 + 0.45 * F.least(F.lit(1.0), cycles / 120)))


def blended(model: Column, heuristic: Column) -> Column:
    """A trained model's probability with a quarter of the heuristic's log-odds."""
    return sigmoid(0.75 * logit(model) + 0.25 * logit(heuristic))


def context_signals(c) -> Column:
    """ARRAY<STRUCT<code, strength, weight>> of the signals that the call's metadata has.
    ``c`` maps a field's name to its column; absent facts are null and give no signal."""
    yes, no = (lambda x: x.eqNullSafe(True)), (lambda x: x.eqNullSafe(False))

    def signal(when: Column, code: str, strength, weight: float) -> Column:
        s = strength if isinstance(strength, Column) else F.lit(float(strength))
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), s.cast("double").alias("strength"), F.lit(weight).alias("weight")))

    role = F.lower(F.coalesce(F.nullif(c("claimed_role"), F.lit("")), c("claimed_identity"), F.lit("")))
    senior = F.exists(F.array(*map(F.lit, dims.ROLES)), lambda r: F.contains(role, r))
    hits = F.size(urgency_hits(c("transcript")))
    has = lambda x: F.length(F.coalesce(x, F.lit(""))) > 0
    return F.array_compact(F.array(
        signal(no(c("caller_id_verified")), "caller_id_unverified", 1, 1.2), signal(yes(c("caller_id_verified")), "caller_id_verified", 0, 0.6),
        signal(no(c("known_contact")), "unknown_contact", 0.85, 1.0), signal(yes(c("known_contact")), "known_contact", 0, 0.5),
        signal(yes(c("first_contact")), "first_contact", 0.6, 0.5),
        signal(c("prior_fraud_reports") > 0, "prior_fraud_reports", ramp(c("prior_fraud_reports").cast("double"), 0, 3), 1.4),
        signal(has(c("origin")), "origin_risk", lookup(F.lower(c("origin")), dims.ORIGIN_RISK, 0.25), 0.7),
        signal(c("transaction_amount") > 0, "transaction_amount", ramp(c("transaction_amount"), 1e5, 5e6), 0.9),
        signal(c("local_hour").isNotNull(), "off_hours", F.when(off_hours(c("local_hour")), 0.55).otherwise(0.0), 0.5),
        signal(has(role) & senior, "high_value_role", 0.6, 0.7),
        signal(has(c("transcript")), "urgency_language", ramp(hits.cast("double"), 0, 3), 1.1),
        signal(c("account_age_days") < 30, "new_account", 0.5, 0.4),
    ))


def context_score(signals: Column) -> Column:
    """STRUCT<score, confidence, total_weight>; without signals 0.5 with confidence 0."""
    fold = lambda f: F.aggregate(signals, F.lit(0.0), lambda a, s: a + f(s))
    weight, strength = fold(lambda s: s["weight"]), fold(lambda s: s["weight"] * s["strength"])
    none = F.size(signals) == 0
    return F.struct(
        F.when(none, 0.5).otherwise(sigmoid(-1.4 + 3.2 * strength / F.nullif(weight, F.lit(0.0)))).alias("score"),
        F.when(none, 0.0).otherwise(0.3 + 0.5 * F.least(F.lit(1.0), weight / 5)).alias("confidence"),
        weight.alias("total_weight"),
    )


def fuse(layers: Column, calibration: tuple[float, float] = (1.0, 0.0), weights: dict[str, float] | None = None) -> Column:
    """Confidence-weighted log-odds over ARRAY<STRUCT<layer, score, confidence>> of a row.

    A layer with no effective weight neither votes nor counts; if none votes the result is
    0.5 with confidence 0. Shares are each voter's part of the total weight.
    """
    table = {**dims.FUSION_WEIGHTS, **(weights or {})}
    weight = lambda x: lookup(x["layer"], table, 0.0)
    power = lambda x: weight(x) * F.greatest(F.lit(0.0), x["confidence"])
    voters = F.filter(layers, lambda x: power(x) > EPS)
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    mass = add(voters, power)
    z = add(voters, lambda x: power(x) * logit(x["score"])) / F.nullif(mass, F.lit(0.0))
    scores = F.transform(voters, lambda x: x["score"])
    spread = F.when(F.size(voters) > 1, F.array_max(scores) - F.array_min(scores)).otherwise(0.0)
    all_weight = add(layers, weight)
    cover = mass / F.when(all_weight == 0, 1.0).otherwise(all_weight)
    none = F.size(voters) == 0
    a, b = calibration
    return F.struct(
        F.when(none, 0.5).otherwise(sigmoid(a * z + b)).alias("probability"),
        F.when(none, 0.5).otherwise(sigmoid(z)).alias("raw_probability"),
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), cover * (1 - 0.35 * spread)))).alias("confidence"),
        F.transform(voters, lambda x: F.struct(x["layer"].alias("layer"), (power(x) / mass).alias("share"))).alias("shares"),
        F.transform(F.filter(layers, lambda x: power(x) <= EPS), lambda x: x["layer"]).alias("excluded"),
    )


def score_100(probability: Column) -> Column:
    return F.bround(probability * 100, 1)


def after(a: float, b: float) -> bool:
    """a > b in Spark's order: NaN is above all numbers."""
    return b == b if a != a else a > b


def smooth_step(state: tuple | None, score: float | None, alpha: float, memory: int, quantile: float) -> tuple[float | None, list[float | None]]:
    """(value, history) after one more score: an average that fades, lifted halfway to what
    the recent scores agree on if that is higher. A null score leaves null and starts anew."""
    value, history = state or (None, [])
    history = [*history, score][-memory:]
    faded = score if value is None or score is None else alpha * score + (1 - alpha) * value
    held = sorted(history, key=lambda x: (x is None, x != x, 0.0 if x is None or x != x else x))[int(quantile * (len(history) - 1))]
    lifted = len(history) >= 3 and held is not None and faded is not None and after(held, faded)
    return faded + 0.5 * (held - faded) if lifted else faded, history


def smoothed(rows: DataFrame, session: str, order: str, score: str, alpha: float = 0.35, memory: int = 8, quantile: float = 0.8) -> DataFrame:
    """session, order, score and ``smoothed``: the recursion streams over the ordered scores of
    a call and carries its last value and ``memory`` scores; no call is gathered. Calls are
    spread by the shuffle on ``session``; the rows of one call are one after another."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        at, s = row
        value, history = smooth_step(state, s, alpha, memory, quantile)
        return (value, history), (at, s, value)

    ordered = rows.select(session, F.col(order).cast("long").alias(order), F.col(score).cast("double").alias(score))
    return folded(ordered, step, {order: "bigint", score: "double", "smoothed": "double"})


def trail(rows: DataFrame, session: str, order: str) -> DataFrame:
    """Running facts of each call over (session, order, smoothed): provisional, peak, recent peak."""
    w = Window.partitionBy(session).orderBy(order)
    return rows.select("*", (F.row_number().over(w) <= dims.WARMUP).alias("provisional"), F.max("smoothed").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"), F.max("score").over(w.rowsBetween(-7, 0)).alias("recent_peak"))


def banded(rows: DataFrame, profiles: DataFrame, score: str = "smoothed") -> DataFrame:
    """Add the profile's band; unknown profiles count as the default one."""
    known = profiles.select("profile", "elevated", "high", "critical")
    default = next(p for p in dims.PROFILES if p[0] == "default")
    out = rows.join(known, "profile", "left")
    e, h, c = (F.coalesce(n, F.lit(v)) for n, v in zip(("elevated", "high", "critical"), default[1:4], strict=True))
    return out.withColumn("band", band(F.col(score), e, h, c)).drop("elevated", "high", "critical")


def merged_factors(factors: Column, limit: int = 6) -> Column:
    """ARRAY<STRUCT<code, label, rank, contribution, value>>: the strongest factor of each code
    over all layers, the ``limit`` best, shares that sum to one. ``factors``: an array of
    structs with code, label, contribution, value, confidence, share."""
    weight = lambda x: x["contribution"] * x["confidence"] * x["share"]
    live = F.transform(F.filter(factors, lambda x: x["confidence"] > 0), lambda x: F.struct((-weight(x)).alias("k"), x["code"].alias("code"), x["label"].alias("label"), x["value"].alias("value")))
    kind = "array<struct<k:double,code:string,label:string,value:double>>"
    add = lambda seen, x: F.when(F.exists(seen, lambda y: y["code"] == x["code"]), seen).otherwise(F.concat(seen, F.array(x)))
    first = F.aggregate(F.array_sort(live), F.array().cast(kind), add)  # of each code
    share = lambda x, whole: F.when(whole > EPS, -x["k"] / whole).otherwise(-x["k"])

    def ranked(top: Column, whole: Column) -> Column:
        return F.transform(top, lambda x, i: F.struct(x["code"].alias("code"), x["label"].alias("label"), (i + 1).alias("rank"), share(x, whole).alias("contribution"), x["value"].alias("value")))

    return let(F.slice(first, 1, limit), lambda top: let(F.aggregate(top, F.lit(0.0), lambda a, x: a - x["k"]), lambda whole: ranked(top, whole)))


def detail(code: Column, value: Column) -> Column:
    """What a rule says of its value; other codes give the code and the value."""
    value = value.cast("double")
    known = [F.when(code == k, F.format_string(t, value * 100 if k in dims.PER_CENT else value)) for k, t in dims.DETAILS.items()]
    return F.coalesce(*known, F.concat(code, F.lit(" = "), F.format_string("%.4g", value)))


def top_factors(factors: Column, n: int = 3) -> Column:
    """The n factors that weigh most either way."""
    order = lambda a, b: F.signum(F.abs(b["contribution"]) - F.abs(a["contribution"])).cast("int")
    return F.slice(F.array_sort(factors, order), 1, n)


def headline(score: Column, band_name: Column, factors: Column) -> Column:
    lead = F.concat(F.lit("Risk "), F.format_string("%.0f", F.bround(score, 0)), F.lit("/100 — this voice "), lookup(band_name, dims.PHRASES, dims.PHRASES["LOW"]))
    return F.when(F.size(factors) > 0, F.concat(lead, F.lit("; the strongest single indicator is "), F.lower(F.get(factors, F.lit(0))["label"]), F.lit("."))).otherwise(F.concat(lead, F.lit(".")))


def explanation_factors(factors: Column, limit: int = 4) -> Column:
    return F.slice(top_factors(F.filter(factors, lambda f: f["contribution"] > 0.01), 1000), 1, limit)


def counter_evidence(layers: Column) -> Column:
    """Layers that vote genuine with some confidence, the two strongest first."""
    rows = F.transform(F.filter(layers, lambda x: (x["confidence"] > 0.2) & (x["score"] < 0.35)), lambda x: F.struct((-x["confidence"] * (1 - x["score"])).alias("k"), F.concat(x["layer"], F.lit("_genuine")).alias("code"), x["score"].alias("value")))
    return F.transform(F.slice(F.array_sort(rows), 1, 2), lambda r: F.struct(r["code"].alias("code"), (-r["k"]).alias("contribution"), r["value"].alias("value")))


def layer_summary(layers: Column, shares: Column) -> Column:
    share = lambda x: F.get(F.transform(F.filter(shares, lambda s: s["layer"] == x["layer"]), lambda s: s["share"]), F.lit(0))
    return F.transform(layers, lambda x: F.struct(x["layer"].alias("layer"), F.round(x["score"], 4).alias("score"), F.round(x["confidence"], 4).alias("confidence"), F.round(F.coalesce(share(x), F.lit(0.0)), 4).alias("weight_share"), F.when(share(x).isNull(), "abstained").otherwise("voted").alias("status")))


def caveats(elapsed: Column, speech_ratio: Column, excluded: Column, confidence: Column, heuristic: Column, shift: Column) -> Column:
    """What a reader should know before acting on the score."""
    c = dims.CAVEATS
    return F.array_compact(F.array(
        F.when(elapsed < 3, F.format_string(c["short"], elapsed.cast("double"))), F.when(speech_ratio < 0.35, c["silent"]), F.when(F.array_contains(excluded, "speaker"), c["no_speaker"]),
        F.when(confidence < 0.5, c["unsure"]), F.when(heuristic, c["heuristic"]), F.when(shift > 1, F.format_string(c["lowered"], F.bround(shift.cast("double"), 0))),
    ))
