"""Call reports, fleet figures, alerts, the approval gate and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import band_rank, rounded, verdict
from .fold import folded


def session_report(windows: DataFrame, session: str = "session_id", factors: DataFrame | None = None) -> DataFrame:
    """One row for each call over (session, window_index, smoothed, band, provisional):
    final, peak and mean score, verdict, histogram of bands, and the most frequent factors."""
    seconds = (F.max("window_index") * dims.HOP + dims.WINDOW) / F.lit(dims.SAMPLE_RATE)
    base = windows.groupBy(session).agg(
        F.count("*").alias("windows_analyzed"), seconds.alias("duration_seconds"), F.max_by("smoothed", "window_index").alias("final_score"), F.max_by("band", "window_index").alias("band"),
        F.max("smoothed").alias("peak_score"), F.avg("smoothed").alias("mean_score"), *[F.count_if(F.col("band") == b).alias(f"n_{b.lower()}") for b in dims.BANDS],
    )
    out = base.withColumn("verdict", verdict(F.col("windows_analyzed"), F.col("duration_seconds"), F.col("peak_score")))
    return out if factors is None else out.join(report_factors(factors, session), session, "left")


def report_factors(factors: DataFrame, session: str, limit: int = 8) -> DataFrame:
    """top_factors of each call: by count, then mean contribution. Contributions are summed as
    decimals, so that no order of rows changes a mean or a rank."""
    total = F.sum(F.col("contribution").cast("decimal(20,12)"))
    g = factors.groupBy(session, "code").agg(F.count("*").alias("count"), (total.cast("double") / F.count("*")).alias("mean_contribution"))
    w = Window.partitionBy(session).orderBy(F.col("count").desc(), F.col("mean_contribution").desc(), "code")
    top = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("rank", "code", "count", "mean_contribution"))).alias("top_factors"))


def factor_frequency(factors: DataFrame) -> DataFrame:
    return factors.groupBy("code").agg(F.count("*").alias("n"))


def band_histogram(windows: DataFrame, session: str = "session_id") -> DataFrame:
    return windows.groupBy(session, "band").agg(F.count("*").alias("n"))


def fleet_stats(reports: DataFrame) -> DataFrame:
    """Open and closed calls, windows, mean latency of calls with windows, calls at risk."""
    return reports.agg(F.count_if("open").alias("active"), F.count_if(~F.col("open")).alias("closed"), F.sum("windows_analyzed").alias("windows"), F.avg(F.when(F.col("windows_analyzed") > 0, F.col("mean_latency"))).alias("mean_latency_ms"), F.count_if(F.col("final_score") >= 60).alias("at_risk"))


def dashboard_order(reports: DataFrame) -> list[Column]:
    """Open calls first, then the higher band, then the higher score."""
    return [F.when(F.col("open"), 0).otherwise(1), band_rank(F.col("band")).desc(), F.col("final_score").desc()]


def alerts(windows: DataFrame, session: str = "session_id", ts: str = "ts", order: str = "window_index", cooldown: float = dims.COOLDOWN_SECONDS) -> DataFrame:
    """The windows that alert: HIGH or above, not provisional, a higher band than any alert of
    the call before, and ``cooldown`` seconds of event time after the last. The candidates of
    a call stream by in order; most windows never are candidates and leave before the shuffle."""
    rank = band_rank(F.col("band"))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    some = windows.filter(~F.col("provisional") & (rank >= 2)).select(session, F.col(order).cast("long").alias(order), rank.cast("int").alias("rank"), micros.alias("t"))
    wait = int(cooldown * 1e6)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        (top, last), (at, rank, t) = state or (-1, None), row
        fires = rank > top and (last is None or t is not None and t - last >= wait)
        return ((rank, t), (at, rank)) if fires else ((top, last), None)

    out = folded(some, step, {order: "bigint", "rank": "int"})
    return out.select(session, order, F.element_at(F.array(*map(F.lit, dims.BANDS)), F.col("rank") + 1).alias("band"))


def channels_for(profile_channels: Column, registered: list[str]) -> Column:
    own = F.filter(profile_channels, lambda c: c.isin(*registered))
    return F.when(profile_channels.isNull() | (F.size(own) == 0), F.array(F.lit("console"))).otherwise(own)


def approvals(requests: DataFrame, sessions: DataFrame, profiles: DataFrame, session: str = "session_id") -> DataFrame:
    """decision, verification and reasons for each request (session, amount, profile); calls
    that are not known get ``not_found``. Thresholds are the profile's own."""
    known = sessions.select(session, F.coalesce("score", F.lit(0.0)).alias("risk_score"), F.coalesce("windows_analyzed", F.lit(0)).alias("windows_analyzed"), F.coalesce("audio_seconds", F.lit(0.0)).alias("audio_seconds"), F.lit(True).alias("known"))
    default = next(p for p in dims.PROFILES if p[0] == "default")
    r = requests.join(known, session, "left").join(profiles.select("profile", "elevated", "high", "critical"), "profile", "left")
    e, h, c = (F.coalesce(n, F.lit(v)) for n, v in zip(("elevated", "high", "critical"), default[1:4], strict=True))
    s, big = F.col("risk_score"), F.col("amount") >= dims.STEP_UP_AMOUNT
    thin = (F.col("windows_analyzed") < 3) | (F.col("audio_seconds") < 3)
    decision = F.when(F.col("known").isNull(), "not_found").when(s >= c, "block").when(s >= h, F.when(big, "block").otherwise("step_up")).when((s >= e) | thin | big, "step_up").otherwise("allow")
    names = lambda *xs: F.array(*map(F.lit, xs))
    ask = F.when(F.col("known").isNull(), F.array().cast("array<string>")).when(s >= c, names("supervisor_escalation", "callback_on_registered_number")).when(s >= h, names("callback_on_registered_number", "second_factor")).when((s >= e) | thin, names("knowledge_based_question", "second_factor")).when(big, names("second_factor")).otherwise(F.array().cast("array<string>"))
    why = F.array_compact(F.array(F.when(thin, "thin_evidence"), F.when(s >= c, "block_threshold").when(s >= h, "review_threshold").when(s >= e, "elevated").when(thin, None).when(big, "value_ceiling").otherwise("normal_range")))
    return r.select(*requests.columns, "risk_score", decision.alias("decision"), ask.alias("required_verification"), F.when(F.col("known").isNotNull(), why).alias("reasons"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("x"))
    return top.select("x.*")


def recent(rows: DataFrame, at: str, n: int = 50, *tie: str) -> DataFrame:
    return rows.orderBy(F.col(at).desc(), *tie).limit(n)


def live_then_closed(live: DataFrame, closed: DataFrame, at: str, n: int = 100, *tie: str) -> DataFrame:
    """Live calls by last activity, then closed ones, the first n."""
    both = live.withColumn("__k", F.lit(0)).unionByName(closed.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("__k", F.col(at).desc(), *tie).limit(n).drop("__k")


def live_or_stored(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Live values win over stored ones."""
    names = [c for c in live.columns if c != key]
    s = stored.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return live.join(s, key, "full").select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in names])


def report_with_trail(sessions: DataFrame, assessments: DataFrame, session: str = "session_id", limit: int = 600) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.col("window_index").desc())
    last = assessments.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit)
    own = last.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("window_index", "score", "band"))).alias("trail"))
    return sessions.join(own, session, "left")


# What callers see -----------------------------------------------------------------------------

HIGH_RISK = ("HIGH", "CRITICAL")


def result_flags(answers: DataFrame) -> DataFrame:
    """Answers (``call.answers``) with what a caller asks of them: is_high_risk, is_synthetic (by
    the call's verdict), inconclusive ("could not tell" is not "genuine"), top_factor, explained."""
    lines = lambda xs, f: F.transform(xs, f)
    head = F.coalesce(F.nullif("headline", F.lit("")), F.concat(F.lit("Risk "), F.format_string("%.0f", F.bround("score", 0)), F.lit("/100 ("), "band", F.lit(")")))
    text = F.concat(F.array(head), lines(F.slice("factors", 1, 4), lambda f: F.concat(F.lit("  - "), f["label"], F.lit(": "), F.coalesce(f["detail"], F.lit("")))), lines("caveats", lambda c: F.concat(F.lit("  ! "), c)), F.when(F.coalesce("action", F.lit("")) != "", F.array(F.concat(F.lit("  -> "), "action"))).otherwise(F.array().cast("array<string>")))
    return answers.select(
        "*", F.col("band").isin(*HIGH_RISK).alias("is_high_risk"), F.col("verdict").isin("likely_synthetic", "suspicious").alias("is_synthetic"),
        F.col("verdict").isin("insufficient_audio", "inconclusive").alias("inconclusive"), F.get("factors", F.lit(0)).alias("top_factor"), F.array_join(text, "\n").alias("explained"),
    )


def approval_flags(approvals_: DataFrame) -> DataFrame:
    """Decisions of ``approvals`` with allowed, blocked and needs_step_up."""
    is_ = lambda d: F.col("decision") == d
    return approvals_.select("*", is_("allow").alias("allowed"), is_("block").alias("blocked"), is_("step_up").alias("needs_step_up"))


def session_views(rows: DataFrame) -> DataFrame:
    """How each call stands, from the rows of ``call.OUT`` seen so far: open, last_activity, score,
    band, peak_score and its counts; a report, once it is there, decides."""
    kind = lambda k: F.col("kind") == k
    last = F.max_by(F.when(kind("window"), F.struct("score", "band", "peak")), F.when(kind("window"), F.col("window_index")))
    report = F.from_json(F.max(F.when(kind("closed"), F.col("payload"))), "struct<profile:string,language:string,identity:string,final_score:double,peak_score:double,band:string,stats:struct<windows_analyzed:long,windows_skipped:long,alerts_raised:long,late_rows:long>>")
    g = rows.groupBy("session_id").agg(last.alias("w"), report.alias("r"), F.max("at").alias("at"), F.count_if(kind("window")).alias("windows"), F.count_if(kind("alert")).alias("alerts"), F.count_if(kind("refused")).alias("refused"))
    return g.select(
        "session_id", (F.col("r").isNull() & (F.col("refused") == 0)).alias("open"), (F.col("at") / 1e6).alias("last_activity"), "r.profile", "r.language", "r.identity",
        rounded(F.coalesce("r.final_score", "w.score", F.lit(0.0)), 1).alias("score"), F.coalesce("r.band", "w.band", F.lit("LOW")).alias("band"), rounded(F.coalesce("r.peak_score", "w.peak", F.lit(0.0)), 1).alias("peak_score"),
        F.coalesce("r.stats.windows_analyzed", "windows").alias("windows_analyzed"), F.coalesce("r.stats.alerts_raised", "alerts").alias("alerts_raised"),
    )


def fusion_table(spark, registry, calibration: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """The layers that vote, their weights and the calibration of what they give."""
    rows = [(k, name, float(w), *map(float, calibration)) for k, (name, w) in enumerate(registry.fusion().items())]
    return spark.createDataFrame(rows, "position int, layer string, weight double, a double, b double")
