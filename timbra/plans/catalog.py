"""Registered queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import exprs as X
from ..functions import text as T
from ..operators import layers as J
from ..operators import metrics as M
from ..operators import privacy as P
from ..operators import reports as R
from ..operators import scoring as S
from ..operators import speaker as V
from ..operators import windows as W
from . import proxies as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


PROFILES_SQL = "p(profile, elevated, high, critical) AS (VALUES " + ", ".join(f"('{n}', {e}::DOUBLE, {h}::DOUBLE, {c}::DOUBLE)" for n, e, h, c, _ in dims.PROFILES) + ")"
EVENT_PROFILE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.PROFILE_OF_EVENT.items()) + " END"
BAND = "CASE WHEN {s} >= coalesce(critical, 80) THEN 'CRITICAL' WHEN {s} >= coalesce(high, 60) THEN 'HIGH' WHEN {s} >= coalesce(elevated, 35) THEN 'ELEVATED' ELSE 'LOW' END"


def _event_profile(w: DataFrame) -> DataFrame:
    return w.withColumn("profile", F.create_map(*[F.lit(x) for kv in Q.PROFILE_OF_EVENT.items() for x in kv])[F.col("event_type")])


@query(f"WITH {Q.WINDOWS}, {PROFILES_SQL} SELECT event_id, {BAND.format(s='score')} AS band FROM w LEFT JOIN p ON p.profile = {EVENT_PROFILE}")
def risk_bands(spark, d):
    return S.banded(_event_profile(Q.windows(spark, d)), dims.profiles(spark), "score").select("event_id", "band")


@query(f"WITH {Q.REQUESTS}, {Q.SHIFT} SELECT request_id, round(shift, 6) AS shift FROM sh")
def context_shift(spark, d):
    r = Q.requests(spark, d)
    s = X.threshold_shift(F.col("amount"), F.col("prior_fraud_reports"), F.col("known_contact"), F.col("caller_id_verified"), F.col("local_hour"))
    return r.select("request_id", r6(s, "shift"))


@query(f"WITH {Q.REQUESTS}, {Q.SHIFT}, {PROFILES_SQL} SELECT request_id, profile, " + ", ".join(f"round(greatest(0.0, {t} - shift), 6) AS {t}" for t in ("elevated", "high", "critical")) + " FROM sh JOIN p USING (profile)")
def effective_thresholds(spark, d):
    r = Q.requests(spark, d)
    s = X.threshold_shift(F.col("amount"), F.col("prior_fraud_reports"), F.col("known_contact"), F.col("caller_id_verified"), F.col("local_hour"))
    j = r.withColumn("shift", s).join(dims.profiles(spark), "profile")
    return j.select("request_id", "profile", *[r6(X.lowered(F.col(t), F.col("shift")), t) for t in ("elevated", "high", "critical")])


def _fused(spark, d) -> DataFrame:
    return Q.layered(Q.windows(spark, d)).withColumn("fusion", S.fuse(F.col("layers")))


@query(f"WITH {Q.WINDOWS}, {Q.LAYERS} SELECT session_id, window_index, round(probability, 6) AS probability, round(confidence, 6) AS confidence, voters FROM fused")
def fusion_scores(spark, d):
    return _fused(spark, d).select("session_id", "window_index", r6(F.col("fusion.probability"), "probability"), r6(F.col("fusion.confidence"), "confidence"), F.size("fusion.shares").cast("long").alias("voters"))


@query(f"WITH {Q.WINDOWS}, {Q.LAYERS} SELECT session_id, window_index, layer, round(power / sum(power) OVER (PARTITION BY session_id, window_index), 6) AS share FROM v WHERE power > 1e-9")
def layer_contributions(spark, d):
    return _fused(spark, d).select("session_id", "window_index", F.inline("fusion.shares")).select("session_id", "window_index", "layer", r6(F.col("share"), "share"))


@query(f"WITH {Q.WINDOWS}, {Q.LAYERS}, t AS (SELECT *, sum(power) OVER (PARTITION BY session_id, window_index) AS mass FROM v) SELECT session_id, window_index, layer, round(CASE WHEN power > 1e-9 THEN power / mass ELSE 0 END, 4) AS weight_share, CASE WHEN power > 1e-9 THEN 'voted' ELSE 'abstained' END AS status FROM t")
def layer_status(spark, d):
    rows = _fused(spark, d).select("session_id", "window_index", F.inline(S.layer_summary(F.col("layers"), F.col("fusion.shares"))))
    return rows.select("session_id", "window_index", "layer", "weight_share", "status")


@query(f"""WITH {Q.WINDOWS}, {Q.LAYERS}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id, window_index ORDER BY confidence * (1 - score) DESC, layer) AS n FROM v WHERE confidence > 0.2 AND score < 0.35)
  SELECT session_id, window_index, layer || '_genuine' AS code, round(confidence * (1 - score), 10) AS contribution, round(score, 10) AS value FROM c WHERE n <= 2""")
def counter_evidence(spark, d):
    rows = Q.layered(Q.windows(spark, d)).select("session_id", "window_index", F.inline(S.counter_evidence(F.col("layers"))))
    return rows.select("session_id", "window_index", "code", F.round("contribution", 10).alias("contribution"), F.round("value", 10).alias("value"))


#: The rules' labels and what they say of a value, as DuckDB values.
LABELS = "(VALUES " + ", ".join(f"('{r[0]}', '{r[1]}')" for r in dims.ACOUSTIC_RULES + dims.PROSODIC_RULES) + ") AS lb(code, label)"
DETAIL_SQL = "CASE code " + " ".join(f"WHEN '{k}' THEN printf('{t}', value{' * 100' if k in dims.PER_CENT else ''})" for k, t in dims.DETAILS.items()) + " END"


RULE_ROWS = f"""{Q.EVIDENCE}, {Q.rules_sql()}, ev AS (SELECT f.window_id, layer, f.feature, f.value, weight, {Q.RAMP.format(v='f.value', a='low', b='high')} * weight AS contribution
    FROM feat f JOIN rules USING (feature) LEFT JOIN feat n ON n.window_id = f.window_id AND n.feature = need WHERE f.value IS NOT NULL AND (need IS NULL OR abs(coalesce(n.value, 0)) > 1e-9))"""


@query(f"""WITH {RULE_ROWS}, whole AS (SELECT layer, sum(weight) AS all_weight FROM rules GROUP BY layer), g AS (SELECT window_id, layer, sum(contribution) / sum(weight) AS e, sum(weight) AS total, count(*) AS n FROM ev GROUP BY ALL)
  SELECT window_id, layer, round(1 / (1 + exp(-(CASE layer WHEN 'acoustic' THEN -1.05 + 3.4 * (2 * e - 0.5) ELSE -1.2 + 3.0 * (2 * e - 0.5) END))), 6) AS score, round(least(1.0, 0.35 + 0.65 * total / all_weight), 6) AS confidence, n AS features_used FROM g JOIN whole USING (layer)""")
def rule_scores(spark, d):
    out = J.layer_rows(Q.features(spark, d), ["window_id"], J.rules_only())
    return out.select("window_id", "layer", r6(F.col("score"), "score"), r6(F.col("confidence"), "confidence"), "features_used")


@query(f"""WITH {RULE_ROWS}, t AS (SELECT *, CAST(sum(CAST(weight AS DECIMAL(18,9))) OVER (PARTITION BY window_id, layer) AS DOUBLE) AS total FROM ev), k AS (SELECT window_id, feature AS code, any_value(value) AS value, max(contribution / total * CASE layer WHEN 'acoustic' THEN 0.45 ELSE 0.28 END) AS scaled FROM t GROUP BY window_id, feature),
  n AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY scaled DESC, code) AS rank FROM k) SELECT window_id, code, label, round(value, 6) AS value, rank, round(CASE WHEN s > 1e-9 THEN scaled / s ELSE scaled END, 6) + 0.0 AS contribution FROM (SELECT *, sum(scaled) OVER (PARTITION BY window_id) AS s FROM n WHERE rank <= 6) JOIN {LABELS} USING (code)""")
def rule_factors_topk(spark, d):
    top = J.factor_rows(Q.features(spark, d), ["window_id"], J.rules_only())
    return top.select("window_id", "code", "label", r6(F.col("value"), "value"), "rank", r6(F.col("contribution"), "contribution"))


@query(f"""WITH {Q.REQUESTS}, g AS (SELECT request_id, [
    CASE WHEN caller_id_verified IS FALSE THEN {{'s': 1.0::DOUBLE, 'w': 1.2::DOUBLE}} WHEN caller_id_verified THEN {{'s': 0.0::DOUBLE, 'w': 0.6::DOUBLE}} END, CASE WHEN known_contact IS FALSE THEN {{'s': 0.85::DOUBLE, 'w': 1.0::DOUBLE}} WHEN known_contact THEN {{'s': 0.0::DOUBLE, 'w': 0.5::DOUBLE}} END,
    CASE WHEN first_contact THEN {{'s': 0.6::DOUBLE, 'w': 0.5::DOUBLE}} END, CASE WHEN prior_fraud_reports > 0 THEN {{'s': {Q.ramp_sql('prior_fraud_reports', 0.0, 3.0)}, 'w': 1.4::DOUBLE}} END,
    CASE WHEN origin <> '' THEN {{'s': (CASE lower(origin) WHEN 'international' THEN 0.7 WHEN 'voip' THEN 0.45 WHEN 'pstn' THEN 0.05 ELSE 0.25 END)::DOUBLE, 'w': 0.7::DOUBLE}} END, CASE WHEN amount > 0 THEN {{'s': {Q.ramp_sql('amount', 1e5, 5e6)}, 'w': 0.9::DOUBLE}} END,
    CASE WHEN local_hour IS NOT NULL THEN {{'s': (CASE WHEN local_hour < 7 OR local_hour >= 21 THEN 0.55 ELSE 0 END)::DOUBLE, 'w': 0.5::DOUBLE}} END, CASE WHEN claimed_role = 'Managing Director' THEN {{'s': 0.6::DOUBLE, 'w': 0.7::DOUBLE}} END,
    CASE WHEN transcript IS NOT NULL THEN {{'s': {Q.ramp_sql("CASE WHEN transcript LIKE 'please%' THEN 2 ELSE 0 END", 0.0, 3.0)}, 'w': 1.1::DOUBLE}} END, CASE WHEN account_age_days < 30 THEN {{'s': 0.5::DOUBLE, 'w': 0.4::DOUBLE}} END] AS x FROM r),
  u AS (SELECT request_id, unnest(list_filter(x, lambda i: i IS NOT NULL)) AS y FROM g), t AS (SELECT request_id, sum(y.s * y.w) / sum(y.w) AS e, sum(y.w) AS total, count(*) AS n FROM u GROUP BY request_id)
  SELECT request_id, n AS signals, round(1 / (1 + exp(1.4 - 3.2 * e)), 6) AS score, round(0.3 + 0.5 * least(1.0, total / 5), 6) AS confidence FROM t""")
def context_layer(spark, d):
    r = Q.requests(spark, d).withColumn("transaction_amount", F.col("amount")).withColumn("claimed_identity", F.lit(""))
    rows = r.withColumn("signals", S.context_signals(F.col)).withColumn("c", S.context_score(F.col("signals")))
    return rows.select("request_id", F.size("signals").cast("long").alias("signals"), r6(F.col("c.score"), "score"), r6(F.col("c.confidence"), "confidence"))


@query(f"WITH RECURSIVE {Q.WINDOWS}, {Q.smoother('w')} SELECT session_id, window_index, round(smoothed, 6) AS smoothed FROM s")
def smoothed_scores(spark, d):
    return S.smoothed(Q.windows(spark, d), "session_id", "window_index", "score").select("session_id", "window_index", r6(F.col("smoothed"), "smoothed"))


@query(f"""WITH RECURSIVE {Q.WINDOWS}, {Q.smoother('w')} SELECT session_id, window_index, window_index < 3 AS provisional, round(max(smoothed) OVER o, 6) AS peak, max(score) OVER (PARTITION BY session_id ORDER BY window_index ROWS 7 PRECEDING) AS recent_peak
  FROM s WINDOW o AS (PARTITION BY session_id ORDER BY window_index)""")
def session_trail(spark, d):
    rows = S.trail(S.smoothed(Q.windows(spark, d), "session_id", "window_index", "score"), "session_id", "window_index")
    return rows.select("session_id", "window_index", "provisional", r6(F.col("peak"), "peak"), "recent_peak")


def _judged(spark, d) -> DataFrame:
    """fuse, round, smooth, band: what a live call shows."""
    fused = _fused(spark, d).select("session_id", "window_index", S.score_100(F.col("fusion.probability")).alias("score"))
    rows = S.trail(S.smoothed(fused, "session_id", "window_index", "score"), "session_id", "window_index")
    return S.banded(rows.withColumn("profile", F.lit("wire_transfer")), dims.profiles(spark))


JUDGED = f"""{Q.WINDOWS}, {Q.LAYERS}, q AS (SELECT session_id, window_index, round_even(probability * 100, 1) AS score FROM fused), {Q.smoother('q')},
  j AS (SELECT session_id, window_index, score, smoothed, window_index < 3 AS provisional, CASE WHEN smoothed >= 65 THEN 'CRITICAL' WHEN smoothed >= 45 THEN 'HIGH' WHEN smoothed >= 25 THEN 'ELEVATED' ELSE 'LOW' END AS band FROM s)"""


@query(f"""WITH RECURSIVE {JUDGED}, g AS (SELECT session_id, count(*) AS windows_analyzed, (max(window_index) * 8000 + 16000) / 16000 AS duration_seconds, max_by(smoothed, window_index) AS final, max_by(band, window_index) AS band, max(smoothed) AS peak, avg(smoothed) AS mean,
    count(*) FILTER (band = 'LOW') AS n_low, count(*) FILTER (band = 'ELEVATED') AS n_elevated, count(*) FILTER (band = 'HIGH') AS n_high, count(*) FILTER (band = 'CRITICAL') AS n_critical FROM j GROUP BY session_id)
  SELECT session_id, windows_analyzed, duration_seconds, round(final, 6) AS final_score, band, round(peak, 6) AS peak_score, round(mean, 6) AS mean_score, n_low, n_elevated, n_high, n_critical,
    CASE WHEN duration_seconds < 2 THEN 'insufficient_audio' WHEN peak >= 80 THEN 'likely_synthetic' WHEN peak >= 60 THEN 'suspicious' WHEN peak >= 35 THEN 'inconclusive' ELSE 'likely_genuine' END AS verdict FROM g""")
def session_report(spark, d):
    out = R.session_report(_judged(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("final_score", "peak_score", "mean_score")})


@query(f"WITH RECURSIVE {JUDGED} SELECT session_id, band, count(*) AS n FROM j GROUP BY ALL")
def band_histogram(spark, d):
    return R.band_histogram(_judged(spark, d))


BAND_RANK = "CASE band WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'ELEVATED' THEN 1 ELSE 0 END"


@query(f"""WITH RECURSIVE {JUDGED}, c AS (SELECT j.session_id, j.window_index, {BAND_RANK} AS rank, epoch_us(ts) AS t, row_number() OVER (PARTITION BY j.session_id ORDER BY j.window_index) AS i
    FROM j JOIN w ON w.session_id = j.session_id AND w.window_index = j.window_index WHERE NOT provisional AND {BAND_RANK} >= 2),
  a AS (SELECT session_id, i, window_index, rank AS top, t AS last, true AS fires FROM c WHERE i = 1
    UNION ALL SELECT c.session_id, c.i, c.window_index, CASE WHEN c.rank > a.top AND c.t - a.last >= 10000000 THEN c.rank ELSE a.top END, CASE WHEN c.rank > a.top AND c.t - a.last >= 10000000 THEN c.t ELSE a.last END, c.rank > a.top AND c.t - a.last >= 10000000
    FROM a JOIN c ON c.session_id = a.session_id AND c.i = a.i + 1)
  SELECT session_id, window_index, ['LOW', 'ELEVATED', 'HIGH', 'CRITICAL'][top + 1] AS band FROM a WHERE fires""")
def alerts_emitted(spark, d):
    ts = Q.windows(spark, d).select("session_id", "window_index", "ts")
    return R.alerts(_judged(spark, d).join(ts, ["session_id", "window_index"]))


def _reports(spark, d) -> DataFrame:
    """Reports with an open flag and a latency, for fleet figures."""
    return R.session_report(_judged(spark, d)).withColumn("open", F.col("session_id") % 3 != 0).withColumn("mean_latency", F.col("windows_analyzed") * 1.5)


REPORTS = f"{JUDGED}, g AS (SELECT session_id, session_id % 3 <> 0 AS open, count(*) AS windows_analyzed, count(*) * 1.5 AS mean_latency, max_by(smoothed, window_index) AS final_score, max_by(band, window_index) AS band FROM j GROUP BY session_id)"


@query(f"WITH RECURSIVE {REPORTS} SELECT count(*) FILTER (open) AS active, count(*) FILTER (NOT open) AS closed, CAST(sum(windows_analyzed) AS BIGINT) AS windows, round(avg(mean_latency), 6) AS mean_latency_ms, count(*) FILTER (final_score >= 60) AS at_risk FROM g")
def fleet_stats(spark, d):
    return R.fleet_stats(_reports(spark, d)).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query(f"WITH RECURSIVE {REPORTS} SELECT session_id, open, band, round(final_score, 6) AS final_score FROM g ORDER BY CASE WHEN open THEN 0 ELSE 1 END, {BAND_RANK} DESC, g.final_score DESC, session_id LIMIT 40")
def dashboard_top(spark, d):
    rows = _reports(spark, d)
    return rows.orderBy(*R.dashboard_order(rows), "session_id").limit(40).select("session_id", "open", "band", r6(F.col("final_score"), "final_score"))


SIX = f"{RULE_ROWS}, six AS (SELECT window_id % 100 AS session_id, feature AS code, contribution FROM ev WHERE contribution > 0.01)"


@query(f"""WITH {SIX}, g AS (SELECT session_id, code, count(*) AS n, sum(CAST(contribution AS DECIMAL(20,12))) AS m FROM six GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, m DESC, code) AS rank FROM g)
  SELECT session_id, rank, code, n AS count, CAST(round(CAST(CAST(m AS DOUBLE) / n AS DECIMAL(20,12)), 6) AS DOUBLE) AS mean_contribution FROM k WHERE rank <= 8""")
def report_top_factors(spark, d):
    ev = S.rule_evidence(Q.features(spark, d), dims.rules(spark), ["window_id"]).filter("contribution > 0.01").select((F.col("window_id") % 100).alias("session_id"), F.col("feature").alias("code"), "contribution")
    rows = R.report_factors(ev, "session_id").select("session_id", F.inline("top_factors"))
    return rows.select("session_id", F.col("rank").cast("long").alias("rank"), "code", "count", r6(F.col("mean_contribution"), "mean_contribution"))


@query(f"WITH {SIX} SELECT code, count(*) AS n FROM six GROUP BY code")
def factor_frequency(spark, d):
    ev = S.rule_evidence(Q.features(spark, d), dims.rules(spark), ["window_id"]).filter("contribution > 0.01")
    return R.factor_frequency(ev.withColumnRenamed("feature", "code"))


@query(f"""WITH {Q.REQUESTS}, {PROFILES_SQL}, se AS (SELECT user_id AS session_id, floor(max(value) * 2) / 10 AS score, count(*) AS windows, count(*) / 25 AS audio FROM events GROUP BY user_id),
  k AS (SELECT r.*, coalesce(se.score, 0) AS risk, se.session_id IS NULL AS missing, windows < 3 OR audio < 3 AS thin, elevated, high, critical, amount >= 1000000 AS big FROM r LEFT JOIN se USING (session_id) JOIN p USING (profile))
  SELECT request_id, CASE WHEN missing THEN 'not_found' WHEN risk >= critical THEN 'block' WHEN risk >= high THEN CASE WHEN big THEN 'block' ELSE 'step_up' END WHEN risk >= elevated OR thin OR big THEN 'step_up' ELSE 'allow' END AS decision,
    CASE WHEN missing THEN '' WHEN risk >= critical THEN 'supervisor_escalation,callback_on_registered_number' WHEN risk >= high THEN 'callback_on_registered_number,second_factor' WHEN risk >= elevated OR thin THEN 'knowledge_based_question,second_factor' WHEN big THEN 'second_factor' ELSE '' END AS verification FROM k""")
def approval_gate(spark, d):
    """The gate over every session of events; requests for sessions that are not there are not found."""
    e = Q.table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg((F.floor(F.max("value") * 2) / 10).alias("score"), F.count("*").alias("windows_analyzed"), (F.count("*") / 25).alias("audio_seconds"))
    out = R.approvals(Q.requests(spark, d), e, dims.profiles(spark))
    return out.select("request_id", "decision", F.array_join("required_verification", ",").alias("verification"))


@query(SQL["approval_gate"].replace("SELECT request_id, CASE WHEN missing", "SELECT request_id, decision, decision = 'allow' AS allowed, decision = 'block' AS blocked, decision = 'step_up' AS needs_step_up FROM (SELECT request_id, CASE WHEN missing", 1) + ")")
def approval_results(spark, d):
    """The gate's decisions as a caller asks for them."""
    out = R.approval_flags(approval_gate(spark, d))
    return out.select("request_id", "decision", "allowed", "blocked", "needs_step_up")


CONTEXT_ROWS = SQL["context_layer"].split("\n  SELECT request_id, n AS signals")[0]


@query(f"""WITH {RULE_ROWS}, whole AS (SELECT layer, sum(weight) AS all_weight FROM rules GROUP BY layer), g AS (SELECT window_id, layer, sum(contribution) / sum(weight) AS e, sum(weight) AS total FROM ev GROUP BY ALL),
  cl AS ({CONTEXT_ROWS} SELECT request_id AS window_id, 1 / (1 + exp(1.4 - 3.2 * e)) AS score, 0.3 + 0.5 * least(1.0, total / 5) AS confidence FROM t),
  l AS (SELECT window_id, layer, coalesce(1 / (1 + exp(-(CASE layer WHEN 'acoustic' THEN -1.05 + 3.4 * (2 * e - 0.5) ELSE -1.2 + 3.0 * (2 * e - 0.5) END))), 0.5) AS score, CASE WHEN e IS NULL THEN 0.0 ELSE least(1.0, 0.35 + 0.65 * total / all_weight) * CASE layer WHEN 'acoustic' THEN 0.8 ELSE 1.0 END END AS confidence, CAST(CASE layer WHEN 'acoustic' THEN 0.45 ELSE 0.28 END AS DOUBLE) AS weight
    FROM (SELECT k AS window_id, layer, all_weight FROM o, whole) LEFT JOIN g USING (window_id, layer)
    UNION ALL SELECT window_id, 'context', score, confidence, CAST(0.08 AS DOUBLE) FROM cl),
  v AS (SELECT *, weight * CAST(confidence AS DOUBLE) AS power, ln(least(greatest(score, 1e-4), 1 - 1e-4) / (1 - least(greatest(score, 1e-4), 1 - 1e-4))) AS z FROM l),
  f AS (SELECT window_id, 1 / (1 + exp(-sum(power * z) / sum(power))) AS probability, greatest(0.05, least(1.0, sum(power) / sum(weight) * (1 - 0.35 * (max(score) FILTER (power > 1e-9) - min(score) FILTER (power > 1e-9))))) AS confidence FROM v GROUP BY window_id),
  {Q.REQUESTS}, {Q.SHIFT}, {PROFILES_SQL}, a AS (SELECT f.*, profile AS policy, shift, round_even(probability * 100, 1) AS score, greatest(0.0, elevated - shift) AS elevated, greatest(0.0, high - shift) AS high, greatest(0.0, critical - shift) AS critical FROM f JOIN sh ON request_id = window_id JOIN p USING (profile)),
  b AS (SELECT *, {BAND.format(s='score')} AS band FROM a),
  sc AS (SELECT *, power / sum(power) OVER (PARTITION BY window_id) AS share FROM v), tt AS (SELECT *, CAST(sum(CAST(weight AS DECIMAL(18,9))) OVER (PARTITION BY window_id, layer) AS DOUBLE) AS total FROM ev),
  k AS (SELECT tt.window_id, feature AS code, value, contribution / total * confidence * share AS k FROM tt JOIN sc USING (window_id, layer)),
  n AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY k DESC, code) AS n FROM k), c AS (SELECT *, k / sum(k) OVER (PARTITION BY window_id) AS c FROM n WHERE n <= 6),
  m AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n) AS m FROM c WHERE c > 0.01 QUALIFY m <= 4),
  fs AS (SELECT window_id, string_agg(code, ',' ORDER BY m) AS factors, string_agg({DETAIL_SQL}, ' | ' ORDER BY m) AS details, string_agg(printf('%.4f', round(c, 4)), ',' ORDER BY m) AS shares, max(label) FILTER (m = 1) AS label FROM m JOIN {LABELS} USING (code) GROUP BY window_id),
  told AS (SELECT b.window_id, coalesce(factors, '') AS factors, coalesce(details, '') AS details, coalesce(shares, '') AS shares, printf('Risk %.0f/100 — this voice ', score) || CASE band {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.PHRASES.items())} END || coalesce('; the strongest single indicator is ' || lower(label) || '.', '.') AS headline FROM b LEFT JOIN fs USING (window_id)),
  ls AS (SELECT window_id, string_agg(layer || ':' || CASE WHEN power > 1e-9 THEN 'voted' ELSE 'abstained' END || ':' || printf('%.4f', round(share, 4)), ',' ORDER BY CASE layer WHEN 'acoustic' THEN 0 WHEN 'prosodic' THEN 1 ELSE 2 END) AS summary,
    coalesce(string_agg(layer || '_genuine', ',' ORDER BY g) FILTER (g <= 2), '') AS against FROM (SELECT *, CASE WHEN confidence > 0.2 AND score < 0.35 THEN row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN confidence > 0.2 AND score < 0.35 THEN confidence * (1 - score) ELSE -1 END DESC) END AS g FROM sc) GROUP BY window_id)
  SELECT window_id, policy, round(score, 1) AS score, band, round(probability, 6) AS probability, round(confidence, 6) AS confidence, round(shift, 6) AS threshold_shift, CASE band {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.ACTIONS.items())} END AS action,
    headline, factors, details, shares, summary, against, array_to_string(list_filter(['{dims.CAVEATS['short'] % 0.0}', CASE WHEN confidence < 0.5 THEN '{dims.CAVEATS['unsure']}' END, '{dims.CAVEATS['heuristic']}', CASE WHEN shift > 1 THEN printf('{dims.CAVEATS['lowered'].replace("'", "''")}', shift) END], lambda x: x IS NOT NULL), ' | ') AS caveats
  FROM b JOIN told USING (window_id) JOIN ls USING (window_id)""")
def assessed_windows(spark, d):
    """Rules and context of each window fused, judged by the call's profile and facts, explained:
    one pass over Arrow batches."""
    r = Q.requests(spark, d).withColumn("transaction_amount", F.col("amount")).withColumn("claimed_identity", F.lit(""))
    facts = r.select(F.col("request_id").alias("window_id"), "profile", *[c for c in J.CONTEXT_KINDS if c in r.columns])
    layers = J.rules_only().register(J.Layer("context", dims.FUSION_WEIGHTS["context"], J.context, (), ("context",)))
    acoustic = J.Layer("acoustic", dims.FUSION_WEIGHTS["acoustic"], J.acoustic, layers.layers["acoustic"].features)
    n = 4 * spark.sparkContext.defaultParallelism  # small rows, much work: not to be coalesced, and dealt once, for the join
    rows = Q.features(spark, d).repartition(n, "window_id").join(facts.repartition(n, "window_id"), "window_id")
    out = J.verdicts(rows, ["window_id"], layers.register(acoustic), J.Policy(heuristic=True))
    told = lambda xs, f, by: F.array_join(F.transform(xs, f), by)
    four = lambda x: F.round(x, 4).cast("decimal(10,4)").cast("string")
    return out.select(
        "window_id", "policy", F.round("score", 1).alias("score"), "band", r6(F.col("probability"), "probability"), r6(F.col("confidence"), "confidence"), r6(F.col("threshold_shift"), "threshold_shift"), "action", "headline",
        told("factors", lambda f: f["code"], ",").alias("factors"), told("factors", lambda f: f["detail"], " | ").alias("details"), told("factors", lambda f: four(f["contribution"]), ",").alias("shares"),
        told("layer_summary", lambda x: F.concat_ws(":", x["layer"], x["status"], four(x["weight_share"])), ",").alias("summary"), told("counter_factors", lambda f: f["code"], ",").alias("against"), F.array_join("caveats", " | ").alias("caveats"),
    )


CALLS = "calls AS (SELECT conv_id, sum(n_chars) AS n_samples FROM (SELECT conv_id, length(text) * 97 AS n_chars FROM conversations) GROUP BY conv_id)"


def _calls(spark, d) -> DataFrame:
    return Q.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text") * 97).alias("n_samples"))


@query(f"""WITH {CALLS}, k AS (SELECT *, CASE WHEN n_samples >= 16000 THEN (n_samples - 16000) // 8000 + 1 ELSE 0 END AS n FROM calls), x AS (SELECT *, unnest(generate_series(0, CAST(n AS BIGINT))) AS i FROM k)
  SELECT conv_id, CAST(i AS BIGINT) AS window_index, i * 8000 / 16000 AS start_s, CASE WHEN i = n THEN CAST(n_samples AS BIGINT) ELSE i * 8000 + 16000 END / 16000 AS end_s, i = n AS is_tail FROM x WHERE i < n OR n_samples - n * 8000 >= 6400""")
def window_spans(spark, d):
    return W.window_spans(_calls(spark, d)).select("conv_id", F.col("window_index").cast("long").alias("window_index"), "start_s", "end_s", "is_tail")


@query(f"""WITH {Q.WINDOWS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS new FROM w), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS part FROM g)
  SELECT session_id, CAST(part AS BIGINT) AS part, count(*) AS n, max(window_index) AS last_window FROM s GROUP BY ALL""")
def idle_sessions(spark, d):
    return W.idle_split(Q.windows(spark, d), "session_id", "ts", "event_id", 86400).groupBy("session_id", "part").agg(F.count("*").alias("n"), F.max("window_index").alias("last_window"))


FLAGGED = f"{Q.WINDOWS}, fl AS (SELECT session_id, window_index, value >= 40 AS speech FROM w)"


def _flagged(spark, d) -> DataFrame:
    return Q.windows(spark, d).select("session_id", "window_index", (F.col("value") >= 40).alias("speech"))


@query(f"""WITH {FLAGGED}, g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_index) - row_number() OVER (PARTITION BY session_id, speech ORDER BY window_index) AS run FROM fl)
  SELECT session_id, speech, min(window_index) AS first, max(window_index) AS last, count(*) AS n FROM g GROUP BY session_id, speech, run""")
def speech_runs(spark, d):
    return W.runs(_flagged(spark, d), ["session_id"], "window_index", "speech")


@query(f"""WITH {FLAGGED}, g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_index) - row_number() OVER (PARTITION BY session_id, speech ORDER BY window_index) AS run FROM fl)
  SELECT session_id, min(window_index) * 160 / 16000 AS start_s, (max(window_index) * 160 + 320) / 16000 AS end_s, count(*) AS n FROM g WHERE speech GROUP BY session_id, run""")
def speech_segments(spark, d):
    return W.speech_segments(_flagged(spark, d), ["session_id"], "window_index", "speech", 320, 160)


@query(f"""WITH {FLAGGED}, g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_index) - row_number() OVER (PARTITION BY session_id, speech ORDER BY window_index) AS run, min(window_index) FILTER (speech) OVER (PARTITION BY session_id) AS a, max(window_index) FILTER (speech) OVER (PARTITION BY session_id) AS b FROM fl),
  h AS (SELECT *, count(*) OVER (PARTITION BY session_id, speech, run) AS n FROM g), i AS (SELECT session_id, window_index, speech OR coalesce(window_index > a AND window_index < b AND n < 3, false) AS filled FROM h),
  k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_index) - row_number() OVER (PARTITION BY session_id, filled ORDER BY window_index) AS run FROM i)
  SELECT session_id, window_index, filled AND count(*) OVER (PARTITION BY session_id, filled, run) >= 4 AS smooth FROM k""")
def mask_smooth(spark, d):
    return W.smooth_mask(_flagged(spark, d), ["session_id"], "window_index", "speech", 4, 3).select("session_id", "window_index", "smooth")


@query(f"""WITH {Q.WINDOWS}, x AS (SELECT *, first(value) OVER o AS a, last(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b, lead(value) OVER o AS n1, lead(value, 2) OVER o AS n2, lag(value) OVER o AS p1, lag(value, 2) OVER o AS p2 FROM w WINDOW o AS (PARTITION BY session_id ORDER BY window_index))
  SELECT session_id, window_index, round((coalesce(n1, b) - coalesce(p1, a) + 2 * (coalesce(n2, b) - coalesce(p2, a))) / 10, 6) AS delta FROM x""")
def delta_features(spark, d):
    return W.deltas(Q.windows(spark, d), ["session_id"], "window_index", "value").select("session_id", "window_index", r6(F.col("delta"), "delta"))


@query(f"WITH {Q.WINDOWS} SELECT session_id, window_index, round(sum(value) OVER (PARTITION BY session_id ORDER BY window_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM w")
def moving_average(spark, d):
    return W.moving_average(Q.windows(spark, d), ["session_id"], "window_index", "value", 5).select("session_id", "window_index", r6(F.col("smooth"), "smooth"))


@query(f"""WITH {Q.WINDOWS}, x AS (SELECT *, abs(value - lag(value) OVER o) AS step, CASE WHEN lag(value) OVER o IS NOT NULL AND lead(value) OVER o IS NOT NULL THEN abs(value - (lag(value) OVER o + value + lead(value) OVER o) / 3) END AS off FROM w WINDOW o AS (PARTITION BY session_id ORDER BY window_index))
  SELECT session_id, round(avg(step) / avg(value), 6) AS local, round(avg(off) / avg(value), 6) AS residual FROM x GROUP BY session_id""")
def perturbation(spark, d):
    return W.perturbation(Q.windows(spark, d), ["session_id"], "window_index", "value").select("session_id", r6(F.col("local"), "local"), r6(F.col("residual"), "residual"))


@query(f"""WITH {Q.WINDOWS}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY session_id) AS c FROM w), x AS (SELECT *, abs(value - lag(value) OVER o) AS d1, abs(value - 2 * lag(value) OVER o + lag(value, 2) OVER o) AS d2, c * lag(c) OVER o AS p FROM c WINDOW o AS (PARTITION BY session_id ORDER BY window_index))
  SELECT session_id, round(avg(d1), 6) AS first_diff, round(avg(d2), 6) AS second_diff, round(sum(p) / sum(c * c), 6) AS lag1_autocorr FROM x GROUP BY session_id""")
def envelope_smoothness(spark, d):
    out = W.envelope_smoothness(Q.windows(spark, d), ["session_id"], "window_index", "value")
    return out.select("session_id", *[r6(F.col(c), c) for c in ("first_diff", "second_diff", "lag1_autocorr")])


@query(f"""WITH {Q.VECTORS} SELECT vec_id, round(sqrt(list_sum(list_transform(vector, lambda x: x * x)) / len(vector) + 1e-12), 6) AS rms, round(list_max(list_transform(vector, lambda x: abs(x))), 6) AS peak,
    round(list_sum(list_transform(list_zip(vector[1:len(vector) - 1], vector[2:]), lambda p: CASE WHEN sign(p[1]) * sign(p[2]) < 0 THEN 1.0 ELSE 0.0 END)) / (len(vector) - 1), 6) AS zcr, round(greatest(-120, 20 * log10(sqrt(list_sum(list_transform(vector, lambda x: x * x)) / len(vector) + 1e-12))), 6) AS level_db FROM e""")
def frame_stats(spark, d):
    v = F.col("vector")
    return Q.vectors(spark, d).select("vec_id", r6(X.rms(v), "rms"), r6(F.array_max(F.transform(v, F.abs)), "peak"), r6(X.zero_crossing_rate(v), "zcr"), r6(X.decibel(X.rms(v)), "level_db"))


@query(f"""WITH {Q.VECTORS}, x AS (SELECT identity, unnest(vector) AS v FROM e) SELECT identity, round(avg(CASE WHEN abs(v) > 0.985 THEN 1.0 ELSE 0.0 END), 6) AS clipping_ratio, round(abs(avg(v)), 6) AS dc_offset, round(max(abs(v)) / sqrt(avg(v * v)), 6) AS crest_factor,
    round(count(DISTINCT round(v * 32768)) / (max(round(v * 32768)) - min(round(v * 32768)) + 1), 6) AS code_use FROM x GROUP BY identity""")
def signal_hygiene(spark, d):
    rows = Q.vectors(spark, d).select("identity", F.explode("vector").alias("v"))
    return W.signal_hygiene(rows, ["identity"], "v").select("identity", *[r6(F.col(c), c) for c in ("clipping_ratio", "dc_offset", "crest_factor", "code_use")])


@query(f"WITH {Q.WINDOWS} SELECT session_id, round(median(-value), 6) AS silence_median_db, round(stddev_pop(-value), 6) AS silence_std_db, round(max(-value) - min(-value), 6) AS silence_range_db, round(avg(CASE WHEN -value < -85 THEN 1.0 ELSE 0.0 END), 6) AS clean_fraction FROM w WHERE value < 120 GROUP BY session_id")
def silence_features(spark, d):
    rows = Q.windows(spark, d).filter("value < 120").withColumn("db", -F.col("value"))
    return W.silence_features(rows, ["session_id"], "db").select("session_id", *[r6(F.col(c), c) for c in ("silence_median_db", "silence_std_db", "silence_range_db", "clean_fraction")])


EDGES = (0, 300, 1000, 2000, 4000, 6000, 8000)


@query(f"""WITH {Q.VECTORS}, t AS (SELECT vec_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS t FROM e), b AS (SELECT unnest(generate_series(0, 32)) AS bin), s AS (SELECT vec_id, bin, sum(x * cos(bin * t * 2 * pi() / 64)) AS re, sum(x * sin(bin * t * 2 * pi() / 64)) AS im FROM t CROSS JOIN b GROUP BY ALL),
  p AS (SELECT vec_id, bin * 250 AS hz, re * re + im * im AS p FROM s) SELECT vec_id, """ + ", ".join(f"round(sum(CASE WHEN hz >= {a} AND hz < {b} THEN p ELSE 0 END) / sum(p), 6) AS band_{a}_{b}" for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)) + " FROM p GROUP BY vec_id")
def dft_band_energy(spark, d):
    out = W.band_energy(Q.vectors(spark, d), ["vec_id"], "vector", 64, 16000, EDGES)
    return out.select("vec_id", *[r6(F.col(c), c) for c in out.columns if c != "vec_id"])


@query(f"WITH {Q.VECTORS}, {Q.CENTROIDS} SELECT identity, samples, generate_subscripts(centroid, 1) - 1 AS position, round(unnest(centroid), 6) AS value FROM c")
def enrol_centroid(spark, d):
    return V.centroids(Q.vectors(spark, d)).select("identity", "samples", F.posexplode("centroid").alias("position", "value")).select("identity", "samples", F.col("position").cast("long").alias("position"), r6(F.col("value"), "value"))


SPREADS = f"{Q.VECTORS}, {Q.CENTROIDS}, sp AS (SELECT c.identity, any_value(centroid) AS centroid, any_value(samples) AS samples, avg(1 - list_cosine_similarity(vector, centroid)) AS spread FROM e JOIN c USING (identity) GROUP BY c.identity)"


@query(f"WITH {SPREADS} SELECT identity, samples, round(spread, 6) AS spread FROM sp")
def enrol_spread(spark, d):
    v = Q.vectors(spark, d)
    return V.spreads(v, V.centroids(v)).select("identity", "samples", r6(F.col("spread"), "spread"))


@query(f"WITH {SPREADS}, x AS (SELECT vec_id, vector, (identity + vec_id % 3) AS claimed FROM e) SELECT vec_id, round(1 - list_cosine_similarity(vector, centroid), 6) AS distance, round((1 - list_cosine_similarity(vector, centroid)) / greatest(spread, 8e-4), 6) AS z FROM x LEFT JOIN sp ON sp.identity = claimed")
def enrol_compare(spark, d):
    v = Q.vectors(spark, d)
    claims = v.withColumn("identity", F.col("identity") + (F.col("vec_id") % 3).cast("int"))
    return V.compare(claims, V.spreads(v, V.centroids(v))).select("vec_id", r6(F.col("distance"), "distance"), r6(F.col("z"), "z"))


@query(f"""WITH {Q.VECTORS}, n AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY vec_id) AS i FROM e)
  SELECT a.vec_id, round(max(1 - list_cosine_similarity(a.vector, b.vector)), 6) AS drift, count(b.vec_id) AS seen FROM n a LEFT JOIN n b ON b.identity = a.identity AND b.i BETWEEN a.i - 12 AND a.i - 1 GROUP BY a.vec_id""")
def drift_last_twelve(spark, d):
    return V.drift(Q.vectors(spark, d), "identity", "vec_id").select("vec_id", r6(F.col("drift"), "drift"), F.col("seen").cast("long").alias("seen"))


@query(f"WITH {Q.MARKS}, r AS (SELECT *, rank() OVER (PARTITION BY language ORDER BY score) + (count(*) OVER (PARTITION BY language, score) - 1) / 2 AS k FROM m), g AS (SELECT language, sum(y) AS p, count(*) - sum(y) AS n, sum(k) FILTER (y = 1) AS u FROM r GROUP BY language) SELECT language, round(CASE WHEN p > 0 AND n > 0 THEN (u - p * (p + 1) / 2) / p / n ELSE 0.5 END, 6) AS auc FROM g")
def auc_by_group(spark, d):
    return M.auc(Q.marks(spark, d), ["language"]).select("language", r6(F.col("auc"), "auc"))


ROC = f"{Q.MARKS}, c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM m GROUP BY score), ro AS (SELECT score AS threshold, sum(n) OVER (ORDER BY score DESC) / (SELECT sum(n) FROM c) AS fpr, sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM c) AS tpr FROM c UNION ALL SELECT NULL, 0, 0)"


@query(f"WITH {ROC} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ro")
def roc_points(spark, d):
    return M.roc(Q.marks(spark, d)).select(*[r6(F.col(c), c) for c in ("threshold", "fpr", "tpr")])


@query(f"""WITH {ROC}, s AS (SELECT *, fpr - 1 + tpr AS d, coalesce(threshold, 'inf'::DOUBLE) AS t FROM ro), o AS (SELECT *, lead(d) OVER w AS nd, lead(fpr) OVER w AS nf, lead(t) OVER w AS nt FROM s WINDOW w AS (ORDER BY t DESC)), x AS (SELECT * FROM o WHERE d < 0 AND nd >= 0)
  SELECT round(fpr + (-d / (nd - d)) * (nf - fpr), 6) AS eer, round(CASE WHEN isinf(t) THEN nt ELSE t + (-d / (nd - d)) * (nt - t) END, 6) AS eer_threshold FROM x""")
def equal_error_rate(spark, d):
    return M.eer(M.roc(Q.marks(spark, d))).select(r6(F.col("eer"), "eer"), r6(F.col("eer_threshold"), "eer_threshold"))


@query(f"""WITH {Q.MARKS}, c AS (SELECT language, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score < 0.5 AND y = 0) AS tn, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM m GROUP BY language), p AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM c)
  SELECT language, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(pr + re, 1e-9), 6) AS f1 FROM p""")
def confusion(spark, d):
    out = M.confusion(Q.marks(spark, d), ["language"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"WITH {Q.MARKS} SELECT t::DOUBLE AS threshold, round(count(*) FILTER (score >= t AND y = 0) / greatest(count(*) FILTER (y = 0), 1), 6) AS fpr, round(count(*) FILTER (score >= t AND y = 1) / greatest(count(*) FILTER (y = 1), 1), 6) AS tpr FROM m, (VALUES (0.35), (0.5), (0.6), (0.8)) v(t) GROUP BY t")
def threshold_rates(spark, d):
    return M.threshold_rates(Q.marks(spark, d)).select("threshold", r6(F.col("fpr"), "fpr"), r6(F.col("tpr"), "tpr"))


@query(f"WITH {Q.MARKS} SELECT CASE WHEN y = 0 THEN 'bonafide' ELSE method END AS method, count(*) AS n, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS flag_rate, round(avg(score), 6) AS mean_score FROM m GROUP BY 1")
def method_breakdown(spark, d):
    return M.method_breakdown(Q.marks(spark, d)).select("method", "n", r6(F.col("flag_rate"), "flag_rate"), r6(F.col("mean_score"), "mean_score"))


@query(f"WITH {Q.WINDOWS} SELECT session_id, round(quantile_cont(score, 0.75), 6) AS score FROM w GROUP BY session_id")
def utterance_quantile(spark, d):
    rows = Q.windows(spark, d).withColumn("y", F.lit(0)).withColumn("method", F.lit(""))
    return M.utterance_scores(rows, "session_id").select("session_id", r6(F.col("score"), "score"))


LEAK = "x AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, CASE WHEN l_linestatus = 'O' THEN 40 ELSE 0 END + l_quantity AS planted, 7.0::DOUBLE AS flat FROM lineitem)"


@query(f"""WITH {LEAK}, u AS (SELECT y, 'l_quantity' AS feature, l_quantity::DOUBLE AS v FROM x UNION ALL SELECT y, 'l_extendedprice', l_extendedprice FROM x UNION ALL SELECT y, 'l_discount', l_discount FROM x UNION ALL SELECT y, 'planted', planted::DOUBLE FROM x UNION ALL SELECT y, 'flat', flat FROM x),
  r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS k FROM u), g AS (SELECT feature, sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS n, sum(k) FILTER (y = 1) AS s, stddev_pop(v) AS sd, avg(v) FILTER (y = 0) AS a, avg(v) FILTER (y = 1) AS b FROM r GROUP BY feature),
  q AS (SELECT *, (s - p * (p + 1) / 2) / p / n AS auc FROM g WHERE sd >= 1e-12) SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, CASE WHEN auc > 0.5 THEN 'higher_in_spoof' ELSE 'higher_in_genuine' END AS direction, round(a, 4) AS genuine_mean, round(b, 4) AS spoof_mean FROM q WHERE greatest(auc, 1 - auc) >= 0.9""")
def leakage_flags(spark, d):
    y = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    rows = Q.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", y.alias("y"), (y * 40 + F.col("l_quantity")).alias("planted"), F.lit(7.0).alias("flat"))
    out = M.leakage(rows, ["l_quantity", "l_extendedprice", "l_discount", "planted", "flat"])
    return out.select("feature", r6(F.col("auc"), "auc"), "direction", F.round("genuine_mean", 4).alias("genuine_mean"), F.round("spoof_mean", 4).alias("spoof_mean"))


@query(f"""WITH {Q.EVIDENCE}, {Q.rules_sql()}, y AS (SELECT feature, value, CASE WHEN window_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM feat WHERE value IS NOT NULL), q AS (SELECT feature, quantile_cont(value, [0.25, 0.02, 0.75, 0.98]) AS q, count(*) AS samples FROM y WHERE y = 0 GROUP BY feature),
  k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS k FROM y), a AS (SELECT feature, (sum(k) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / sum(y)::DOUBLE / (count(*) - sum(y)) AS auc FROM k GROUP BY feature),
  j AS (SELECT r.feature, low, high, weight, samples, CASE WHEN high > low THEN q[3] ELSE q[1] END AS lo, CASE WHEN high > low THEN q[4] ELSE q[2] END AS hi, CASE WHEN high > low THEN auc ELSE 1 - auc END AS o FROM rules r LEFT JOIN q USING (feature) LEFT JOIN a USING (feature))
  SELECT feature, CASE WHEN samples IS NULL OR samples < 40 THEN 'kept defaults (too few samples)' WHEN abs(hi - lo) < 1e-9 THEN 'kept defaults (no spread in genuine speech)' WHEN o < 0.55 THEN 'pruned' ELSE 'refitted' END AS action,
    round(CASE WHEN samples IS NULL OR samples < 40 OR abs(hi - lo) < 1e-9 THEN low ELSE lo END, 6) AS fitted_low, round(CASE WHEN samples IS NULL OR samples < 40 OR abs(hi - lo) < 1e-9 THEN high ELSE hi END, 6) AS fitted_high,
    round(CASE WHEN samples IS NULL OR samples < 40 OR abs(hi - lo) < 1e-9 THEN weight WHEN o < 0.55 THEN 0 ELSE weight * least(greatest(0.6 + 1.6 * (o - 0.5), 0.6), 1.6) END, 6) AS fitted_weight, coalesce(samples, 0) AS samples, round(CASE WHEN samples IS NULL OR samples < 40 OR abs(hi - lo) < 1e-9 THEN NULL ELSE o END, 6) AS auc FROM j""")
def rule_anchors(spark, d):
    values = Q.features(spark, d).select("window_id", F.explode("features").alias("feature", "value")).withColumn("y", F.when(F.col("window_id") % 3 == 0, 1).otherwise(0))
    out = M.fitted_rules(values, dims.rules(spark))
    return out.withColumns({c: F.round(c, 6) for c in ("fitted_low", "fitted_high", "fitted_weight", "auc")})


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT round(median(v), 6) AS p50, round(max(v) FILTER (i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)), 6) AS p95, round(max(v) FILTER (i = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)), 6) AS p99, round(avg(v), 4) AS mean, max(v) AS max FROM s")
def latency_percentiles(spark, d):
    out = M.latency_percentiles(Q.table(spark, d, "lineitem"), "l_extendedprice")
    return out.select(r6(F.col("p50"), "p50"), r6(F.col("p95"), "p95"), r6(F.col("p99"), "p99"), F.round("mean", 4).alias("mean"), "max")


@query(f"""WITH RECURSIVE {Q.MARKS}, z AS (SELECT doc_id, score, 1 - quality AS y, ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS z FROM m WHERE quality IS NOT NULL), e AS (SELECT ln((1 - 1e-6) / 1e-6) AS e),
  t AS (SELECT avg(z) AS z, count(*) AS n, sum(y) AS pos FROM z, e GROUP BY floor((z + e) / (2 * e) * 4096)), s AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b
    UNION ALL SELECT i + 1, any_value(a) - 0.15::DOUBLE * sum((n / (1 + exp(-greatest(-60, least(60, a * z + b)))) - pos) * z) / sum(n), any_value(b) - 0.15::DOUBLE * sum(n / (1 + exp(-greatest(-60, least(60, a * z + b)))) - pos) / sum(n) FROM s, t WHERE i < 200 GROUP BY i)
  SELECT doc_id, round(1 / (1 + exp(-(a * ln(least(greatest(score, 1e-4), 1 - 1e-4) / (1 - least(greatest(score, 1e-4), 1 - 1e-4))) + b))), 6) AS calibrated FROM z, s WHERE i = 200""")
def platt_calibration(spark, d):
    rows = Q.marks(spark, d).filter("quality is not null").withColumn("y", 1 - F.col("quality"))
    a, b = M.platt(rows)
    return rows.select("doc_id", r6(M.calibrated(F.col("score"), a, b), "calibrated"))


TRANSCRIPT = "replace(replace(text, ' the ', ' urgent '), ' of ', ' share the code ')"


@query(f"""WITH t AS (SELECT conv_id, turn, lower({TRANSCRIPT}) AS t FROM conversations) SELECT conv_id, turn, """ + " + ".join("CASE WHEN regexp_matches(t, '{}') THEN 1 ELSE 0 END".format(x.replace("'", "''")) for x in dims.URGENCY) + " AS hits FROM t")
def urgency_hits(spark, d):
    return Q.table(spark, d, "conversations").select("conv_id", "turn", F.size(T.urgency_hits(F.expr(TRANSCRIPT))).alias("hits"))


@query()
def redact_text(spark, d):
    """Every document, null and non-ASCII text included. No SQL: DuckDB's \\b and \\w know
    ASCII only; tests hold it against Python's expressions."""
    return Q.table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


@query("SELECT c_custkey, 'h:' || substr(sha256('pepper:' || c_name), 1, 16) AS hashed, CASE WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) < 4 THEN '***' ELSE repeat('*', length(regexp_replace(c_name, '[^0-9]', '', 'g')) - 4) || right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) END AS masked FROM customer")
def hash_and_mask(spark, d):
    return Q.table(spark, d, "customer").select("c_custkey", T.hash_identifier(F.col("c_name"), "pepper").alias("hashed"), T.mask_number(F.col("c_name")).alias("masked"))


@query("SELECT c_custkey, 'h:' || substr(sha256('pepper:' || c_name), 1, 16) AS customer_id, c_mktsegment AS segment FROM customer")
def anonymized_context(spark, d):
    m = T.anonymize_map(F.create_map(F.lit("customer_id"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")), "pepper")
    return Q.table(spark, d, "customer").select("c_custkey", m["customer_id"].alias("customer_id"), m["segment"].alias("segment"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_round_trip(spark, d):
    v = T.loads(F.col("props"), "struct<k:int>")
    return Q.table(spark, d, "events").select("event_id", v["k"].alias("k"), T.dumps(v).alias("again"))


def _stored(spark, d) -> DataFrame:
    e = Q.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.col("user_id").alias("session_id"), at.alias("created_at"), F.when(F.col("event_type") != "view", F.col("props")).alias("features"), F.when(F.col("user_id") % 3 == 0, at).alias("closed_at"), "value")


NOW, TTL, RAW_TTL = 1706659200.0, 864000.0, 21600.0
STORED = "st AS (SELECT event_id, user_id AS session_id, epoch_us(ts) / 1e6 AS created_at, CASE WHEN event_type <> 'view' THEN props END AS features, CASE WHEN user_id % 3 = 0 THEN epoch_us(ts) / 1e6 END AS closed_at, value FROM events)"


@query(f"WITH {STORED} SELECT event_id, CASE WHEN created_at >= {NOW - min(TTL, max(4 * RAW_TTL, 3600))} THEN features END AS features FROM st WHERE created_at >= {NOW - TTL}")
def retention_sweep(spark, d):
    s = _stored(spark, d)
    return P.swept(s, s, s, NOW, TTL, RAW_TTL)[0].select("event_id", "features")


@query(f"WITH {STORED} SELECT count(*) FILTER (created_at < {NOW - TTL}) AS assessments, count(*) FILTER (features IS NOT NULL AND created_at >= {NOW - TTL} AND created_at < {NOW - min(TTL, max(4 * RAW_TTL, 3600))}) AS feature_blobs FROM st")
def retention_counts(spark, d):
    return P.sweep_counts(_stored(spark, d), NOW, TTL, RAW_TTL)


@query(f"WITH {STORED} SELECT event_id FROM st WHERE created_at >= {NOW - TTL} OR closed_at IS NULL")
def open_sessions_stay(spark, d):
    s = _stored(spark, d)
    return P.swept(s, s, s, NOW, TTL, RAW_TTL)[2].select("event_id")


@query("SELECT 'assessments' AS \"table\", count(*) AS rows FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 300) UNION ALL SELECT 'alerts', count(*) FROM events WHERE value > 60 AND user_id IN (SELECT user_id FROM events WHERE value > 300)")
def erasure_counts(spark, d):
    s = _stored(spark, d)
    return P.erasure_counts({"assessments": s, "alerts": s.filter("value > 60")}, s.filter("value > 300").select("session_id").distinct(), "session_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300)")
def purged_sessions(spark, d):
    s = _stored(spark, d)
    return P.purged(s, s.filter("value > 300").select("session_id").distinct(), "session_id").select("event_id")


@query("SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS lengths, grouping(lang) AS no_lang, grouping(source) AS no_source FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def corpus_summary(spark, d):
    from ..sources.corpus import summary

    return summary(Q.table(spark, d, "documents"), "lang", "source", "n_chars")


@query()
def speaker_split(spark, d):
    rows = Q.table(spark, d, "documents").select("doc_id", F.col("source").alias("speaker"))
    return M.split_by_speaker(rows).groupBy("speaker", "is_test").agg(F.count("*").alias("n"))


@query(f"WITH {Q.MARKS} SELECT 'train' AS side, method, y, count(*) AS n FROM m WHERE method <> 'src1' GROUP BY ALL UNION ALL SELECT 'test', method, y, count(*) FROM m WHERE method = 'src1' OR y = 0 GROUP BY ALL")
def holdout_split(spark, d):
    train, test = M.holdout_method(Q.marks(spark, d), "src1")
    count = lambda df, side: df.groupBy("method", "y").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "method", "y", "n")
    return count(train, "train").unionByName(count(test, "test"))


@query("SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_events(spark, d):
    return R.recent(Q.table(spark, d, "events"), "ts", 50, "event_id").select("event_id", "user_id", "value")


LATEST = "la AS (SELECT user_id AS session_id, max(ts) AS last_activity, max_by(value, ts) AS score FROM events GROUP BY user_id)"


@query(f"WITH {LATEST} SELECT session_id, score FROM la ORDER BY CASE WHEN session_id % 3 <> 0 THEN 0 ELSE 1 END, last_activity DESC, session_id LIMIT 120")
def live_then_closed(spark, d):
    e = Q.table(spark, d, "events").withColumnRenamed("user_id", "session_id").withColumnRenamed("ts", "last_activity")
    rows = R.latest(e.select("session_id", "last_activity", F.col("value").alias("score")), "session_id", "last_activity")
    return R.live_then_closed(rows.filter("session_id % 3 <> 0"), rows.filter("session_id % 3 = 0"), "last_activity", 120, "session_id").select("session_id", "score")


@query("WITH li AS (SELECT user_id AS session_id, max(value) AS score FROM events WHERE event_type = 'error' GROUP BY user_id), st AS (SELECT c_custkey AS session_id, c_acctbal AS score FROM customer) SELECT coalesce(li.session_id, st.session_id) AS session_id, coalesce(li.score, st.score) AS score FROM li FULL JOIN st ON li.session_id = st.session_id")
def live_or_stored(spark, d):
    live = Q.table(spark, d, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("session_id")).agg(F.max("value").alias("score"))
    stored = Q.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_acctbal").alias("score"))
    return R.live_or_stored(live, stored, "session_id")


@query("SELECT 'events' AS \"table\", count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def table_counts(spark, d):
    from ..sources.tables import counts

    return counts({n: Q.table(spark, d, n) for n in ("events", "orders", "customer")})


@query("SELECT c_custkey, 2595 * log10(1 + c_acctbal / 700) AS mel FROM customer WHERE c_acctbal >= 0".replace("2595 * log10(1 + c_acctbal / 700) AS mel", "round(2595 * log10(1 + c_acctbal / 700), 6) AS mel, round(c_acctbal, 4) AS hz"))
def mel_scale(spark, d):
    mel = X.hz_to_mel(F.col("c_acctbal"))
    return Q.table(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey", r6(mel, "mel"), F.round(X.mel_to_hz(mel), 4).alias("hz"))


@query(f"""WITH {Q.WINDOWS}, {Q.LAYERS}, x AS (SELECT f.session_id, f.window_index, f.confidence, w.k, w.event_type FROM fused f JOIN w ON w.session_id = f.session_id AND w.window_index = f.window_index)
  SELECT session_id, window_index, CASE WHEN (window_index + 2) / 2 < 3 THEN 1 ELSE 0 END + CASE WHEN k / 100 < 0.35 THEN 1 ELSE 0 END + CASE WHEN event_type NOT IN ('click', 'signup') THEN 1 ELSE 0 END + CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END + 1 AS caveats,
    concat_ws(' | ', """ + ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in (("(window_index + 2) / 2 < 3", f"printf('{dims.CAVEATS['short']}', (window_index + 2) / 2)"), *((w, f"'{dims.CAVEATS[k]}'") for w, k in (("k / 100 < 0.35", "silent"), ("event_type NOT IN ('click', 'signup')", "no_speaker"), ("confidence < 0.5", "unsure"), ("true", "heuristic"))))) + ") AS texts FROM x")
def caveat_counts(spark, d):
    c = S.caveats((F.col("window_index") + 2) / 2, F.col("k") / 100, F.col("fusion.excluded"), F.col("fusion.confidence"), F.lit(True), F.lit(0.0))
    return _fused(spark, d).select("session_id", "window_index", F.size(c).alias("caveats"), F.array_join(c, " | ").alias("texts"))


@query(f"""WITH {RULE_ROWS}, r AS (SELECT window_id, feature AS code, contribution, row_number() OVER (PARTITION BY window_id ORDER BY contribution DESC, feature) AS n, count(*) OVER (PARTITION BY window_id) AS judged FROM ev)
  SELECT window_id, any_value(judged) AS judged, coalesce(string_agg(code, ',' ORDER BY n) FILTER (contribution > 0.01 AND n <= 4), '') AS shown FROM r GROUP BY window_id""")
def explained_windows(spark, d):
    ev = S.rule_evidence(Q.features(spark, d), dims.rules(spark), ["window_id"])
    rows = ev.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").alias("code"), "label", "contribution"))).alias("factors"))
    return rows.select("window_id", F.size("factors").cast("long").alias("judged"), F.array_join(F.transform(S.explanation_factors(F.col("factors")), lambda f: f["code"]), ",").alias("shown"))


def _signals(spark, d, run: int = 80) -> DataFrame:
    """Runs of so many vectors in a row as signals of 64 samples each."""
    e = Q.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / run).alias("window_id"), "vec_id", "embedding")
    rows = e.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("x")))).alias("rows"))
    return rows.select("window_id", F.flatten(F.transform("rows", lambda r: r["x"])).alias("samples"))


@query()
def signal_features(spark, d):
    from ..operators.features import extract

    return extract(_signals(spark, d), ["window_id"]).select("window_id", F.size("features").alias("features"), F.round(F.col("features")["spec_centroid_mean"], 3).alias("spec_centroid_mean"), F.round(F.col("features")["comb_strength"], 6).alias("comb_strength"))


@query()
def second_windows(spark, d):
    """All features of one-second windows, in their fixed order."""
    from ..operators.features import extract, feature_names, vector

    rows = extract(_signals(spark, d, 250), ["window_id"])
    return rows.select("window_id", F.size("features").alias("features"), F.transform(vector(F.col("features"), feature_names()), lambda v: F.round(v, 6)).alias("vector"))


@query()
def trained_scores(spark, d):
    from ..ml import training as L

    docs = Q.marks(spark, d).select("doc_id", F.col("quality").cast("int").alias("y"), "method", "n_chars", F.col("score").alias("fraction"), F.length("language").alias("width"))
    rows = docs.filter("y is not null").withColumn("speaker", F.col("doc_id") % 25)
    names = ["n_chars", "fraction", "width"]
    model, calibration, _ = L.train(rows, names, "logistic")
    return L.predict(model, L.aligned(rows, names)).select("doc_id", r6(M.calibrated(F.col("score"), *calibration), "score"))


@query(f"""WITH RECURSIVE {JUDGED}, r AS (SELECT session_id, max_by(band, window_index) AS band, max_by(smoothed, window_index) AS score, max(smoothed) AS peak, (max(window_index) * 8000 + 16000) / 16000 AS seconds FROM j GROUP BY session_id),
  vd AS (SELECT *, CASE WHEN seconds < 2 THEN 'insufficient_audio' WHEN peak >= 80 THEN 'likely_synthetic' WHEN peak >= 60 THEN 'suspicious' WHEN peak >= 35 THEN 'inconclusive' ELSE 'likely_genuine' END AS verdict FROM r)
  SELECT session_id, verdict, band IN ('HIGH', 'CRITICAL') AS is_high_risk, verdict IN ('likely_synthetic', 'suspicious') AS is_synthetic, verdict IN ('insufficient_audio', 'inconclusive') AS inconclusive,
    printf('Risk %.0f/100 (%s)', score, band) || chr(10) || '  -> ' || CASE band {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.ACTIONS.items())} END AS explained FROM vd""")
def call_results(spark, d):
    """What a caller asks of each call's report."""
    report = R.session_report(_judged(spark, d))
    none = F.array().cast("array<struct<label:string,detail:string>>")
    out = R.result_flags(report.select("session_id", "verdict", "band", F.col("final_score").alias("score"), F.lit("").alias("headline"), X.lookup(F.col("band"), dims.ACTIONS, "").alias("action"), none.alias("factors"), F.array().cast("array<string>").alias("caveats")))
    return out.select("session_id", "verdict", "is_high_risk", "is_synthetic", "inconclusive", "explained")


@query(f"""WITH RECURSIVE {JUDGED}, g AS (SELECT session_id, max_by(smoothed, window_index) AS score, max_by(band, window_index) AS band, max(smoothed) AS peak, count(*) AS n FROM j GROUP BY session_id), t AS (SELECT user_id AS session_id, max(epoch_us(ts)) / 1000000 AS last, count(*) FILTER (event_type = 'error') AS alerts FROM events GROUP BY user_id)
  SELECT session_id, session_id % 3 <> 0 AS open, round(last, 3) AS last_activity, CASE WHEN session_id % 3 = 0 THEN 'done' END AS profile, round(score, 1) AS score, band, round(peak, 1) AS peak_score, n AS windows_analyzed, CASE WHEN session_id % 3 = 0 THEN 7 ELSE alerts END AS alerts_raised FROM g JOIN t USING (session_id)""")
def live_sessions(spark, d):
    """How each call stands: two of three are still open, every error is an alert."""
    order = ["session_id", "window_index"]
    w = _judged(spark, d).join(Q.windows(spark, d).select(*order, "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), order)
    kinds = F.explode(F.array_compact(F.array(F.lit("window"), F.when(F.col("event_type") == "error", "alert")))).alias("kind")
    peak = F.max("smoothed").over(W.Window.partitionBy("session_id").orderBy("window_index")).alias("peak")
    rows = w.select("session_id", "window_index", F.col("smoothed").alias("score"), "band", peak, "at", "event_type", F.lit(None).cast("string").alias("payload")).select("*", kinds)
    told = F.to_json(F.struct(F.lit("done").alias("profile"), F.col("x.score").alias("final_score"), F.col("peak").alias("peak_score"), F.col("x.band").alias("band"), F.struct(F.col("n").alias("windows_analyzed"), F.lit(7).alias("alerts_raised")).alias("stats")))
    ends = rows.filter("kind = 'window' and session_id % 3 = 0").groupBy("session_id").agg(F.max_by(F.struct("score", "band"), "window_index").alias("x"), F.max("peak").alias("peak"), F.count("*").alias("n"), F.max("at").alias("at")).select("session_id", F.lit("closed").alias("kind"), told.alias("payload"), "at")
    out = R.session_views(rows.unionByName(ends, allowMissingColumns=True))
    return out.select("session_id", "open", X.rounded(F.col("last_activity"), 3).alias("last_activity"), "profile", "score", "band", "peak_score", "windows_analyzed", "alerts_raised")


@query()
def recording_answers(spark, d):
    """Runs of 500 vectors as recordings of two seconds, from bytes to an answer each."""
    from ..operators import call as C

    rows = _signals(spark, d, 500)
    pcm = rows.select("window_id", F.transform("samples", lambda x: x.cast("float")).alias("samples"))
    from ..sources.audio import to_pcm16

    out = C.answers(C.recordings_judged(pcm.select(F.col("window_id").cast("string").alias("name"), to_pcm16(F.col("samples")).alias("content")), "name", "content"))
    return out.select("session_id", "verdict", "score", "peak_score", "band", "duration_seconds", "windows_analyzed", F.size("timeline").alias("points"), "n_alerts")


SPECTRA_BANDS = ((0, 300), (300, 1000), (1000, 2000), (2000, 4000), (4000, 6000), (6000, 8000))
SHAPES = ("spec_centroid", "spec_spread", "spec_rolloff85", "spec_rolloff95", "spec_flatness", "spec_entropy", "spec_slope", "spec_flux", "spec_crest")
SPECTRAL = tuple(f"{n}_{s}" for n in (*SHAPES, *(f"mfcc{i}" for i in range(13))) for s in ("mean", "std"))
SPECTRAL += tuple(f"band_{a}_{b}" for a, b in SPECTRA_BANDS) + ("mfcc_delta_energy", "mfcc_delta_std", "env_roughness", "env_second_diff", "env_lag1_autocorr", "mel_frame_corr")


@query(f"""WITH e AS (SELECT vec_id // 80 AS window_id, row_number() OVER (PARTITION BY vec_id // 80 ORDER BY vec_id) - 1 AS r, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  x AS (SELECT window_id, flatten(list(x ORDER BY r)) AS x FROM e GROUP BY window_id), hann AS (SELECT list(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 511) ORDER BY k) AS h FROM range(512) AS r(k)),
  fr AS (SELECT window_id, t, list_transform(list_zip(x[t * 160 + 1:t * 160 + 512], h), lambda z: z[1] * z[2]) AS f FROM (SELECT *, unnest(range((len(x) - 512) // 160 + 1)) AS t FROM x WHERE len(x) >= 4000), hann),
  ba AS (SELECT b, list(cos(2 * pi() * (b * k % 512) / 512) ORDER BY k) AS c, list(sin(2 * pi() * (b * k % 512) / 512) ORDER BY k) AS s FROM range(257) AS q(b), range(512) AS r(k) GROUP BY b),
  sp AS MATERIALIZED (SELECT window_id, t, b, b * 31.25::DOUBLE AS hz, pow(list_dot_product(f, c), 2) + pow(list_dot_product(f, s), 2) AS p FROM fr, ba),
  tot AS (SELECT *, sum(p) OVER (PARTITION BY window_id, t) + 1e-12 AS total, sqrt(p) AS mag FROM (SELECT window_id, t, b, hz, greatest(p, 1e-24) AS p FROM sp)),
  up AS (SELECT *, sum(p / total) OVER (PARTITION BY window_id, t ORDER BY b) AS up, ln(hz + 1) - avg(ln(hz + 1)) OVER (PARTITION BY window_id, t) AS lf, mag / sqrt(sum(p) OVER (PARTITION BY window_id, t)) AS unit FROM tot),
  fl AS (SELECT a.window_id, a.t, sqrt(sum(pow(a.unit - b.unit, 2))) AS flux FROM up a JOIN up b ON a.window_id = b.window_id AND a.t = b.t + 1 AND a.b = b.b GROUP BY ALL),
  sh AS (SELECT window_id, t, sum(p / total * hz) AS spec_centroid, sqrt(greatest(sum(p / total * hz * hz) - pow(sum(p / total * hz), 2), 0)) AS spec_spread, min(hz) FILTER (up >= 0.85::DOUBLE) AS spec_rolloff85, min(hz) FILTER (up >= 0.95::DOUBLE) AS spec_rolloff95,
    exp(avg(ln(p))) / (avg(p) + 1e-12) AS spec_flatness, -sum(p / total * ln(p / total + 1e-12)) / ln(257) AS spec_entropy, sum(ln(p) * lf) / sum(lf * lf) AS spec_slope, coalesce(any_value(flux), 0) AS spec_flux, max(mag) / (avg(mag) + 1e-12) AS spec_crest FROM up LEFT JOIN fl USING (window_id, t) GROUP BY window_id, t),
  pt AS (SELECT m, 700 * (pow(10, (low + (2595 * log10(1 + 8000 / 700::DOUBLE) - low) * m / 41) / 2595) - 1) AS p FROM range(42) AS r(m), (SELECT 2595 * log10(1 + 20 / 700::DOUBLE) AS low)),
  fb AS (SELECT a.m, b, greatest(least((b * 31.25::DOUBLE - a.p) / (k.p - a.p), (z.p - b * 31.25::DOUBLE) / (z.p - k.p)), 0) * 2 / (z.p - a.p) AS w FROM pt a JOIN pt k ON k.m = a.m + 1 JOIN pt z ON z.m = a.m + 2, range(257) AS r(b)),
  me AS MATERIALIZED (SELECT window_id, t, m, sum(p * w) AS mel FROM sp JOIN fb USING (b) GROUP BY ALL),
  ce AS MATERIALIZED (SELECT window_id, t, i, sum(ln(mel + 1e-8) * cos(pi() * (m + 0.5::DOUBLE) * i / 40)) * sqrt(CASE i WHEN 0 THEN 1 ELSE 2 END / 40) AS c FROM me, range(20) AS r(i) GROUP BY window_id, t, i),
  de AS (SELECT (coalesce(lead(c) OVER o, c) - coalesce(lag(c) OVER o, c) + 2 * (coalesce(lead(c, 2) OVER o, lead(c) OVER o, c) - coalesce(lag(c, 2) OVER o, lag(c) OVER o, c))) / 10 AS d, window_id FROM ce WINDOW o AS (PARTITION BY window_id, i ORDER BY t)),
  en AS (SELECT window_id, t, ln(sum(mel) + 1e-8) AS e, sqrt(sum(mel * mel)) + 1e-12 AS norm FROM me GROUP BY ALL),
  ed AS (SELECT window_id, e - avg(e) OVER (PARTITION BY window_id) AS e, lag(e) OVER o - avg(e) OVER (PARTITION BY window_id) AS e1, e - lag(e) OVER o AS d1, e - 2 * lag(e) OVER o + lag(e, 2) OVER o AS d2 FROM en WINDOW o AS (PARTITION BY window_id ORDER BY t)),
  fc AS (SELECT a.window_id, a.t, sum(a.mel * b.mel) / any_value(x.norm * y.norm) AS c FROM me a JOIN me b ON a.window_id = b.window_id AND a.m = b.m AND a.t = b.t + 1 JOIN en x ON x.window_id = a.window_id AND x.t = a.t JOIN en y ON y.window_id = b.window_id AND y.t = b.t GROUP BY a.window_id, a.t),
  u AS (SELECT window_id, feature || '_mean' AS feature, avg(v) AS v FROM (UNPIVOT sh ON COLUMNS(* EXCLUDE (window_id, t)) INTO NAME feature VALUE v) GROUP BY ALL UNION ALL SELECT window_id, feature || '_std', stddev_pop(v) FROM (UNPIVOT sh ON COLUMNS(* EXCLUDE (window_id, t)) INTO NAME feature VALUE v) GROUP BY ALL
    UNION ALL SELECT window_id, 'mfcc' || i || '_mean', avg(c) FROM ce WHERE i < 13 GROUP BY ALL UNION ALL SELECT window_id, 'mfcc' || i || '_std', stddev_pop(c) FROM ce WHERE i < 13 GROUP BY ALL
    UNION ALL SELECT window_id, 'mfcc_delta_energy', avg(abs(d)) FROM de GROUP BY ALL UNION ALL SELECT window_id, 'mfcc_delta_std', stddev_pop(d) FROM de GROUP BY ALL
    """ + "".join(f"UNION ALL SELECT window_id, 'band_{a}_{b}', sum(p) FILTER (hz >= {a} AND hz < {b}) / (sum(p) + 1e-12) FROM tot GROUP BY ALL " for a, b in SPECTRA_BANDS) + """
    UNION ALL SELECT window_id, 'env_roughness', avg(abs(d1)) / (stddev_pop(e) + 1e-12) FROM ed GROUP BY ALL UNION ALL SELECT window_id, 'env_second_diff', avg(abs(d2)) / (stddev_pop(e) + 1e-12) FROM ed GROUP BY ALL
    UNION ALL SELECT window_id, 'env_lag1_autocorr', sum(e * e1) / (sum(e * e) + 1e-12) FROM ed GROUP BY ALL UNION ALL SELECT window_id, 'mel_frame_corr', avg(c) FROM fc GROUP BY ALL)
  SELECT window_id, feature, round(v, 6) AS value FROM u""")
def spectral_features(spark, d):
    """Shape, bands, cepstra, their changes and the loudness envelope, from a short-time transform of each signal."""
    from ..operators.features import extract

    rows = extract(_signals(spark, d), ["window_id"]).select("window_id", F.explode("features").alias("feature", "value"))
    return rows.filter(F.col("feature").isin(*SPECTRAL)).select("window_id", "feature", r6(F.col("value"), "value"))


@query(f"""WITH {Q.VECTORS}, x AS (SELECT vec_id, vector AS v, len(vector) AS n, list_max(list_transform(vector, lambda x: abs(x))) AS peak FROM e),
  p AS (SELECT *, list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - 0.97::DOUBLE * v[i - 1] END) AS pre, list_transform(range(1, n // 2 + 1), lambda i: (v[2 * i - 1] + v[2 * i]) / 2 / 0.25::DOUBLE) AS mono FROM x),
  m AS (SELECT *, greatest(1, list_max(list_transform(mono, lambda x: abs(x)))) AS over, list_position(v, list_max(v)) AS top FROM p)
  SELECT vec_id, n / 16000 AS seconds, round(list_sum(list_transform(pre, lambda x, i: x * i)), 6) AS emphasized, round(list_sum(list_transform(v, lambda x, i: x * (0.95::DOUBLE / peak) * i)), 6) AS normalized, round(list_sum(list_transform(mono, lambda x, i: x / over * i)), 6) AS mono,
    round(CASE WHEN top IN (1, n) THEN top WHEN abs(v[top - 1] - 2 * v[top] + v[top + 1]) < 1e-12 THEN top ELSE top + 0.5::DOUBLE * (v[top - 1] - v[top + 1]) / (v[top - 1] - 2 * v[top] + v[top + 1]) END, 6) AS peak_at FROM m""")
def sample_forms(spark, d):
    """Vectors as samples: length, emphasis, level, two channels as one, the place of the peak. Arrays are told by
    the sum of value times position."""
    v = F.col("vector")
    told = lambda xs: X.total(F.transform(xs, lambda x, i: x * (i + 1)))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(v) / 2).cast("int")), lambda i: F.slice(v, 2 * i - 1, 2))
    top = F.array_position(v, F.array_max(v)).cast("int")
    inner = F.when((top > 1) & (top < F.size(v)), X.parabolic_peak(F.get(v, top - 2), F.get(v, top - 1), F.get(v, top), top)).otherwise(top)
    return Q.vectors(spark, d).select("vec_id", X.duration_seconds(v).alias("seconds"), r6(told(X.preemphasis(v)), "emphasized"), r6(told(X.peak_normalize(v)), "normalized"), r6(told(X.float_mono(pairs, 0.25)), "mono"), r6(inner, "peak_at"))


#: Reasons that stand beside alerts, by how many there are.
REASONS = [(r[1], r[0]) for r in dims.ACOUSTIC_RULES[:3]]
CHANNELS_SQL = "ch(profile, own) AS (VALUES " + ", ".join(f"('{p[0]}', {p[4]!r})" for p in dims.PROFILES) + ")"


@query(f"""WITH {Q.WINDOWS}, {PROFILES_SQL}, {CHANNELS_SQL}, b AS (SELECT event_id, session_id, score, k, {EVENT_PROFILE} AS profile, {BAND.format(s='score')} AS band FROM w LEFT JOIN p ON p.profile = {EVENT_PROFILE}),
  a AS (SELECT *, CASE band {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.ACTIONS.items())} END AS action, {[r[0] for r in REASONS]!r}[:k % 4] AS labels, {[f"  - {a}: {b}" for a, b in REASONS]!r}[:k % 4] AS told, printf('%.0f', round_even(score, 0)) AS shown FROM b),
  t AS (SELECT *, '[' || band || '] Call ' || session_id || ': risk ' || shown || '/100. ' || CASE WHEN len(labels) > 0 THEN array_to_string(labels[:2], '; ') ELSE 'no single dominant factor' END || '. ' || action AS line FROM a)
  SELECT event_id, line, substr(line, 1, 160) AS sms, 'Call ' || session_id || chr(10) || chr(10) || 'Risk score: ' || shown || '/100 (' || band || ')' || chr(10) || 'Recommended action: ' || action || chr(10) || chr(10) || array_to_string(list_prepend('Contributing factors:', told), chr(10)) AS email,
    CASE WHEN len(list_filter(own, lambda c: c IN ('websocket', 'sms'))) > 0 THEN array_to_string(list_filter(own, lambda c: c IN ('websocket', 'sms')), ',') ELSE 'console' END AS channels FROM t LEFT JOIN ch USING (profile)""")
def alert_messages(spark, d):
    """What each channel would say of every window, and the channels that its profile may use."""
    w = S.banded(_event_profile(Q.windows(spark, d)), dims.profiles(spark), "score").join(dims.profiles(spark).select("profile", "alert_channels"), "profile", "left")
    some = F.slice(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("detail")) for a, b in REASONS]), F.lit(1), F.col("k") % 4)
    action, session = X.lookup(F.col("band"), dims.ACTIONS, ""), F.col("session_id").cast("string")
    line = T.alert_text(F.col("band"), session, F.col("score"), F.transform(some, lambda f: f["label"]), action)
    return w.select("event_id", line.alias("line"), T.sms(line).alias("sms"), T.email_body(F.concat(F.lit("Call "), session), F.col("score"), F.col("band"), action, some).alias("email"), F.array_join(R.channels_for(F.col("alert_channels"), ["websocket", "sms"]), ",").alias("channels"))


CONSENTS = ("recorded", "Analysed", "none-required", "no", "")
CONTEXT_SQL = {
    "caller_number": "'\"+91' || request_id || '\"'", "claimed_identity": "CASE WHEN request_id % 9 <> 0 THEN '\"c' || session_id || '\"' END", "claimed_role": "'\"' || claimed_role || '\"'", "known_contact": "known_contact", "caller_id_verified": "caller_id_verified", "origin": "'\"' || origin || '\"'",
    "transaction_amount": "CAST(amount AS DECIMAL(18,2))", "local_hour": "local_hour", "prior_fraud_reports": "prior_fraud_reports", "account_age_days": "account_age_days", "first_contact": "first_contact", "transcript": "'\"' || transcript || '\"'",
}


@query(f"""WITH {Q.REQUESTS} SELECT request_id, '{{' || concat_ws(',', {", ".join(f"'{chr(34)}{n}{chr(34)}:' || {e}" for n, e in CONTEXT_SQL.items())}) || '}}' AS context, coalesce(lower({list(CONSENTS)!r}[request_id % 6 + 1]) IN ('recorded', 'analysed', 'analyzed', 'none-required'), false) AS consented,
    CASE request_id % 3 WHEN 0 THEN 'Privacy mode: scores only — no audio and no voice features are stored.' WHEN 1 THEN 'Privacy mode: features only — no audio is written to disk. Feature vectors are deleted after ' || (session_id * 1000 // 3600) || ' h.'
      ELSE 'Privacy mode: RAW AUDIO RETAINED for ' || (session_id * 100 // 60) || ' min. This is opt-in and must be justified to your DPO.' END AS banner FROM r""")
def context_texts(spark, d):
    """Each request's call metadata as JSON without unknown facts, its consent header, and the notice of a retention policy."""
    k, own = F.col("request_id"), {"transaction_amount": F.col("amount").cast("decimal(18,2)")}
    own |= {"caller_number": F.concat(F.lit("+91"), k), "claimed_identity": F.when(k % 9 != 0, F.concat(F.lit("c"), "session_id"))}
    header = F.get(F.array(*map(F.lit, CONSENTS)), (k % 6).cast("int"))
    mode = F.when(k % 3 == 0, "none").when(k % 3 == 1, "features_only").otherwise("raw")
    return Q.requests(spark, d).select("request_id", T.context_json(lambda n: own.get(n, F.col(n))).alias("context"), F.coalesce(T.consented(header), F.lit(False)).alias("consented"), T.retention_banner(mode, F.col("session_id") * 1000, F.col("session_id") * 100).alias("banner"))


@query("""SELECT event_id, CAST(round(value, 2) AS DECIMAL(12,2))::DOUBLE AS amount, 1 AS numbers FROM events""")
def extra_facts(spark, d):
    """The numbers of a payload that are not known fields; text and known keys stay out."""
    payload = F.concat(F.lit('{"known":'), F.get_json_object("props", "$.k"), F.lit(',"note":"a","amount":'), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("}"))
    m = T.extra_numbers(payload, ["known"])
    return Q.table(spark, d, "events").select("event_id", m["amount"].alias("amount"), F.size(m).alias("numbers"))


@query(f"""WITH RECURSIVE {JUDGED}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_index DESC) AS n FROM j)
  SELECT session_id, count(*) AS windows_analyzed, string_agg(window_index || ':' || printf('%.1f', score) || ':' || band, ' ' ORDER BY window_index) FILTER (n <= 12) AS trail FROM k GROUP BY session_id""")
def report_trails(spark, d):
    """Each call's report with its last twelve assessments in order."""
    j = _judged(spark, d)
    out = R.report_with_trail(R.session_report(j), j, limit=12)
    told = F.transform("trail", lambda x: F.concat_ws(":", x["window_index"], F.format_string("%.1f", x["score"]), x["band"]))
    return out.select("session_id", "windows_analyzed", F.array_join(told, " ").alias("trail"))


@query(f"""WITH {Q.WINDOWS}, {Q.LAYERS}, c AS (SELECT session_id, window_index, layer, CAST(confidence AS DOUBLE) * (score - 0.5::DOUBLE) AS c FROM l),
  n AS (SELECT *, row_number() OVER (PARTITION BY session_id, window_index ORDER BY abs(c) DESC, CASE layer WHEN 'acoustic' THEN 0 WHEN 'prosodic' THEN 1 WHEN 'speaker' THEN 2 ELSE 3 END) AS rank FROM c)
  SELECT session_id, window_index, rank, layer AS code, round(c, 10) + 0.0 AS contribution FROM n WHERE rank <= 3""")
def top_weights(spark, d):
    """The three layers that weigh most in each window, either way."""
    pulls = F.transform("layers", lambda x: F.struct(x["layer"].alias("code"), (x["confidence"] * (x["score"] - 0.5)).alias("contribution")))
    rows = Q.layered(Q.windows(spark, d)).select("session_id", "window_index", F.posexplode(S.top_factors(pulls)).alias("n", "x"))
    return rows.select("session_id", "window_index", (F.col("n") + 1).cast("long").alias("rank"), "x.code", (F.round("x.contribution", 10) + 0.0).alias("contribution"))


@query("""WITH c AS (SELECT 'p' || c_custkey AS profile, 20.0::DOUBLE + c_custkey % 10 AS elevated, 50.0::DOUBLE AS high, 80.0::DOUBLE AS critical, 'websocket' AS channels FROM customer),
  s AS (SELECT 'p' || (s_suppkey * 2) AS profile, 30.0::DOUBLE AS elevated, 55.0::DOUBLE + s_suppkey % 7 AS high, 90.0::DOUBLE AS critical, 'email,sms' AS channels FROM supplier)
  SELECT * FROM (SELECT * FROM c WHERE profile NOT IN (SELECT profile FROM s) UNION ALL SELECT * FROM s) WHERE profile <> 'p4'""")
def profile_changes(spark, d):
    """Profiles upserted by name, then one deleted."""
    made = lambda key, e, h, c, ch: (F.concat(F.lit("p"), key).alias("profile"), e.alias("elevated"), h.alias("high"), c.alias("critical"), F.array(*map(F.lit, ch)).alias("alert_channels"))
    num = lambda v: F.lit(float(v))
    current = Q.table(spark, d, "customer").select(*made(F.col("c_custkey"), num(20) + F.col("c_custkey") % 10, num(50), num(80), ["websocket"]))
    new = Q.table(spark, d, "supplier").select(*made(F.col("s_suppkey") * 2, num(30), num(55) + F.col("s_suppkey") % 7, num(90), ["email", "sms"]))
    out = dims.delete_profile(dims.upsert_profile(current, new), "p4")
    return out.select("profile", "elevated", "high", "critical", F.array_join("alert_channels", ",").alias("channels"))
