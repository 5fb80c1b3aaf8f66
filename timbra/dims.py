"""Risk profiles, language priors, weights, rules and phrases, as data.

Each table becomes a small DataFrame (``frame``) that joins by broadcast, or literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE_RATE, WINDOW, HOP, TAIL_MIN = 16000, 16000, 8000, 6400
BUFFER_CAP = 30 * SAMPLE_RATE
WARMUP = 3
IDLE_SECONDS, COOLDOWN_SECONDS, SESSION_LIMIT = 600, 10, 500
STEP_UP_AMOUNT = 1_000_000.0
MAX_SHIFT = 18.0

# fixed values: name, elevated, high, critical, channels
PROFILES = [
    ("default", 35.0, 60.0, 80.0, ["websocket"]),
    ("wire_transfer", 25.0, 45.0, 65.0, ["websocket", "webhook", "email"]),
    ("contact_center", 40.0, 65.0, 85.0, ["websocket"]),
    ("consumer", 45.0, 70.0, 85.0, ["websocket", "sms"]),
    ("privileged_access", 20.0, 40.0, 60.0, ["websocket", "webhook", "email", "sms"]),
]

# fixed values: code, mean and deviation of F0 in Hz, syllables a second, share of pauses
LANGUAGES = [
    ("auto", 155.0, 45.0, 4.6, 0.22), ("hi-IN", 158.0, 48.0, 5.0, 0.21), ("en-IN", 150.0, 44.0, 4.4, 0.24), ("ta-IN", 162.0, 46.0, 5.2, 0.20),
    ("bn-IN", 156.0, 47.0, 4.8, 0.22), ("mr-IN", 157.0, 46.0, 4.9, 0.21), ("te-IN", 160.0, 45.0, 5.1, 0.21),
]

# fixed values: weight of each layer in the fused logit
FUSION_WEIGHTS = {"acoustic": 0.45, "prosodic": 0.28, "speaker": 0.19, "context": 0.08}
LAYERS = tuple(FUSION_WEIGHTS)

# fixed values: feature, label, low, high, weight, features that must not be zero
ACOUSTIC_RULES = [
    ("hf_cliff_depth_db", "High-frequency energy cliff", 25.0, 80.0, 1.6, []),
    ("hf_energy_ratio", "Missing high-band energy", 0.045, 0.004, 1.1, []),
    ("spec_rolloff95_mean", "Narrow effective bandwidth", 4200.0, 2200.0, 0.9, []),
    ("mel_frame_corr", "Unnatural frame-to-frame spectral change", 0.92, 0.74, 1.2, []),
    ("env_second_diff", "Envelope discontinuity", 0.20, 0.55, 0.9, []),
    ("digital_silence_score", "Digitally clean silence", 0.05, 0.45, 1.5, []),
    ("silence_exact_zero_ratio", "Exact-zero samples", 0.02, 0.25, 1.0, []),
    ("comb_strength", "Periodic spectral ripple", 0.35, 0.75, 0.7, []),
    ("phase_coherence", "Irregular phase structure", 0.40, 0.18, 0.8, []),
    ("residual_kurtosis", "Non-impulsive excitation", 6.0, 2.8, 0.7, ["residual_peakiness"]),
    ("spec_flatness_mean", "Over-flat spectrum", 0.02, 0.14, 0.5, []),
    ("mod_syllabic_ratio", "Weak syllabic modulation", 0.55, 0.18, 0.6, []),
]
PROSODIC_RULES = [
    ("f0_micro_var", "Suppressed pitch micro-variation", 0.020, 0.004, 1.5, ["cycle_count"]),
    ("jitter_ppq5", "Below-human cycle jitter", 0.004, 0.0004, 1.3, ["cycle_count"]),
    ("shimmer_apq3", "Below-human amplitude shimmer", 0.035, 0.006, 1.2, ["cycle_count"]),
    ("f0_contour_entropy", "Mechanical pitch contour", 0.72, 0.38, 0.9, ["voiced_ratio"]),
    ("pause_std", "Uniform pause lengths", 0.16, 0.02, 1.0, ["pause_count"]),
    ("silence_floor_std_db", "Static background between words", 3.5, 0.4, 1.1, []),
    ("energy_range_db", "Compressed loudness dynamics", 22.0, 7.0, 0.8, ["speech_ratio"]),
    ("speech_run_std", "Metronomic phrase lengths", 0.35, 0.05, 0.7, ["speech_run_mean"]),
    ("env_lag1_autocorr", "Over-smooth loudness envelope", 0.55, 0.92, 0.8, []),
    ("period_cv", "Near-perfect pitch periodicity", 0.030, 0.004, 1.0, ["cycle_count"]),
]
# fixed values: what each rule says of its value, as printf patterns
DETAILS = {
    "hf_cliff_depth_db": "spectrum collapses by %.0f dB above the cut-off",
    "hf_energy_ratio": "only %.3f of speech-band energy survives above 6 kHz",
    "spec_rolloff95_mean": "95 %% of energy below %.0f Hz",
    "mel_frame_corr": "inter-frame spectral correlation %.3f",
    "env_second_diff": "envelope second difference %.3f",
    "digital_silence_score": "non-speech segments have no room tone (score %.2f)",
    "silence_exact_zero_ratio": "%.1f%% of samples are numerically zero",
    "comb_strength": "regularly-spaced spectral ripple, autocorrelation %.2f",
    "phase_coherence": "inter-frame phase coherence %.3f",
    "residual_kurtosis": "LPC residual kurtosis %.2f (natural glottal pulses are spikier)",
    "spec_flatness_mean": "mean spectral flatness %.3f",
    "mod_syllabic_ratio": "only %.2f of envelope energy in the 2–16 Hz syllabic band",
    "f0_micro_var": "pitch residual variation %.4f (human speech: 0.02–0.06)",
    "jitter_ppq5": "5-point period perturbation %.5f (human: 0.003–0.015)",
    "shimmer_apq3": "3-point amplitude perturbation %.4f (human: 0.03–0.08)",
    "f0_contour_entropy": "pitch contour entropy %.3f",
    "pause_std": "pause-duration spread %.3f s (human pauses vary widely)",
    "silence_floor_std_db": "background level varies by only %.2f dB",
    "energy_range_db": "speech level spans only %.1f dB",
    "speech_run_std": "phrase-length spread %.3f s",
    "env_lag1_autocorr": "envelope autocorrelation %.3f",
    "period_cv": "period coefficient of variation %.4f",
}
#: Features whose pattern wants per cent.
PER_CENT = ("silence_exact_zero_ratio",)
# fixed values: prior log-odds and gain of each rule scorer
SCORERS = {"acoustic": (-1.05, 3.4), "prosodic": (-1.2, 3.0)}
MIN_CYCLES, MIN_SPEECH_RATIO = 25.0, 0.25

# fixed values: embedding distances, spreads and drifts where doubt starts and ends
MATCH_DISTANCE, MISMATCH_DISTANCE = 0.010, 0.100
MATCH_Z, MISMATCH_Z = 1.5, 6.0
DRIFT_LOW, DRIFT_HIGH = 0.020, 0.120
MIN_SPREAD, HISTORY = 8e-4, 12

# fixed values: risk of a call's origin; others 0.25
ORIGIN_RISK = {"international": 0.7, "voip": 0.45, "webrtc": 0.3, "pstn": 0.05, "mobile": 0.05}
ROLES = ["ceo", "cfo", "cto", "coo", "director", "chairman", "managing director", "md", "vp", "head", "manager", "commissioner", "officer", "inspector"]
# fixed values: phrases of pressure and secrecy, searched in lower-cased transcripts
URGENCY = [
    r"\burgent(?:ly)?\b", r"\bimmediate(?:ly)?\b", r"\bright now\b", r"\bemergency\b", r"\bdon'?t tell\b", r"\bdo not tell\b",
    r"\bkeep this (?:between|confidential)\b", r"\bconfidential\b", r"\bbefore (?:the )?(?:market|bank) clos", r"\bin the next \d+ minutes?\b",
    r"\botp\b", r"\bone[- ]time password\b", r"\bshare (?:the )?code\b", r"\bturant\b", r"\bjaldi\b", r"\babhi ke abhi\b", r"\bkisi ko mat bata\b",
    r"\bpolice\b.*\bcase\b", r"\barrest\b", r"\bdigital arrest\b", r"\bcustoms\b.*\bparcel\b", r"\bblock(?:ed)? (?:your )?account\b",
]
# fixed values: keys of a call's metadata that name a person
PII_KEYS = ["caller_number", "claimed_identity", "callee_number", "customer_id", "account_number", "email"]

BANDS = ("LOW", "ELEVATED", "HIGH", "CRITICAL")
# fixed values: what to do and say in each band
ACTIONS = {
    "LOW": "Proceed normally.",
    "ELEVATED": "Ask a knowledge-based verification question before proceeding.",
    "HIGH": "Do not act on this call. Call back on the registered number first.",
    "CRITICAL": "Block the requested action and escalate to a supervisor / fraud desk.",
}
PHRASES = {
    "LOW": "shows no significant sign of synthetic speech",
    "ELEVATED": "shows some characteristics associated with synthetic speech",
    "HIGH": "shows several strong indicators of synthetic or cloned speech",
    "CRITICAL": "is very likely a synthetic or cloned voice",
}
# fixed values: what a reader should know, as printf patterns
CAVEATS = {
    "short": "Only %.1f s of audio analysed so far — the score is still settling.",
    "silent": "Most of this audio is silence or background; the acoustic evidence is thin.",
    "no_speaker": "No enrolled voice sample for the claimed identity, so the identity itself could not be verified — only whether the audio looks synthetic.",
    "unsure": "Detection layers disagree or few could run; treat this score as provisional.",
    "heuristic": "Running on the built-in heuristic detector (no trained model artifact loaded); accuracy is lower than the reported benchmark.",
    "lowered": "Alerting thresholds lowered by %.0f points for this call's context (value, hour, caller reputation).",
}
# fixed values: what the layers are called
LAYER_LABELS = {"acoustic": "Acoustic / spectral analysis", "prosodic": "Prosody & micro-variation", "speaker": "Cross-session speaker check", "context": "Call context"}


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, elevated double, high double, critical double, alert_channels array<string>")


def upsert_profile(current: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same name; thresholds must rise."""
    from pyspark.sql import functions as F

    ok = F.assert_true((F.col("elevated") <= F.col("high")) & (F.col("high") <= F.col("critical")), "thresholds must rise from elevated to critical")
    checked = new.filter(F.coalesce(ok.cast("int"), F.lit(0)) == 0)
    return current.join(checked.select("profile"), "profile", "left_anti").unionByName(checked)


def delete_profile(current: DataFrame, name: str) -> DataFrame:
    """All but ``name``; the default profile cannot go."""
    if name == "default":
        raise ValueError("the default profile cannot be deleted")
    return current.filter(current["profile"] != name)


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, f0_mean_hz double, f0_std_hz double, syllable_rate_hz double, pause_ratio double")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(layer, *r) for layer, table in (("acoustic", ACOUSTIC_RULES), ("prosodic", PROSODIC_RULES)) for r in table]
    return spark.createDataFrame(rows, "layer string, feature string, label string, low double, high double, weight double, requires array<string>")
