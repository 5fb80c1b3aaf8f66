"""Text, JSON and privacy expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


#: What a call's metadata may tell.
CONTEXT_FIELDS = ("caller_number", "claimed_identity", "claimed_role", "known_contact", "caller_id_verified", "origin", "transaction_amount", "local_hour", "prior_fraud_reports", "account_age_days", "first_contact", "transcript")


def urgency_hits(transcript: Column) -> Column:
    """The distinct patterns that the lower-cased transcript holds; none for null."""
    low = F.lower(F.coalesce(transcript, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in dims.URGENCY]))


def redact(text: Column, max_chars: int = 0, unicode: bool = True) -> Column:
    """Digit runs of four or more characters, then addresses, replaced; null becomes empty."""
    u = "(?U)" if unicode else ""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), u + r"\b\d[\d\s-]{3,}\b", "[number]")
    # An address starts with the first word character of its run, or where the last one ended;
    # nothing is walked twice.
    out = F.regexp_replace(out, u + r"(?:(?<![\w.+-])([.+-]*+)(?=\w)|\G\b)[\w.+-]++@[\w-]++\.[\w.]+\b", "$1[email]")
    return F.substring(out, 1, max_chars) if max_chars else out


def hash_identifier(value: Column, salt: str, length: int = 16) -> Column:
    return F.concat(F.lit("h:"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), 1, length))


def mask_number(value: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9]", "")
    n = F.length(digits)
    return F.when(n < 4, "***").otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(digits, F.lit(4))))


def anonymize_map(payload: Column, salt: str, store_pii: bool = False) -> Column:
    """Hash the non-empty values of personal keys in a map<string,string>."""
    if store_pii:
        return payload
    own = lambda k, v: k.isin(*dims.PII_KEYS) & v.isNotNull() & (v != "")
    return F.transform_values(payload, lambda k, v: F.when(own(k, v), hash_identifier(v, salt)).otherwise(v))


def loads(text: Column, schema: str, default: Column | None = None) -> Column:
    """JSON to a nested value; the default for null and broken documents."""
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return value if default is None else F.coalesce(value, default)


def dumps(value: Column) -> Column:
    return F.to_json(value)


def extra_numbers(payload: Column, known: list[str]) -> Column:
    """Of a JSON object: a map of the numeric entries whose keys are not known."""
    entries = F.from_json(payload, "map<string,string>")
    return F.map_filter(F.transform_values(entries, lambda k, v: F.try_to_number(v, F.lit("S999999999999D999999")).cast("double")), lambda k, v: v.isNotNull() & ~k.isin(*known))


def alert_text(band: Column, session: Column, score: Column, labels: Column, action: Column) -> Column:
    """Band, call, score, two reasons, action."""
    why = F.when(F.size(labels) > 0, F.array_join(F.slice(labels, 1, 2), "; ")).otherwise("no single dominant factor")
    return F.concat(F.lit("["), band, F.lit("] Call "), session, F.lit(": risk "), F.format_string("%.0f", F.bround(score, 0)), F.lit("/100. "), why, F.lit(". "), action)


def context_json(c) -> Column:
    """A call's metadata as JSON, facts that are not known left out. ``c`` maps a field's name to
    its column."""
    return F.to_json(F.struct(*[c(n).alias(n) for n in CONTEXT_FIELDS]))


def sms(text: Column) -> Column:
    return F.substring(text, 1, 160)


def email_body(headline: Column, score: Column, band: Column, action: Column, factors: Column) -> Column:
    """Headline, score, action and up to five factors (label, detail), a line each."""
    lines = F.transform(F.slice(factors, 1, 5), lambda f: F.concat(F.lit("  - "), f["label"], F.lit(": "), F.coalesce(f["detail"], F.lit(""))))
    head = F.array(headline, F.lit(""), F.concat(F.lit("Risk score: "), F.format_string("%.0f", F.bround(score, 0)), F.lit("/100 ("), band, F.lit(")")), F.concat(F.lit("Recommended action: "), action), F.lit(""), F.lit("Contributing factors:"))
    return F.array_join(F.concat(head, lines), "\n")


def retention_banner(mode: Column, ttl_seconds: Column, raw_ttl_seconds: Column) -> Column:
    return (
        F.when(mode == "none", "Privacy mode: scores only — no audio and no voice features are stored.")
        .when(mode == "features_only", F.concat(F.lit("Privacy mode: features only — no audio is written to disk. Feature vectors are deleted after "), F.floor(ttl_seconds / 3600).cast("string"), F.lit(" h.")))
        .otherwise(F.concat(F.lit("Privacy mode: RAW AUDIO RETAINED for "), F.floor(raw_ttl_seconds / 60).cast("string"), F.lit(" min. This is opt-in and must be justified to your DPO.")))
    )


def consented(header: Column) -> Column:
    return F.lower(header).isin("recorded", "analysed", "analyzed", "none-required")
