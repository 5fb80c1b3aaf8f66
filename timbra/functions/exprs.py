"""Column expressions: all stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def sigmoid(z: Column) -> Column:
    """The logistic function, its argument held within 60."""
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))


def logit(p: Column, clip: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def ramp(value: Column, low, high) -> Column:
    """0 at ``low``, 1 at ``high``, straight between, in either direction; a step where they
    are equal; 0 for null, NaN and infinite values."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    part = F.least(F.greatest((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(~F.coalesce(ok, F.lit(False)), 0.0).when(low == high, F.when(value >= high, 1.0).otherwise(0.0)).otherwise(part)


def band(score: Column, elevated: Column, high: Column, critical: Column) -> Column:
    """A score on a threshold belongs to the higher band."""
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= elevated, "ELEVATED").otherwise("LOW")


def band_rank(name: Column) -> Column:
    return reduce(lambda e, kv: e.when(name == kv[1], kv[0]), list(enumerate(dims.BANDS))[1:], F.when(name == dims.BANDS[0], 0)).otherwise(0)


def lookup(key: Column, table: dict, default) -> Column:
    """A literal map with a default for null and unknown keys."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def off_hours(hour: Column) -> Column:
    return (hour < 7) | (hour >= 21)


def threshold_shift(amount: Column, fraud_reports: Column, known_contact: Column, verified: Column, hour: Column) -> Column:
    """How many points the thresholds fall for this call; null inputs add nothing."""
    yes, no = (lambda c: c.eqNullSafe(True)), (lambda c: c.eqNullSafe(False))
    zero = F.lit(0.0)
    total = (
        F.when(amount > 0, 10 * ramp(amount, 1e5, 5e6)).otherwise(zero)
        + F.when(fraud_reports > 0, 6 * ramp(fraud_reports.cast("double"), 0, 3)).otherwise(zero)
        + F.when(no(known_contact), 3.0).otherwise(zero)
        + F.when(no(verified), 3.0).when(yes(verified), -2.0).otherwise(zero)
        + F.when(off_hours(hour), 2.5).otherwise(zero)
        - F.when(yes(known_contact) & (F.coalesce(fraud_reports, F.lit(0)) == 0), 3.0).otherwise(zero)
    )
    return F.greatest(F.least(total, F.lit(dims.MAX_SHIFT)), F.lit(-dims.MAX_SHIFT))


def rounded(value: Column, digits: int) -> Column:
    """Half up at the scaled value, as SQL engines round a double: smoothing leaves many a tie a
    bit below (58.949999999999996), which ``F.round`` takes down by its decimal digits."""
    return F.round(value * float(10**digits), 0) / float(10**digits)


def lowered(threshold: Column, shift: Column) -> Column:
    return F.greatest(F.lit(0.0), threshold - shift)


def verdict(n_scores: Column, audio_seconds: Column, peak: Column) -> Column:
    return F.when((n_scores == 0) | (audio_seconds < 2), "insufficient_audio").when(peak >= 80, "likely_synthetic").when(peak >= 60, "suspicious").when(peak >= 35, "inconclusive").otherwise("likely_genuine")


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def decibel(value: Column, floor: float = -120.0) -> Column:
    """20 log10, at least ``floor``; the floor itself for values of 0 and less."""
    return F.when(value > 0, F.greatest(F.lit(floor), 20 * F.log10(value))).otherwise(floor)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def rms(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x) / F.size(xs) + 1e-12)).otherwise(0.0)


def duration_seconds(xs: Column, rate: int = dims.SAMPLE_RATE) -> Column:
    return F.size(xs) / F.lit(rate)


def preemphasis(xs: Column, coeff: float = 0.97) -> Column:
    return F.transform(xs, lambda v, i: F.when(i == 0, v).otherwise(v - coeff * F.get(xs, i - 1)))


def peak_normalize(xs: Column, target: float = 0.95) -> Column:
    peak = F.array_max(F.transform(xs, F.abs))
    return F.when(peak >= 1e-9, F.transform(xs, lambda v: v * (target / peak))).otherwise(xs)


def finite(xs: Column) -> Column:
    return F.transform(xs, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def float_mono(channels: Column, integer_max: float | None = None) -> Column:
    """Samples from an array of frames (arrays of channels): mean of the channels, integers
    scaled, peaks above 1 divided away, NaN and infinities 0."""
    scale = 1.0 if integer_max is None else float(integer_max)
    mono = finite(F.transform(channels, lambda f: total(F.transform(f, lambda v: v.cast("double"))) / F.size(f) / scale))
    peak = F.array_max(F.transform(mono, F.abs))
    return F.when(peak > 1, F.transform(mono, lambda v: v / peak)).otherwise(mono)


def frames(xs: Column, length: int, hop: int) -> Column:
    """Overlapping frames; a short signal is one frame filled up with zeros."""
    n = F.greatest(F.lit(1), F.floor((F.size(xs) - length) / hop) + 1).cast("int")
    whole = F.when(F.size(xs) < length, F.concat(xs, F.array_repeat(F.lit(0.0), length - F.size(xs)))).otherwise(xs)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(whole, i * hop + 1, length))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Held within [-1, 1]; 0 for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 1e-12)
    return F.when(ok, F.least(F.greatest(dot(a, b) / norm, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def zero_crossing_rate(xs: Column) -> Column:
    flips = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda x, y: F.when(F.signum(x) * F.signum(y) < 0, 1.0).otherwise(0.0))
    return total(flips) / (F.size(xs) - 1)


def parabolic_peak(before: Column, at: Column, after: Column, index: Column) -> Column:
    """Where the parabola through three neighbours peaks."""
    bend = before - 2 * at + after
    return F.when(F.abs(bend) < 1e-12, index).otherwise(index + 0.5 * (before - after) / bend)


def let(value: Column, f) -> Column:
    """f(value), with ``value`` worked out once for each row however often f looks at it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))
