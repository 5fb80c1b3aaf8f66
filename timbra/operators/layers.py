"""Layers of evidence over columns of windows, and their registry.

A layer is a function of a ``Batch`` (columns of windows, as Arrow hands them to a task) that
gives a verdict for each. All registered layers run in one pass over a batch; one that fails on
a window abstains there, with its reason, and all others still vote. ``verdicts`` runs a registry
in Spark over any table of windows; ``operators.call`` runs the same layers for live calls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.text import CONTEXT_FIELDS

EPS = 1e-9


class Facts(Sequence):
    """Facts of the calls as Arrow columns; a window's dictionary is made when it is asked for."""

    def __init__(self, columns: dict[str, pa.Array], n: int):
        self.columns, self.n = columns, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, step = at.indices(self.n)
            return Facts({k: v.take(pa.array(range(start, stop, step), pa.int64())) for k, v in self.columns.items()}, len(range(start, stop, step)))
        return {k: v[at].as_py() for k, v in self.columns.items()}

    def __iter__(self) -> Iterator[dict]:
        lists = {k: v.to_pylist() for k, v in self.columns.items()}
        return (dict(zip(lists, r, strict=True)) for r in zip(*lists.values(), strict=True))

    def known(self, name: str) -> np.ndarray:
        """Where the fact is known."""
        return np.zeros(self.n, bool) if name not in self.columns else np.asarray(self.columns[name].is_valid())

    def number(self, name: str) -> np.ndarray:
        """The fact as a number, 0 where it is not known."""
        return np.zeros(self.n) if name not in self.columns else self.columns[name].fill_null(False if pa.types.is_boolean(self.columns[name].type) else 0).to_numpy(zero_copy_only=False).astype(np.float64)

    def text(self, name: str, f: Callable[[str], float]) -> np.ndarray:
        """``f`` of each text, worked out once for equal ones; an unknown one is empty."""
        return np.full(self.n, f(""), np.float64) if name not in self.columns else by_value(self.columns[name], lambda x: f(x or ""), np.float64)


def by_value(column: pa.Array, f: Callable, kind) -> np.ndarray:
    """``f`` of each value, called once for equal ones."""
    d = column.dictionary_encode(null_encoding="encode")
    return np.array([f(x) for x in d.dictionary.to_pylist()], kind)[d.indices.to_numpy(zero_copy_only=False)]


class RuleFactors(Sequence):
    """What rules found, as matrices of windows and rules; a window's list of factors is made
    when it is asked for."""

    def __init__(self, names: list[tuple[str, str]], here: np.ndarray, share: np.ndarray, value: np.ndarray):
        self.names, self.here, self.share, self.value = names, here, share, value

    def __len__(self) -> int:
        return len(self.here)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return RuleFactors(self.names, self.here[at], self.share[at], self.value[at])
        return [(*self.names[k], float(self.share[at, k]), float(self.value[at, k])) for k in np.flatnonzero(self.here[at])]

    def where(self, keep: np.ndarray) -> RuleFactors:
        return RuleFactors(self.names, self.here & keep[:, None], self.share, self.value)


@dataclass
class Batch:
    """Columns of ``n`` windows. What is not known is NaN in ``features`` and None elsewhere."""

    n: int
    features: dict[str, np.ndarray] = field(default_factory=dict)
    vectors: list = field(default_factory=list)  # of the window, or None
    past: list = field(default_factory=list)  # the call's vectors before it, oldest first
    enrolled: list = field(default_factory=list)  # (centroid, samples, spread) of the claimed identity, or None
    context: Sequence = field(default_factory=list)  # facts of the call, or None

    def value(self, name: str) -> np.ndarray:
        v = self.features.get(name)
        return np.full(self.n, np.nan) if v is None else v

    def rows(self, at: slice) -> Batch:
        return replace(self, n=len(range(*at.indices(self.n))), features={k: v[at] for k, v in self.features.items()}, **{k: getattr(self, k)[at] for k in ("vectors", "past", "enrolled", "context")})


@dataclass
class Verdicts:
    """score and confidence of each window, its factors as (code, label, contribution, value),
    and a note where a layer says why. Confidence 0 abstains."""

    score: np.ndarray
    confidence: np.ndarray
    factors: Sequence[list[tuple]]
    notes: list[str | None]

    @classmethod
    def none(cls, n: int, note: str | None = None) -> Verdicts:
        return cls(np.full(n, 0.5), np.zeros(n), [[] for _ in range(n)], [note] * n)


@dataclass(frozen=True)
class Layer:
    """``judge`` maps a Batch to Verdicts. ``features`` are the feature values that it reads and
    ``facts`` the other columns of a Batch: only what some layer declares is carried to it."""

    name: str
    weight: float
    judge: Callable[[Batch], Verdicts]
    features: tuple[str, ...] = ()
    facts: tuple[str, ...] = ()


class Registry:
    """Layers by name, in the order they vote in."""

    def __init__(self, layers: list[Layer] | None = None):
        self.layers = {x.name: x for x in (standard() if layers is None else layers)}

    def register(self, layer: Layer) -> Registry:
        """With ``layer`` added, or in place of the one of its name."""
        return Registry(list({**self.layers, layer.name: layer}.values()))

    def weights(self, other: dict[str, float]) -> Registry:
        """With other weights where they are named; weights below zero are refused."""
        if any(w < 0 for w in other.values()):
            raise ValueError("weights are not below zero")
        return Registry([replace(x, weight=other.get(x.name, x.weight)) for x in self.layers.values()])

    def fusion(self) -> dict[str, float]:
        """The weight of each layer in the fused logit."""
        return {x.name: x.weight for x in self.layers.values()}

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(f for x in self.layers.values() for f in x.features))

    @property
    def facts(self) -> set[str]:
        return {f for x in self.layers.values() for f in x.facts}

    def vote(self, batch: Batch, failed: Accumulator | None = None) -> dict[str, Verdicts]:
        """Every layer's verdicts. A layer that raises is tried window by window, so it abstains
        only where it fails; ``failed`` counts those windows."""
        out = {}
        for name, layer in self.layers.items():
            try:
                out[name] = layer.judge(batch)
            except Exception:  # noqa: BLE001  whatever is wrong with one layer, the others vote
                out[name] = self._apart(layer, batch, failed)
        return out

    @staticmethod
    def _apart(layer: Layer, batch: Batch, failed: Accumulator | None) -> Verdicts:
        out = Verdicts.none(batch.n)
        for k in range(batch.n):
            try:
                own = layer.judge(batch.rows(slice(k, k + 1)))
                out.score[k], out.confidence[k], out.factors[k], out.notes[k] = own.score[0], own.confidence[0], own.factors[0], own.notes[0]
            except Exception as e:  # noqa: BLE001
                out.notes[k] = f"layer error: {e}"
                if failed is not None:
                    failed.add(1)
        return out


# The layers --------------------------------------------------------------------------------


def ramp(v, low: float, high: float) -> np.ndarray:
    """0 at ``low``, 1 at ``high``; 0 for what is not finite."""
    v = np.asarray(v, np.float64)
    ok = np.isfinite(v)
    part = np.clip((np.where(ok, v, low) - low) / (high - low), 0.0, 1.0) if high != low else (v >= high).astype(np.float64)
    return np.where(ok, part, 0.0)


def ramp_of(v: float, low: float, high: float) -> float:
    """``ramp`` of one finite value."""
    return min(1.0, max(0.0, (v - low) / (high - low)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logit(p, clip: float = 1e-4):
    q = np.clip(p, clip, 1 - clip)
    return np.log(q / (1 - q))


def by_rules(rules: list[tuple], bias: float, gain: float) -> Callable[[Batch], Verdicts]:
    """A layer's verdict from (feature, label, low, high, weight, required features) rules as one
    matrix of windows and rules. A rule whose feature is missing, or whose required one is about
    zero, is left out."""
    weight = np.array([r[4] for r in rules])

    def judge(b: Batch) -> Verdicts:
        values = np.column_stack([b.value(r[0]) for r in rules])
        here = ~np.isnan(values)
        for k, r in enumerate(rules):
            for need in r[5]:
                here[:, k] &= np.abs(np.nan_to_num(b.value(need))) > EPS
        strength = np.column_stack([ramp(values[:, k], r[2], r[3]) for k, r in enumerate(rules)])
        own = np.where(here, strength * weight, 0.0)
        total = np.round((here * weight).sum(1), 9)  # freed of rounding: equal shares stay equal
        some = total > 0
        share = own / np.where(some, total, 1.0)[:, None]
        score = np.where(some, sigmoid(bias + gain * (2 * share.sum(1) - 0.5)), 0.5)
        confidence = np.where(some, np.minimum(1.0, 0.35 + 0.65 * total / weight.sum()), 0.0)
        factors = RuleFactors([r[:2] for r in rules], here, share, values)
        return Verdicts(score, confidence, factors, [None if s else "no rule could be evaluated" for s in some])

    return judge


def acoustic(b: Batch) -> Verdicts:
    """The rules are a prior: their confidence is capped at four fifths."""
    v = by_rules(dims.ACOUSTIC_RULES, *dims.SCORERS["acoustic"])(b)
    return replace(v, confidence=v.confidence * 0.8)


def prosodic(b: Batch) -> Verdicts:
    """Abstains without enough voiced speech; more cycles, more trust."""
    v = by_rules(dims.PROSODIC_RULES, *dims.SCORERS["prosodic"])(b)
    cycles, speech = np.nan_to_num(b.value("cycle_count")), np.nan_to_num(b.value("speech_ratio"))
    thin = (cycles < dims.MIN_CYCLES) | (speech < dims.MIN_SPEECH_RATIO)
    notes = [f"insufficient voiced speech (cycles={c:.0f}, speech={s:.2f})" if t else n for t, c, s, n in zip(thin, cycles, speech, v.notes, strict=True)]
    keep = v.factors.where(~thin)
    return Verdicts(np.where(thin, 0.5, v.score), np.where(thin, 0.0, v.confidence * (0.55 + 0.45 * np.minimum(1.0, cycles / 120))), keep, notes)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """One minus the cosine; 1 if either is zero."""
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    return 1.0 - float(a @ b) / norm if norm > 1e-12 else 1.0


def speaker(b: Batch) -> Verdicts:
    """Distance to the claimed identity's enrolment, and the largest to the call's last vectors."""
    out = Verdicts.none(b.n, "no enrolment for the claimed identity and no call history yet")
    for i in range(b.n):
        v = None if b.vectors[i] is None else np.asarray(b.vectors[i], np.float64)
        if v is None or not v.any():
            out.notes[i] = "no speaker embedding for this window"
            continue
        evidence = []
        if (own := b.enrolled[i]) is not None:
            centroid, samples, spread = own
            far = distance(v, np.asarray(centroid, np.float64))
            many = samples >= 3 and spread > dims.MIN_SPREAD
            strength = ramp(far / max(spread, dims.MIN_SPREAD), dims.MATCH_Z, dims.MISMATCH_Z) if many else ramp(far, dims.MATCH_DISTANCE, dims.MISMATCH_DISTANCE)
            evidence.append((float(strength), 1.0, "speaker_enrolment_distance", "Voice does not match the enrolled speaker", far))
        past = b.past[i] if b.past[i] is not None else []
        if len(past):
            moved = max(distance(v, np.asarray(p, np.float64)) for p in past[-dims.HISTORY:])
            evidence.append((float(ramp(moved, dims.DRIFT_LOW, dims.DRIFT_HIGH)), 0.6, "speaker_within_call_drift", "Voice changed during the call", moved))
        if not evidence:
            continue
        total = sum(e[1] for e in evidence)
        out.score[i] = sigmoid(-0.9 + 3.6 * (sum(e[0] * e[1] for e in evidence) / total - 0.15))
        out.confidence[i] = (0.85 if own[1] >= 3 else 0.85 * 0.75) if own is not None else 0.45 if len(past) >= 3 else 0.45 * 0.6
        out.factors[i] = [(code, label, s / total, value) for s, _, code, label, value in evidence if s > 0 or code == "speaker_enrolment_distance"]
        out.notes[i] = "enrolment comparison" if own is not None else "within-call drift only"
    return out


_URGENT = [re.compile(p) for p in dims.URGENCY]


def signals(c: dict) -> list[tuple[str, float, float]]:
    """(code, strength, weight) of what a call's facts say; absent facts say nothing."""
    out: list[tuple[str, float, float]] = []
    get = c.get
    if get("caller_id_verified") is not None:
        out.append(("caller_id_verified", 0.0, 0.6) if get("caller_id_verified") else ("caller_id_unverified", 1.0, 1.2))
    if get("known_contact") is not None:
        out.append(("known_contact", 0.0, 0.5) if get("known_contact") else ("unknown_contact", 0.85, 1.0))
    if get("first_contact"):
        out.append(("first_contact", 0.6, 0.5))
    if (get("prior_fraud_reports") or 0) > 0:
        out.append(("prior_fraud_reports", ramp_of(get("prior_fraud_reports"), 0, 3), 1.4))
    if get("origin"):
        out.append(("origin_risk", dims.ORIGIN_RISK.get(get("origin").lower(), 0.25), 0.7))
    if (get("transaction_amount") or 0) > 0:
        out.append(("transaction_amount", ramp_of(get("transaction_amount"), 1e5, 5e6), 0.9))
    if get("local_hour") is not None:
        out.append(("off_hours", 0.55 if get("local_hour") < 7 or get("local_hour") >= 21 else 0.0, 0.5))
    role = (get("claimed_role") or get("claimed_identity") or "").lower()
    if role and any(r in role for r in dims.ROLES):
        out.append(("high_value_role", 0.6, 0.7))
    if get("transcript"):
        low = get("transcript").lower()
        out.append(("urgency_language", ramp_of(sum(bool(p.search(low)) for p in _URGENT), 0, 3), 1.1))
    if get("account_age_days") is not None and get("account_age_days") < 30:
        out.append(("new_account", 0.5, 0.4))
    return out


def added(parts: list[np.ndarray]) -> np.ndarray:
    """What ``sum`` gives for the numbers of each row: with the low parts that plain sums lose."""
    high, low = np.zeros(len(parts[0])), np.zeros(len(parts[0]))
    for x in parts:
        t = high + x
        low += np.where(np.abs(high) >= np.abs(x), (high - t) + x, (x - t) + high)
        high = t
    return high + low


def signal_columns(c: Facts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(strength, weight) of ``signals``, in the same order, for all windows at once; weight 0
    where a signal is absent."""
    yes = lambda name: c.number(name) != 0
    pick = lambda when, a, b: np.where(when, a, b)
    known, number = c.known, c.number
    out = [
        (pick(yes("caller_id_verified"), 0.0, 1.0), pick(known("caller_id_verified"), pick(yes("caller_id_verified"), 0.6, 1.2), 0.0)),
        (pick(yes("known_contact"), 0.0, 0.85), pick(known("known_contact"), pick(yes("known_contact"), 0.5, 1.0), 0.0)),
        (np.full(c.n, 0.6), pick(yes("first_contact"), 0.5, 0.0)),
        (clipped(number("prior_fraud_reports"), 0, 3), pick(number("prior_fraud_reports") > 0, 1.4, 0.0)),
        (c.text("origin", lambda x: dims.ORIGIN_RISK.get(x.lower(), 0.25)), c.text("origin", lambda x: 0.7 if x else 0.0)),
        (clipped(number("transaction_amount"), 1e5, 5e6), pick(number("transaction_amount") > 0, 0.9, 0.0)),
        (pick((number("local_hour") < 7) | (number("local_hour") >= 21), 0.55, 0.0), pick(known("local_hour"), 0.5, 0.0)),
    ]
    role = [c.text(name, lambda x: -1.0 if not x else float(any(r in x.lower() for r in dims.ROLES))) for name in ("claimed_role", "claimed_identity")]
    urgent = c.text("transcript", lambda x: ramp_of(sum(bool(p.search(x.lower())) for p in _URGENT), 0, 3) if x else -1.0)
    return [
        *out, (np.full(c.n, 0.6), pick(pick(role[0] < 0, role[1], role[0]) > 0, 0.7, 0.0)), (np.maximum(0.0, urgent), pick(urgent >= 0, 1.1, 0.0)),
        (np.full(c.n, 0.5), pick(known("account_age_days") & (number("account_age_days") < 30), 0.4, 0.0)),
    ]


def clipped(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """``ramp_of`` of columns."""
    return np.minimum(1.0, np.maximum(0.0, (v - low) / (high - low)))


def context(b: Batch) -> Verdicts:
    out = Verdicts.none(b.n, "no call context")
    if isinstance(b.context, Facts):
        found = signal_columns(b.context)
        weight = added([w for _, w in found])
        some = weight > 0
        z = -1.4 + 3.2 * added([s * w for s, w in found]) / np.where(some, weight, 1.0)
        score, confidence = np.where(some, sigmoid(z), 0.5), np.where(some, 0.3 + 0.5 * np.minimum(1.0, weight / 5), 0.0)
        return replace(out, score=score, confidence=confidence, notes=[None if s else "no call context" for s in some.tolist()])
    for i, c in enumerate(b.context):
        own = signals(c) if c else []
        if own:
            weight = sum(s[2] for s in own)
            out.score[i] = sigmoid(-1.4 + 3.2 * sum(s[1] * s[2] for s in own) / weight)
            out.confidence[i], out.notes[i] = 0.3 + 0.5 * min(1.0, weight / 5), None
    return out


def _read(rules: list[tuple]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for r in rules for x in (r[0], *r[5])))


def standard() -> list[Layer]:
    w = dims.FUSION_WEIGHTS
    return [
        Layer("acoustic", w["acoustic"], acoustic, _read(dims.ACOUSTIC_RULES)),
        Layer("prosodic", w["prosodic"], prosodic, (*_read(dims.PROSODIC_RULES), "cycle_count", "speech_ratio")),
        Layer("speaker", w["speaker"], speaker, (), ("vectors", "past", "enrolled")),
        Layer("context", w["context"], context, (), ("context",)),
    ]


# Fusion and explanation --------------------------------------------------------------------


def shift_of(c: dict | None) -> float:
    """How many points the thresholds fall for a call's facts."""
    if not c:
        return 0.0
    amount, reports, known, verified, hour = (c.get(k) for k in ("transaction_amount", "prior_fraud_reports", "known_contact", "caller_id_verified", "local_hour"))
    total = 10 * ramp_of(amount, 1e5, 5e6) if (amount or 0) > 0 else 0.0
    total += 6 * ramp_of(reports, 0, 3) if (reports or 0) > 0 else 0.0
    total += 3.0 if known is False else 0.0
    total += 3.0 if verified is False else -2.0 if verified is True else 0.0
    total += 2.5 if hour is not None and (hour < 7 or hour >= 21) else 0.0
    total -= 3.0 if known is True and not reports else 0.0
    return max(-dims.MAX_SHIFT, min(dims.MAX_SHIFT, total))


def shifts(c: Facts) -> np.ndarray:
    """``shift_of`` for all windows at once."""
    number = c.number
    reports, hour = number("prior_fraud_reports"), number("local_hour")
    sure = lambda name, what: c.known(name) & ((number(name) != 0) == what)
    total = np.where(number("transaction_amount") > 0, 10 * clipped(number("transaction_amount"), 1e5, 5e6), 0.0)
    total = total + np.where(reports > 0, 6 * clipped(reports, 0, 3), 0.0)
    total = total + np.where(sure("known_contact", False), 3.0, 0.0)
    total = total + np.where(sure("caller_id_verified", False), 3.0, np.where(sure("caller_id_verified", True), -2.0, 0.0))
    total = total + np.where(c.known("local_hour") & ((hour < 7) | (hour >= 21)), 2.5, 0.0)
    total = total - np.where(sure("known_contact", True) & (reports == 0), 3.0, 0.0)
    return np.maximum(-dims.MAX_SHIFT, np.minimum(dims.MAX_SHIFT, total))


@dataclass
class Fused:
    probability: np.ndarray
    confidence: np.ndarray
    power: np.ndarray  # windows x layers
    share: np.ndarray


def fuse(votes: dict[str, Verdicts], weights: dict[str, float], calibration: tuple[float, float] = (1.0, 0.0), there: np.ndarray | None = None) -> Fused:
    """Confidence-weighted log-odds; a layer without power neither votes nor counts. ``there``
    tells (windows x layers) which layers a window has at all."""
    weight = np.array([weights.get(k, 0.0) for k in votes])
    score = np.column_stack([v.score for v in votes.values()])
    confidence = np.column_stack([np.maximum(0.0, v.confidence) for v in votes.values()])
    there = np.ones(score.shape, bool) if there is None else there
    power = np.where(there, weight * confidence, 0.0)
    voter = power > EPS
    power = np.where(voter, power, 0.0)
    mass = power.sum(1)
    some = mass > 0
    z = (power * logit(score)).sum(1) / np.where(some, mass, 1.0)
    spread = np.where(voter.sum(1) > 1, np.where(voter, score, -np.inf).max(1) - np.where(voter, score, np.inf).min(1), 0.0)
    whole = (there * weight).sum(1)
    cover = mass / np.where(whole == 0, 1.0, whole)
    a, b = calibration
    return Fused(np.where(some, sigmoid(a * z + b), 0.5), np.where(some, np.clip(cover * (1 - 0.35 * spread), 0.05, 1.0), 0.0), power, power / np.where(some, mass, 1.0)[:, None])


def told(code: str, value: float) -> str:
    pattern = dims.DETAILS.get(code)
    return f"{code} = {value:.4g}" if pattern is None else pattern % (value * 100 if code in dims.PER_CENT else value)


def strongest(weighed: Iterator[tuple], limit: int = 6) -> list[tuple[float, tuple]]:
    """(share, factor) of the ``limit`` strongest of (minus weight, code, label, value), each code
    once; the shares sum to one."""
    first: dict[str, tuple] = {}
    for f in sorted(weighed):
        first.setdefault(f[1], f)
    top = list(first.values())[:limit]
    whole = -sum(f[0] for f in top)
    return [(-f[0] / whole if whole > EPS else -f[0], f) for f in top]


def explained(votes: dict[str, Verdicts], fused: Fused, i: int) -> tuple[list[dict], list[dict], list[dict]]:
    """(factors, counter_factors, layer_summary) of window ``i``: the strongest of each code over
    all voting layers, the six best sharing one, of which at most four are told."""
    shares = strongest((-(f[2] * v.confidence[i] * fused.share[i, k]), f[0], f[1], f[3]) for k, v in enumerate(votes.values()) if v.confidence[i] > 0 for f in v.factors[i])
    factors = [{"code": f[1], "label": f[2], "contribution": s, "value": f[3], "detail": told(f[1], f[3])} for s, f in sorted((x for x in shares if x[0] > 0.01), key=lambda x: -abs(x[0]))][:4]
    against = sorted((-v.confidence[i] * (1 - v.score[i]), f"{name}_genuine", float(v.score[i])) for name, v in votes.items() if v.confidence[i] > 0.2 and v.score[i] < 0.35)[:2]
    counter = [{"code": c, "contribution": float(-k), "value": s} for k, c, s in against]
    summary = [{"layer": name, "score": round(float(v.score[i]), 4), "confidence": round(float(v.confidence[i]), 4), "weight_share": round(float(fused.share[i, k]), 4), "status": "voted" if fused.power[i, k] > 0 else "abstained", "note": v.notes[i]} for k, (name, v) in enumerate(votes.items())]
    return factors, counter, summary


def caveats(elapsed: float, speech: float, no_speaker: bool, confidence: float, heuristic: bool, shift: float) -> list[str]:
    c = dims.CAVEATS
    rows = [(elapsed < 3, c["short"], elapsed), (speech < 0.35, c["silent"], None), (no_speaker, c["no_speaker"], None), (confidence < 0.5, c["unsure"], None), (heuristic, c["heuristic"], None), (shift > 1, c["lowered"], shift)]
    return [t if v is None else t % v for when, t, v in rows if when]


@dataclass(frozen=True)
class Policy:
    """What judging needs beside the layers: profiles' thresholds, calibration, whether no
    trained model is there."""

    profiles: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {p[0]: p[1:4] for p in dims.PROFILES})
    calibration: tuple[float, float] = (1.0, 0.0)
    heuristic: bool = False

    def limits(self, profile: str | None, shift: float) -> tuple[str, list[float]]:
        name = profile if profile in self.profiles else "default"
        return name, [max(0.0, t - shift) for t in self.profiles[name]]


def judged(votes: dict[str, Verdicts], fused: Fused, i: int, policy: Policy, profile: str | None, facts: dict | None, elapsed: float = 0.0, speech: float = 1.0, score: float | None = None) -> dict:
    """The whole assessment of window ``i``; ``score`` (a smoothed one) is judged in place of its own."""
    own = score_100(fused.probability[i])
    score = own if score is None else score
    shift = shift_of(facts)
    name, limits = policy.limits(profile, shift)
    band = dims.BANDS[sum(score >= t for t in limits)]
    factors, counter, summary = explained(votes, fused, i)
    lead = f"Risk {score:.0f}/100 — this voice {dims.PHRASES[band]}"
    head = f"{lead}; the strongest single indicator is {factors[0]['label'].lower()}." if factors else f"{lead}."
    silent = [k for k, s in enumerate(votes) if fused.power[i, k] <= 0 and s == "speaker"]
    return {
        "score": float(score), "band": band, "action": dims.ACTIONS[band], "probability": float(fused.probability[i]), "confidence": float(fused.confidence[i]), "policy": name, "threshold_shift": shift,
        "headline": head, "factors": factors, "counter_factors": counter, "layer_summary": summary, "caveats": caveats(elapsed, speech, bool(silent), float(fused.confidence[i]), policy.heuristic, shift),
    }


def judged_columns(votes: dict[str, Verdicts], fused: Fused, policy: Policy, profile: pa.Array | None, facts: Sequence, elapsed: list[float], speech: list[float], override: list | None) -> list[pa.Array] | None:
    """``judged`` for all windows of a batch at once, as the columns of ASSESSED. None where it
    has no such form: layers with factors of their own making, or two rules with one code."""
    n, names = len(fused.probability), list(votes)
    at = [k for k, v in enumerate(votes.values()) if isinstance(v.factors, RuleFactors)]
    rules = [(*r, k, j) for k in at for j, r in enumerate(votes[names[k]].factors.names)]
    if any(any(v.factors) for k, v in enumerate(votes.values()) if k not in at) or len({r[0] for r in rules}) < len(rules) or not rules or not (isinstance(facts, Facts) or not any(facts)):
        return None
    layers = list(votes.values())
    # the strongest factors: columns in the order that breaks ties
    rules.sort()
    own = np.column_stack([np.where(layers[k].factors.here[:, j] & (layers[k].confidence > 0), layers[k].factors.share[:, j] * layers[k].confidence * fused.share[:, k], -np.inf) for _, _, k, j in rules])
    order = np.argsort(-own, axis=1, kind="stable")[:, :6]
    weight = np.take_along_axis(own, order, 1)
    weight = np.where(np.isfinite(weight), weight, 0.0)
    whole = np.add.accumulate(weight, 1)[:, -1:]  # from left to right
    share = np.where(whole > EPS, weight / np.where(whole > EPS, whole, 1.0), weight)[:, :4]
    told_of = share > 0.01  # shares fall from left to right
    code = order[:, :4][told_of]
    values = np.column_stack([layers[k].factors.value[:, j] for _, _, k, j in rules])
    value = np.take_along_axis(values, order[:, :4], 1)[told_of]
    patterns = [(dims.DETAILS.get(r[0]), 100 if r[0] in dims.PER_CENT else 1) for r in rules]
    details = [f"{rules[k][0]} = {v:.4g}" if patterns[k][0] is None else patterns[k][0] % (v * patterns[k][1]) for k, v in zip(code.tolist(), value.tolist(), strict=True)]
    texts = lambda xs, i: pa.array(xs, pa.string()).take(pa.array(i))
    factors = _lists(told_of.sum(1), {"code": texts([r[0] for r in rules], code), "label": texts([r[1] for r in rules], code), "contribution": pa.array(share[told_of]), "value": pa.array(value), "detail": pa.array(details, pa.string())})
    # layers that speak against it: by strength, then by name
    by_name = sorted(range(len(names)), key=lambda k: f"{names[k]}_genuine")
    score, confidence = (np.column_stack([getattr(layers[k], c) for k in by_name]) for c in ("score", "confidence"))
    doubt = np.where((confidence > 0.2) & (score < 0.35), confidence * (1 - score), -np.inf)
    first = np.argsort(-doubt, axis=1, kind="stable")[:, :2]
    doubt = np.take_along_axis(doubt, first, 1)
    some = np.isfinite(doubt)
    counter = _lists(some.sum(1), {"code": texts([f"{names[k]}_genuine" for k in by_name], first[some]), "contribution": pa.array(doubt[some]), "value": pa.array(np.take_along_axis(score, first, 1)[some])})
    # every layer, in the order of the registry
    four = lambda xs: pa.array([round(x, 4) for x in xs.ravel().tolist()], pa.float64())
    notes = [x for row in zip(*(v.notes for v in layers), strict=True) for x in row]
    summary = _lists(np.full(n, len(names)), {
        "layer": texts(names, np.tile(np.arange(len(names)), n)), "score": four(np.column_stack([v.score for v in layers])), "confidence": four(np.column_stack([v.confidence for v in layers])), "weight_share": four(fused.share),
        "status": texts(["abstained", "voted"], (fused.power > 0).ravel().astype(np.int64)), "note": pa.array(notes, pa.string()),
    })
    # policy
    shift = shifts(facts) if isinstance(facts, Facts) else np.zeros(n)
    pick = by_value(profile, lambda p: list(policy.profiles).index(policy.limits(p, 0.0)[0]), np.int64) if profile is not None else np.full(n, list(policy.profiles).index("default"))
    limits = np.maximum(0.0, np.array(list(policy.profiles.values()), np.float64)[pick] - shift[:, None])
    shown = [score_100(p) if o is None else float(o) for p, o in zip(fused.probability.tolist(), override or [None] * n, strict=True)]
    bands = (np.array(shown)[:, None] >= limits).sum(1)
    labels = [f"; the strongest single indicator is {r[1].lower()}." for r in rules] + ["."]
    lead = np.where(told_of[:, 0], order[:, 0], len(rules)).tolist()
    heads = [f"Risk {s:.0f}/100 — this voice {dims.PHRASES[dims.BANDS[b]]}{labels[k]}" for s, b, k in zip(shown, bands.tolist(), lead, strict=True)]
    silent = (fused.power[:, names.index("speaker")] <= 0).tolist() if "speaker" in names else [False] * n
    warned = [caveats(*x[:4], policy.heuristic, x[4]) for x in zip(elapsed, speech, silent, fused.confidence.tolist(), shift.tolist(), strict=True)]
    return [
        pa.array(shown, pa.float64()), texts(list(dims.BANDS), bands), texts([dims.ACTIONS[b] for b in dims.BANDS], bands), pa.array(fused.probability), pa.array(fused.confidence), texts(list(policy.profiles), pick), pa.array(shift),
        pa.array(heads, pa.string()), factors, counter, summary, pa.array(warned, pa.list_(pa.string())),
    ]


def _lists(sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    """Rows of ``columns`` as one list of structs a window."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def score_100(probability: float) -> float:
    return round(float(probability) * 100, 1)


# In Spark ----------------------------------------------------------------------------------

ASSESSED = (
    "score double, band string, action string, probability double, confidence double, policy string, threshold_shift double, headline string, "
    "factors array<struct<code:string,label:string,contribution:double,value:double,detail:string>>, counter_factors array<struct<code:string,contribution:double,value:double>>, "
    "layer_summary array<struct<layer:string,score:double,confidence:double,weight_share:double,status:string,note:string>>, caveats array<string>"
)
CONTEXT_KINDS = dict(zip(CONTEXT_FIELDS, ("string", "string", "string", "boolean", "boolean", "string", "double", "long", "long", "long", "boolean", "string"), strict=True))


def batch_of(columns: dict[str, pa.Array], registry: Registry, n: int) -> Batch:
    """Arrow columns (f, vector, past, centroid, samples, spread, c:<fact>) as a Batch."""
    values = columns["f"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if "f" in columns else np.zeros((n, 0))
    features = dict(zip(registry.features, np.ascontiguousarray(values.T), strict=True))
    lists = {k: columns[k].to_pylist() if k in columns else [None] * n for k in ("vector", "past", "centroid", "samples", "spread")}
    enrolled = [None if c is None else (c, s or 0, x or 0.0) for c, s, x in zip(lists["centroid"], lists["samples"], lists["spread"], strict=True)]
    facts = {k[2:]: v for k, v in columns.items() if k.startswith("c:")}
    return Batch(n, features, lists["vector"], lists["past"], enrolled, Facts(facts, n) if facts else [None] * n)


def _carried(windows: DataFrame, keys: list[str], registry: Registry, more: dict[str, str]) -> DataFrame:
    """What the layers declare of ``windows``: only that leaves the map of features, as one array
    in the registry's order (an expression for each feature would make one method that is too
    large for the JVM to compile)."""
    has = [c for c in ("vector", "past", "centroid", "samples", "spread") if c in windows.columns and registry.facts & {"vectors", "past", "enrolled"}]
    facts = [c for c in CONTEXT_FIELDS if c in windows.columns] if "context" in registry.facts or more else []
    read = [F.transform(F.lit(registry.features), lambda f: F.try_element_at("features", f).cast("double")).alias("f")] if registry.features else []
    return windows.select(
        *keys, *read, *[F.col(c) for c in has],
        *[F.col(c).cast(CONTEXT_KINDS[c]).alias(f"c:{c}") for c in facts], *[F.col(c).cast(k).alias(f"m:{c}") for c, k in more.items()],
    )


def _pass(own: DataFrame, keys: list[str], ddl: str, registry: Registry, rows: Callable, failed: Accumulator | None = None) -> DataFrame:
    """One pass over Arrow batches: ``rows(columns, batch, votes)`` gives (window, values of
    ``ddl``) pairs, or a list of the columns of ``ddl``."""
    kinds = T.StructType([*own.select(*keys).schema.fields, *T.StructType.fromDDL(ddl).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        for b in batches:
            if not b.num_rows:
                continue
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            batch = batch_of(columns, registry, b.num_rows)
            found = rows(columns, batch, registry.vote(batch, failed))
            if isinstance(found, list):  # whole columns, a row for each window
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], *(c.cast(f.type) for c, f in zip(found, list(schema)[len(keys):], strict=True))], schema=schema)
                continue
            found = list(found)
            at = pa.array([i for i, _ in found], pa.int64())
            values = list(zip(*(v for _, v in found), strict=True)) or [()] * (len(schema) - len(keys))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:len(keys)]), *(pa.array(v, f.type) for v, f in zip(values, list(schema)[len(keys):], strict=True))], schema=schema)

    return own.mapInArrow(run, kinds)


def verdicts(windows: DataFrame, keys: list[str], registry: Registry | None = None, policy: Policy | None = None, failed: Accumulator | None = None) -> DataFrame:
    """``keys`` and the whole assessment (ASSESSED) of every window, in one pass over Arrow
    batches and without a shuffle.

    ``windows`` has ``features`` (a map) and may have ``vector``, ``past`` (an array of vectors),
    ``centroid``, ``samples``, ``spread``, ``profile``, ``elapsed_seconds``, ``speech_ratio``,
    ``score_override`` and any of CONTEXT_FIELDS; what is missing counts as unknown. Only the
    features that a layer declares leave the map. Layers that have nothing to judge abstain.
    """
    registry, policy = registry or Registry(), policy or Policy()
    more = {c: k for c, k in (("profile", "string"), ("elapsed_seconds", "double"), ("speech_ratio", "double"), ("score_override", "double")) if c in windows.columns}
    names, weights = [f.name for f in T.StructType.fromDDL(ASSESSED).fields], registry.fusion()

    def apart(get: list, batch: Batch, votes: dict, fused: Fused) -> Iterator[tuple]:
        for i, (p, e, s, o, c) in enumerate(zip(*get, batch.context, strict=True)):
            r = judged(votes, fused, i, policy, p, c, e, s, o)
            yield i, [r[n] for n in names]

    def rows(columns: dict, batch: Batch, votes: dict) -> Iterator[tuple] | list[pa.Array]:
        fused = fuse(votes, weights, policy.calibration)
        get = [columns[f"m:{c}"].to_pylist() if c in more else [None] * batch.n for c in ("elapsed_seconds", "speech_ratio", "score_override")]
        get = [[e or 0.0 for e in get[0]], [1.0 if s is None else s for s in get[1]], get[2]]
        whole = judged_columns(votes, fused, policy, columns.get("m:profile"), batch.context, *get)
        return whole if whole is not None else apart([columns["m:profile"].to_pylist() if "profile" in more else [None] * batch.n, *get], batch, votes, fused)

    return _pass(_carried(windows, keys, registry, more or {}), keys, ASSESSED, registry, rows, failed)


def layer_rows(windows: DataFrame, keys: list[str], registry: Registry | None = None, failed: Accumulator | None = None) -> DataFrame:
    """A row for each window and layer that does not abstain: score, confidence, features_used."""
    registry = registry or Registry()

    def rows(columns: dict, batch: Batch, votes: dict) -> Iterator[tuple]:
        for name, v in votes.items():
            for i in np.flatnonzero(v.confidence > 0).tolist():
                yield i, (name, float(v.score[i]), float(v.confidence[i]), len(v.factors[i]))

    return _pass(_carried(windows, keys, registry, {}), keys, "layer string, score double, confidence double, features_used long", registry, rows, failed)


def factor_rows(windows: DataFrame, keys: list[str], registry: Registry | None = None, limit: int = 6) -> DataFrame:
    """The ``limit`` strongest factors of each window over all layers by their layers' weights:
    code, label, value, rank, contribution (shares that sum to one)."""
    registry = registry or Registry()
    weights = registry.fusion()

    def rows(columns: dict, batch: Batch, votes: dict) -> Iterator[tuple]:
        for i in range(batch.n):
            for k, (share, f) in enumerate(strongest(((-(f[2] * weights[name]), f[0], f[1], f[3]) for name, v in votes.items() for f in v.factors[i]), limit)):
                yield i, (f[1], f[2], f[3], k + 1, share)

    return _pass(_carried(windows, keys, registry, {}), keys, "code string, label string, value double, rank long, contribution double", registry, rows)


def rules_only() -> Registry:
    """The two rule layers as they score before anything caps or silences them."""
    return Registry([Layer(n, dims.FUSION_WEIGHTS[n], by_rules(t, *dims.SCORERS[n]), _read(t)) for n, t in (("acoustic", dims.ACOUSTIC_RULES), ("prosodic", dims.PROSODIC_RULES))])
