"""Recordings as rows: bytes to samples at 16 kHz, and back."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

SAMPLES = T.ArrayType(T.FloatType())
#: Bounds of an upload, in bytes and seconds.
MAX_BYTES, MIN_SECONDS = 25_000_000, 0.5


def is_container(content: Column) -> Column:
    """Known magic bytes at the start (or at byte 4 for MP4)."""
    head = F.hex(F.substring(content, 1, 4))
    marks = [x.encode().hex().upper() for x in ("RIFF", "fLaC", "OggS", ".snd")]
    return head.isin(*marks) | (F.hex(F.substring(content, 5, 4)) == "ftyp".encode().hex()) | F.startswith(head, F.lit("ID3".encode().hex()))


def to_rate(x: np.ndarray, rate: int, target: int = dims.SAMPLE_RATE) -> np.ndarray:
    """Polyphase resampling by a Kaiser-windowed sinc at the reduced ratio."""
    if rate == target or not len(x):
        return x
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    # for each output: the inputs under the filter, at steps of ``up``
    first = -(-(at - half) // up)
    k = first[:, None] + np.arange(2 * half // up + 1)
    tap = at[:, None] - k * up + half
    ok = (k >= 0) & (k < len(x)) & (tap >= 0) & (tap < len(taps))
    return (np.where(ok, x[np.clip(k, 0, len(x) - 1)], 0) * np.where(ok, taps[np.clip(tap, 0, len(taps) - 1)], 0)).sum(1)


def pcm16(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:len(raw) // 2 * 2], "<i2") / 32768.0


def wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(mono samples, rate); anything that is not a readable WAV gives no samples. FLAC, OGG,
    MP3 and MP4 need a decoder that Spark's workers do not have."""
    try:
        with wave.open(io.BytesIO(raw)) as w:
            width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, RuntimeError):
        return np.zeros(0), dims.SAMPLE_RATE
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data[:len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 8388608.0
    else:
        x = np.frombuffer(data, f"<i{width}") / float(1 << (8 * width - 1))
    return x[:len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def decoded(raw: bytes | None, encoding: str, rate: int | None) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.float32)
    container = encoding == "container" or encoding == "auto" and (raw[:4] in (b"RIFF", b"fLaC", b"OggS", b".snd") or raw[4:8] == b"ftyp" or raw[:3] == b"ID3")
    if container:
        x, own = wav(raw)
    else:
        x, own = (np.frombuffer(raw[:len(raw) // 4 * 4], "<f4").astype(float) if encoding == "float32" else pcm16(raw)), rate or dims.SAMPLE_RATE
    x = np.nan_to_num(x, posinf=0.0, neginf=0.0)
    peak = np.abs(x).max(initial=0.0)
    return to_rate(x / peak if peak > 1 else x, own).astype(np.float32)


def samples(content: Column, encoding: str = "auto", rate: int | None = None) -> Column:
    @F.pandas_udf(SAMPLES)
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([decoded(x, encoding, rate) for x in raw])

    return run(content)


def recordings(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """path, content, samples of every recording below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "content", samples(F.col("content"), "container").alias("samples"))


def checked(rows: DataFrame) -> DataFrame:
    """Add ``status``: ok, empty, too_large, undecodable or too_short."""
    size, n = F.octet_length("content"), F.size("samples")
    return rows.withColumn("status", F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MAX_BYTES, "too_large").when(n == 0, "undecodable").when(n < MIN_SECONDS * dims.SAMPLE_RATE, "too_short").otherwise("ok"))


def to_pcm16(xs: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else (np.clip(v, -1, 1) * 32767).astype("<i2").tobytes())

    return run(xs)


def to_float32(xs: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(xs)


def to_wav(xs: Column, rate: int = dims.SAMPLE_RATE) -> Column:
    """A 16-bit mono WAV file's bytes, to be written by any binary sink."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(v) -> bytes:
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
                w.writeframes((np.clip(v, -1, 1) * 32767).astype("<i2").tobytes())
            return out.getvalue()

        return x.map(lambda v: None if v is None else one(v))

    return run(xs)
