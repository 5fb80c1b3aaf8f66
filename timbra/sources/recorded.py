"""Recordings read where they lie: headers first, then windows by seek.

The rows are paths. A task opens its files one after another and holds a few windows at a time,
however long a recording is; no content is shuffled and no list of paths goes to the driver.
Files are opened through Arrow's file systems (local or mounted folders, HDFS, S3, GCS). WAV
(8 to 32-bit integers, 32 and 64-bit floats) and AU (8 to 32-bit integers, floats) are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..operators.call import OUT, Alerted, Call, Judge, frame
from ..operators.layers import Policy, Registry
from .audio import to_rate

#: Recordings of a task; windows that are given on at once; frames that are read at once.
FILES, WINDOWS, FRAMES = 16, 16, 1 << 16
WINDOW = "window_index long, start_s double, end_s double, samples array<float>"


class Unreadable(ValueError):
    """No recording in a format that is read here."""


class Recording:
    """An open recording: ``frames`` at ``rate``; ``read`` gives mono frames, ``heard`` samples at
    16 kHz as decoding the whole file would give them."""

    def __init__(self, path: str):
        from pyarrow import fs

        local = re.sub(r"^file:/+", "/", path)
        system, place = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        self.scale = 1.0
        head = self.file.read(12)
        if head[:4] == b"RIFF" and head[8:] == b"WAVE":
            self._wav()
        elif head[:4] == b".snd":
            self._au()
        else:
            raise Unreadable(path)
        whole = self.file.size() - self.start
        self.frames = min(self.bytes, whole) // (self.width * self.channels)
        if self.float and self.frames:  # louder than full scale: all of it is scaled down
            peak = max(float(np.abs(self.read(a, min(a + FRAMES, self.frames))).max(initial=0.0)) for a in range(0, self.frames, FRAMES))
            self.scale = 1 / peak if peak > 1 else 1.0

    def _wav(self) -> None:
        kind = None
        while True:
            head = self.file.read(8)
            if len(head) < 8:
                raise Unreadable("no data chunk")
            name, size = struct.unpack("<4sI", head)
            if name == b"fmt ":
                body = self.file.read(size + size % 2)
                kind, self.channels, self.rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
                if kind == 0xFFFE and size >= 26:
                    kind = struct.unpack("<H", body[24:26])[0]
                self.width = bits // 8
            elif name == b"data":
                self.start, self.bytes = self.file.tell(), size
                break
            else:
                self.file.seek(self.file.tell() + size + size % 2)
        self.float, self.big = kind == 3, False
        if kind not in (1, 3) or not self.channels or not self.rate or self.width not in ((4, 8) if self.float else (1, 2, 3, 4)):
            raise Unreadable(f"WAV format {kind}")

    def _au(self) -> None:
        self.file.seek(4)
        self.start, size, kind, self.rate, self.channels = struct.unpack(">5I", self.file.read(20))
        widths = {2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 8}
        if kind not in widths or not self.channels or not self.rate:
            raise Unreadable(f"AU encoding {kind}")
        self.width, self.float, self.big = widths[kind], kind in (6, 7), True
        self.bytes = self.file.size() - self.start if size == 0xFFFFFFFF else size

    def read(self, a: int, b: int) -> np.ndarray:
        """Mono frames a <= n < b."""
        each = self.width * self.channels
        self.file.seek(self.start + a * each)
        raw = self.file.read((b - a) * each)
        raw = raw[:len(raw) // each * each]
        order = ">" if self.big else "<"
        if self.float:
            x = np.nan_to_num(np.frombuffer(raw, f"{order}f{self.width}").astype(np.float64), posinf=0.0, neginf=0.0)
        elif self.width == 1:
            x = np.frombuffer(raw, "i1") / 128 if self.big else (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
        elif self.width == 3:
            p = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, ::-1 if self.big else 1].astype(np.int32)
            x = ((p[:, 0] | p[:, 1] << 8 | p[:, 2] << 16) << 8 >> 8) / 8388608.0
        else:
            x = np.frombuffer(raw, f"{order}i{self.width}") / float(1 << (8 * self.width - 1))
        return x.reshape(-1, self.channels).mean(1) * self.scale

    @property
    def samples(self) -> int:
        """Samples at 16 kHz."""
        return -(-self.frames * dims.SAMPLE_RATE // self.rate)

    def heard(self, a: int, b: int) -> np.ndarray:
        """Samples a <= n < b at 16 kHz. Resampling reads the frames under the filter only."""
        b = min(b, self.samples)
        if self.rate == dims.SAMPLE_RATE:
            return self.read(a, b).astype(np.float32)
        g = np.gcd(self.rate, dims.SAMPLE_RATE)
        up, down = dims.SAMPLE_RATE // g, self.rate // g
        reach = 10 * max(up, down) // up + 2
        first = max(0, (a * down // up - reach) // down * down)  # a multiple of down: outputs keep their phase
        last = min(self.frames, -(-b * down // up) + reach)
        skip = a - first * up // down
        return to_rate(self.read(first, last), self.rate)[skip:skip + b - a].astype(np.float32)


def spans(n: int, window: int = dims.WINDOW, hop: int = dims.HOP, tail: int = dims.TAIL_MIN) -> Iterator[tuple[int, int, int]]:
    """(index, first sample, last sample) of a recording's windows, a long enough rest last."""
    k = 0
    while k * hop + window <= n:
        yield k, k * hop, k * hop + window
        k += 1
    if n - k * hop >= tail:
        yield k, k * hop, n


def _spread(rows: DataFrame) -> DataFrame:
    """Paths are small rows, but each is much work: a run of FILES for a task."""
    return rows.repartition(max(1, -(-rows.count() // FILES)))


def windows(rows: DataFrame, most: int | None = None, least_seconds: float = 0.0) -> DataFrame:
    """The columns of ``rows`` (path, ...) and WINDOW: the first ``most`` windows of every recording
    of ``least_seconds`` or more. Recordings that cannot be read give no rows."""
    names = rows.columns
    kinds = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(WINDOW).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                try:
                    r = Recording(pdf["path"].iloc[k])
                except (OSError, Unreadable, struct.error):
                    continue
                if r.samples < least_seconds * dims.SAMPLE_RATE:
                    continue
                held: list[tuple] = []
                for i, a, b in spans(r.samples):
                    if most is not None and i >= most:
                        break
                    held.append((i, a / dims.SAMPLE_RATE, b / dims.SAMPLE_RATE, r.heard(a, b)))
                    if len(held) == WINDOWS:
                        yield _beside(pdf.iloc[[k]], held)
                        held = []
                if held:
                    yield _beside(pdf.iloc[[k]], held)

    def _beside(row: pd.DataFrame, held: list[tuple]) -> pd.DataFrame:
        out = row.loc[row.index.repeat(len(held)), names].reset_index(drop=True)
        return out.assign(**dict(zip(("window_index", "start_s", "end_s", "samples"), map(list, zip(*held, strict=True)), strict=True)))

    return _spread(rows).mapInPandas(run, kinds)


def judged(rows: DataFrame, registry: Registry | None = None, policy: Policy | None = None, least_seconds: float = 1.0) -> DataFrame:
    """``call.OUT`` rows of every recording (path and, where it is there, language): each is heard
    as a call in half-second chunks, from its first sample to its report, in the task that reads
    it. A session is named by its path. Recordings that cannot be read, or are shorter than
    ``least_seconds``, give no rows."""
    judge, step = Judge(registry, policy), dims.SAMPLE_RATE // 2
    own = rows.select("path", (F.col("language") if "language" in rows.columns else F.lit(None).cast("string")).alias("language"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, language in zip(pdf["path"], pdf["language"], strict=True):
                try:
                    r = Recording(path)
                except (OSError, Unreadable, struct.error):
                    continue
                if r.samples < least_seconds * dims.SAMPLE_RATE:
                    continue
                call, held, vectors, alerted = Call(language=language or "auto", created_at=0), np.zeros(0, np.float32), [], Alerted()
                for a in range(0, r.samples, step):
                    at = int((a + step) / dims.SAMPLE_RATE * 1e6)
                    out, held = judge.heard(path, call, held, vectors, alerted, r.heard(a, a + step), at, end=a + step >= r.samples)
                    if out:
                        yield frame(out)
                yield frame([judge.closed(path, call, at)])

    return _spread(own).mapInPandas(run, OUT)


def stratified(rows: DataFrame, label: str, per_class: int, classes: list, seed: int = 11) -> DataFrame:
    """Exactly ``per_class`` rows of each of the ``classes`` (all, where there are fewer): those whose
    seeded hash of the path is smallest, found without sorting the rest."""
    parts = [rows.filter(F.col(label) == c).orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(per_class) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def full_stack(rows: DataFrame, registry: Registry | None = None, policy: Policy | None = None, limit: int = 0, threshold: float = 0.5, label: str = "label", spoof: str = "spoof", genuine: str = "bonafide", seed: int = 11) -> dict:
    """From recordings to figures in one call: (path, label, method, ...) rows, or ``limit`` of them
    drawn in equal parts from both classes, are replayed through layers, fusion and smoothing,
    and judged by each call's highest score. ``metrics`` (accuracy, precision, recall, F1, AUC,
    EER), ``per_method``, ``calls`` and ``windows``; ``error`` where there is nothing to tell apart."""
    from ..operators import metrics as M

    rows = stratified(rows, label, max(1, limit // 2), [genuine, spoof], seed) if limit else rows
    marked = rows.select("path", (F.col(label) == spoof).cast("int").alias("y"), "method", *(["language"] if "language" in rows.columns else []))
    told = F.from_json("payload", "struct<peak_score:double,stats:struct<windows_analyzed:long>>")
    ends = judged(marked, registry, policy).filter(F.col("kind") == "closed").select(F.col("session_id").alias("path"), told.alias("r")).filter("r.stats.windows_analyzed > 0")
    calls = ends.join(marked, "path").select("path", "y", "method", F.col("r.peak_score").alias("peak"), F.col("r.stats.windows_analyzed").alias("windows")).withColumn("score", F.col("peak") / 100).persist()
    try:
        n, windows_, classes = calls.agg(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0)), F.count_distinct("y")).first()
        if not n:
            return {"error": "no recording could be replayed"}
        if classes < 2:
            return {"error": "the recordings have one class only", "calls": n}
        figures = M.confusion(calls, threshold=threshold).join(M.auc(calls).select("auc")).join(M.eer(M.roc(calls))).first().asDict()
        return {"metrics": figures, "per_method": {r["method"]: r.asDict() for r in M.method_breakdown(calls, threshold).collect()}, "calls": n, "windows": windows_}
    finally:
        calls.unpersist()
