"""Live audio: chunks to windows as keyed state, calls that close, and tables that are kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import dims
from .calls import started

WINDOWS = "session_id string, kind string, window_index long, start_s double, end_s double, samples array<float>, audio_seconds double, windows long, chunk_hashes array<string>"
STATE = "held binary, consumed long, index long, total long, hashes array<string>"
#: Hashes of chunks that a call keeps.
HASHES = 64


class Chunker:
    """Samples in, overlapping windows out; what a call holds between two chunks."""

    def __init__(self, held: np.ndarray | None = None, consumed: int = 0, index: int = 0, total: int = 0, window: int = dims.WINDOW, hop: int = dims.HOP, cap: int = dims.BUFFER_CAP):
        self.held = np.zeros(0, np.float32) if held is None else held
        self.consumed, self.index, self.total = consumed, index, total
        self.window, self.hop, self.cap = window, hop, cap

    def _taken(self, n: int, step: int) -> tuple[int, int, np.ndarray]:
        out = self.index, self.consumed, self.held[:n]
        self.index, self.consumed, self.held = self.index + 1, self.consumed + step, self.held[step:]
        return out

    def push(self, samples: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(index, first sample, samples) of every window that these samples complete; beyond the
        cap the oldest are lost."""
        self.held = np.concatenate([self.held, np.asarray(samples, np.float32).ravel()])
        self.total += len(samples)
        lost = max(0, len(self.held) - self.cap)
        self.held, self.consumed = self.held[lost:], self.consumed + lost
        while len(self.held) >= self.window:
            yield self._taken(self.window, self.hop)

    def flush(self, shortest: int = dims.TAIL_MIN) -> Iterator[tuple[int, int, np.ndarray]]:
        """A last short window of what is left, if that is long enough."""
        if len(self.held) >= shortest:
            yield self._taken(len(self.held), len(self.held))
        self.held = np.zeros(0, np.float32)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, consumed, index, total, hashes = state.get if state.exists else (b"", 0, 0, 0, [])
    c, hashes = Chunker(np.frombuffer(held, np.float32), consumed, index, total), list(hashes)
    rows = []

    def out(windows: Iterator[tuple[int, int, np.ndarray]]) -> None:
        for i, start, x in windows:
            rows.append((key[0], "window", i, start / dims.SAMPLE_RATE, (start + len(x)) / dims.SAMPLE_RATE, x.tolist(), c.total / dims.SAMPLE_RATE, c.index, None))

    def close() -> None:
        out(c.flush())
        rows.append((key[0], "closed", None, None, None, None, c.total / dims.SAMPLE_RATE, c.index, hashes))

    closed = state.hasTimedOut
    if not closed:
        for chunk in pd.concat(list(frames)).sort_values("seq").itertuples():
            if closed:
                break
            raw = chunk.content or b""
            if raw:
                hashes = [*hashes, hashlib.sha256(raw).hexdigest()][:HASHES]
                out(c.push(np.frombuffer(raw[:len(raw) // 2 * 2], "<i2") / np.float32(32768)))
            closed = chunk.control in ("stop", "delete")
            if chunk.control == "delete":  # erased: nothing of the call comes out any more
                rows.clear()
                state.remove()
                return
    if closed:
        close()
        state.remove()
    else:
        state.update((c.held.astype(np.float32).tobytes(), c.consumed, c.index, c.total, hashes))
        state.setTimeoutDuration(dims.IDLE_SECONDS * 1000)
    yield pd.DataFrame(rows, columns=[x.split()[0] for x in WINDOWS.split(", ")])


def windows_of(chunks: DataFrame) -> DataFrame:
    """Streaming (session_id, seq, content, control) to windows and, when a call stops or has
    been idle too long, its last short window and a ``closed`` row with its figures.

    ``content`` is PCM16; ``control`` is null, "stop" or "delete". The state of a call is what
    has not filled a window yet, at most thirty seconds. Chunks of one micro-batch are put in
    order by ``seq``.
    """
    own = chunks.select(F.col("session_id").cast("string").alias("session_id"), "seq", "content", "control")
    return own.groupBy("session_id").applyInPandasWithState(_update, WINDOWS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def chunked(recordings: DataFrame, session: str, content: str, chunk_bytes: int = 16000) -> DataFrame:
    """(session_id, seq, content, control) of whole PCM16 recordings: a chunk a row, half a second
    each by default, "stop" with the last."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / F.lit(chunk_bytes))).cast("int")
    rows = recordings.select(F.col(session).cast("string").alias("session_id"), F.col(content).alias("__c"), n.alias("__n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.select("session_id", F.col("seq").cast("long").alias("seq"), F.substring(F.col("__c"), F.col("seq") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("content"), F.when(F.col("seq") == F.col("__n") - 1, "stop").alias("control"))


def late_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark, from a query's ``recentProgress``."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", ()))


def upserted(current: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with their keys. Of several new rows
    with one key the last by ``order`` counts; columns that a new row leaves null keep their
    value, so a closing row completes an opening one."""
    last = new.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in new.columns if c not in keys])
    if current is None:
        return last.select(*new.columns)
    was = current.select(*keys, *[F.col(c).alias(f"__{c}") for c in current.columns if c not in keys])
    both = was.join(last, keys, "full")
    return both.select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in new.columns if c not in keys])


def write_latest(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """A table that each micro-batch upserts: every batch writes a whole version of its own
    number from the version before, so a retry replaces what it wrote; ``latest`` reads the last."""

    def put(df: DataFrame, number: int) -> None:
        before = version(df.sparkSession, path, number)
        upserted(before, df, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return started(rows.sparkSession, rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint))


def version(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The last written version with a number under ``below``; None if there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return None
    names = [str(x.getPath().getName()) for x in fs.listStatus(there)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    done = [n for n in numbers if (below is None or n < below) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/version={max(done)}") if done else None
