"""Live calls: smoothing, warm-up and alerts as keyed state of a stream of window scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import dims
from ..operators.scoring import smooth_step

OUT = "session_id long, window_index long, score double, smoothed double, provisional boolean, peak double, band string, alert boolean, closed boolean"
#: The fading share of a new score, scores remembered, the quantile that lifts.
SMOOTHING = (0.35, 8, 0.8)
STATE = "value double, history array<double>, seen long, peak double, top int, last double, profile string"


def judge(profiles: dict[str, tuple[float, float, float]], profile: str = "default", cooldown: float = dims.COOLDOWN_SECONDS):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, history, seen, peak, top, last, own = state.get if state.exists else (None, [], 0, 0.0, -1, None, profile)
        rows = []
        if state.hasTimedOut:  # idle too long: the call closes with its final figures, and its state goes
            rank = sum(value >= t for t in profiles.get(own, profiles[profile])) if value is not None else 0
            rows.append((key[0], None, None, value, seen <= dims.WARMUP, peak, dims.BANDS[rank], False, True))
            state.remove()
        else:
            whole = pd.concat(list(frames)).sort_values("window_index")
            named = whole["profile"].dropna()
            own = named.iloc[0] if len(named) else own
            limits = profiles.get(own, profiles[profile])
            for index, score, ts in zip(whole["window_index"].tolist(), whole["score"].tolist(), whole["ts"], strict=True):
                value, history = smooth_step((value, list(history)) if seen else None, None if score is None or score != score else float(score), *SMOOTHING)
                seen, peak = seen + 1, max(peak, value)
                rank = sum(value >= t for t in limits)
                at = ts.timestamp()
                fires = seen > dims.WARMUP and rank >= 2 and rank > top and (last is None or at - last >= cooldown)
                top, last = (rank, at) if fires else (top, last)
                rows.append((key[0], index, score, value, seen <= dims.WARMUP, peak, dims.BANDS[rank], fires, False))
            state.update((value, list(history), seen, peak, top, last, own))
            state.setTimeoutDuration(dims.IDLE_SECONDS * 1000)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return update


def judged(windows: DataFrame, profile: str = "default", profiles: DataFrame | None = None) -> DataFrame:
    """Streaming (session_id, window_index, ts, score and, if given, profile) to judged windows,
    one group of state a call; windows of one micro-batch are put in order, and the sink key
    (session_id, window_index) makes a replayed batch overwrite itself. A call is judged by
    the profile that its windows name, else by ``profile``; one that is idle too long ends in
    a row without an index, ``closed``, with its last and highest score."""
    rows = profiles.select("profile", "elevated", "high", "critical").collect() if profiles is not None else [p[:4] for p in dims.PROFILES]
    table = {r[0]: tuple(r[1:]) for r in rows}
    own = windows if "profile" in windows.columns else windows.withColumn("profile", F.lit(None).cast("string"))
    return own.groupBy("session_id").applyInPandasWithState(judge(table, profile), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def late_dropped(windows: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each window once, as long as it is not later than ``delay``."""
    return windows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "window_index"])


def started(spark, writer):
    """Start a query over what is there now. Without batches of no data, which idle timeouts
    would otherwise ask for without end, it stops when all is read."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def write_once(rows: DataFrame, path: str, checkpoint: str):
    """Each micro-batch to a folder of its own number, so a retry replaces it."""
    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return started(rows.sparkSession, rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint))


def deliveries(alerts: DataFrame, channels: str = "alert_channels") -> DataFrame:
    """One outbox row for each alert and channel; delivery itself is the reader's job."""
    return alerts.select("*", F.explode(channels).alias("channel")).withColumn("delivered", F.col("channel") == "console")
