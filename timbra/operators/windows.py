"""Count-based sliding windows, masks, runs and frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims


def full_windows(n: Column, window: int = dims.WINDOW, hop: int = dims.HOP) -> Column:
    return F.when(n >= window, F.floor((n - window) / hop) + 1).otherwise(0).cast("int")


def window_spans(calls: DataFrame, n: str = "n_samples", window: int = dims.WINDOW, hop: int = dims.HOP, tail_min: int = dims.TAIL_MIN, rate: int = dims.SAMPLE_RATE) -> DataFrame:
    """A row for each full window of a call and one for its tail, if the tail is long enough:
    window_index, start_sample, length, start_s, end_s, is_tail. The tail starts where the
    next window would, so it may repeat audio."""
    k = full_windows(F.col(n), window, hop)
    rest = F.col(n) - k * hop
    at = F.filter(F.sequence(F.lit(0), k), lambda i: (i < k) | (rest >= tail_min))
    rows = calls.withColumn("__k", k).withColumn("window_index", F.explode(at))
    tail = F.col("window_index") == F.col("__k")
    start = F.col("window_index") * hop
    length = F.when(tail, F.col(n) - start).otherwise(window)
    return rows.select(*calls.columns, "window_index", start.cast("long").alias("start_sample"), length.cast("long").alias("length"), (start / F.lit(rate)).alias("start_s"), ((start + length) / F.lit(rate)).alias("end_s"), tail.alias("is_tail"))


def windowed(calls: DataFrame, samples: str = "samples", **how) -> DataFrame:
    """window_spans with each window's own samples."""
    rows = window_spans(calls.withColumn("__n", F.size(samples)), "__n", **how)
    return rows.withColumn(samples, F.slice(samples, (F.col("start_sample") + 1).cast("int"), F.col("length").cast("int"))).drop("__n")


def capped(n: Column, cap: int = dims.BUFFER_CAP) -> Column:
    """Samples that one push leaves in the buffer: the oldest beyond the cap are lost first."""
    return F.least(n, F.lit(cap))


def runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Maximal runs of equal ``flag``: keys, flag, first, last, n (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = Window.partitionBy(*keys, flag).orderBy(order)
    marked = rows.withColumn("__run", F.row_number().over(w) - F.row_number().over(own))
    return marked.groupBy(*keys, flag, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")


def smooth_mask(rows: DataFrame, keys: list[str], order: str, flag: str, min_speech: int, min_pause: int) -> DataFrame:
    """Fill inner gaps shorter than ``min_pause``, then drop runs shorter than ``min_speech``;
    gaps at the edges stay. Adds ``smooth``."""
    def run_lengths(df: DataFrame, col: str, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        own = Window.partitionBy(*keys, col).orderBy(order)
        df = df.withColumn("__run", F.row_number().over(w) - F.row_number().over(own))
        return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys, col, "__run"))).drop("__run")

    w = Window.partitionBy(*keys).orderBy(order)
    ends = Window.partitionBy(*keys)
    on = F.when(F.col(flag), F.col(order))
    df = rows.withColumn("__first", F.min(on).over(ends)).withColumn("__last", F.max(on).over(ends))
    df = run_lengths(df, flag, "__n")
    inner = (F.col(order) > F.col("__first")) & (F.col(order) < F.col("__last"))
    df = df.withColumn("__filled", F.col(flag) | F.coalesce(inner & (F.col("__n") < min_pause), F.lit(False)))
    df = run_lengths(df, "__filled", "__m")
    return df.withColumn("smooth", F.col("__filled") & (F.col("__m") >= min_speech)).drop("__first", "__last", "__n", "__m", "__filled")


def speech_segments(rows: DataFrame, keys: list[str], order: str, flag: str, frame: int, hop: int, rate: int = dims.SAMPLE_RATE) -> DataFrame:
    """[start, end) seconds of each true run; the end includes the last frame's length."""
    return runs(rows, keys, order, flag).filter(flag).select(*keys, (F.col("first") * hop / F.lit(rate)).alias("start_s"), ((F.col("last") * hop + frame) / F.lit(rate)).alias("end_s"), "n")


def deltas(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 2) -> DataFrame:
    """Regression slope over ``width`` neighbours on both sides, edges repeated."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    up = sum((k * (F.coalesce(F.lead(value, k).over(w), last) - F.coalesce(F.lag(value, k).over(w), first)) for k in range(1, width + 1)), F.lit(0.0))
    return rows.withColumn("delta", up / (2 * sum(k * k for k in range(1, width + 1))))


def moving_average(rows: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Centred mean; outside the signal counts as zero."""
    k = width // 2
    return rows.withColumn("smooth", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, width - 1 - k)) / width)


def perturbation(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean step between neighbours, and mean distance from the mean of three, over the mean."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    off = F.when(F.lag(value).over(w).isNotNull() & F.lead(value).over(w).isNotNull(), F.abs(F.col(value) - F.avg(value).over(w.rowsBetween(-1, 1))))
    return rows.withColumn("__step", step).withColumn("__off", off).groupBy(*keys).agg((F.avg("__step") / F.avg(value)).alias("local"), (F.avg("__off") / F.avg(value)).alias("residual"))


def envelope_smoothness(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First and second differences and lag-1 autocorrelation of a centred envelope."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = rows.withColumn("__c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    one = F.col(value) - F.lag(value).over(w)
    two = F.col(value) - 2 * F.lag(value).over(w) + F.lag(value, 2).over(w)
    df = df.withColumn("__1", F.abs(one)).withColumn("__2", F.abs(two)).withColumn("__p", F.col("__c") * F.lag("__c").over(w))
    return df.groupBy(*keys).agg(F.avg("__1").alias("first_diff"), F.avg("__2").alias("second_diff"), (F.sum("__p") / F.nullif(F.sum(F.col("__c") * F.col("__c")), F.lit(0.0))).alias("lag1_autocorr"))


def band_energy(frames: DataFrame, keys: list[str], samples: str = "samples", n: int = 64, rate: int = dims.SAMPLE_RATE, edges: tuple = (0, 300, 1000, 2000, 4000, 6000, 8000)) -> DataFrame:
    """Share of spectral energy in each band [low, high) of frames of ``n`` samples (longer ones
    are cut, shorter ones filled with zeros), by one Fourier transform of each Arrow batch;
    null frames give none, silent ones null shares."""
    import numpy as np
    import pyarrow as pa

    own = frames.select(*keys, F.col(samples).cast("array<double>").alias("__x")).filter("__x is not null")
    names = [f"band_{a}_{b}" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(c, T.DoubleType()) for c in names)])
    hz = np.arange(n // 2 + 1) * rate / n

    def run(batches):
        for b in batches:
            x = np.zeros((b.num_rows, n))
            for row, v in zip(x, b.column(b.num_columns - 1).to_pylist(), strict=True):
                row[:min(n, len(v))] = [0.0 if s is None else s for s in v[:n]]
            p = np.abs(np.fft.rfft(x, axis=1)) ** 2
            with np.errstate(invalid="ignore", divide="ignore"):
                shares = [p[:, (hz >= a) & (hz < e)].sum(1) / p.sum(1) for a, e in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, pa.float64(), from_pandas=True) for v in shares)], names=[*b.schema.names[:-1], *names])

    return own.mapInArrow(run, schema)


def signal_hygiene(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Clipping, offset, share of the 16-bit codes in use, crest factor."""
    x = F.col(value).cast("double")
    code = F.round(x * 32768)
    agg = rows.groupBy(*keys).agg(F.avg(F.when(F.abs(x) > 0.985, 1.0).otherwise(0.0)).alias("clipping_ratio"), F.abs(F.avg(x)).alias("dc_offset"), F.count_distinct(code).alias("codes"), (F.max(code) - F.min(code) + 1).alias("span"), (F.max(F.abs(x)) / F.nullif(F.sqrt(F.avg(x * x)), F.lit(0.0))).alias("crest_factor"))
    return agg.withColumn("code_use", F.col("codes") / F.col("span")).drop("codes", "span")


def silence_features(frames: DataFrame, keys: list[str], db: str) -> DataFrame:
    """Level statistics of the frames that are not speech."""
    return frames.groupBy(*keys).agg(F.median(db).alias("silence_median_db"), F.stddev_pop(db).alias("silence_std_db"), (F.max(db) - F.min(db)).alias("silence_range_db"), F.avg(F.when(F.col(db) < -85, 1.0).otherwise(0.0)).alias("clean_fraction"))


def idle_split(rows: DataFrame, session: str, ts: str, order: str, idle_seconds: float = dims.IDLE_SECONDS) -> DataFrame:
    """Number the stretches of a call that a longer silence than ``idle_seconds`` parts."""
    w = Window.partitionBy(session).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return rows.withColumn("part", F.sum(F.when(gap > int(idle_seconds * 1e6), 1).otherwise(0)).over(w))
