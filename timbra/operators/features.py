"""Windows of samples to features, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

MIN_SAMPLES = dims.SAMPLE_RATE // 4
#: Windows in one kernel call: bounds the memory of a task.
CHUNK = 16
#: Samples in a row on the way to Python: bounds a batch, which Spark counts in rows.
PIECE = 500


def extract(windows: DataFrame, keys: list[str], samples: str = "samples", language: str | None = None) -> DataFrame:
    """keys, ``features`` (map) and ``embedding`` of every window, no shuffle. Windows under a
    quarter of a second give an empty map and a zero vector. A window goes to Python in pieces,
    one after another, so a task holds one batch of pieces and the windows of one kernel call."""
    priors = {r[0]: r[1:5] for r in dims.LANGUAGES}
    own = windows.select(*keys, F.col(samples).cast("array<double>").alias("__x"), (F.coalesce(F.col(language), F.lit("auto")) if language else F.lit("auto")).alias("__l"))
    size = F.when(F.col("__x").isNull(), 0).otherwise(F.size("__x"))
    pieces = F.when(size >= MIN_SAMPLES, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(PIECE)), lambda i: F.slice("__x", i + 1, F.lit(PIECE)))).otherwise(F.array(F.lit(None).cast("array<double>")))
    schema = T.StructType(own.select(*keys).schema.fields).add("features", T.MapType(T.StringType(), T.DoubleType())).add("embedding", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from ..kernels import dsp

        out = to_arrow_schema(schema)

        def judged(some: list[tuple]) -> pa.RecordBatch:
            feats, vecs = [{}] * len(some), [[0.0] * 64] * len(some)
            whole = [np.concatenate(w[2]) if w[2] else np.zeros(0) for w in some]
            groups: dict[tuple, list[int]] = {}
            for i, (_, lang, _) in enumerate(some):
                if len(whole[i]) >= MIN_SAMPLES:
                    groups.setdefault((len(whole[i]), lang), []).append(i)
            for (_, lang), part in groups.items():
                rows, emb = dsp.features(np.stack([whole[i] for i in part]), *priors.get(lang, priors["auto"]))
                for i, r, e in zip(part, rows, emb, strict=True):
                    feats[i], vecs[i] = r, e.tolist()
            names = [pa.concat_arrays([w[0][k] for w in some]) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*names, pa.array([list(f.items()) for f in feats], out.field("features").type), pa.array(vecs, out.field("embedding").type)], schema=out)

        held: list[tuple] = []
        for b in batches:
            *key, lang, at, x = b.columns
            for r, (i, name) in enumerate(zip(at.to_pylist(), lang.to_pylist(), strict=True)):
                if i == 0:
                    if len(held) >= CHUNK:
                        yield judged(held)
                        held = []
                    held.append(([k.take(pa.array([r])) for k in key], name, []))
                if x[r].is_valid:
                    held[-1][2].append(np.array(x[r].values.to_numpy(zero_copy_only=False), np.float64))
        if held:
            yield judged(held)

    return own.select(*keys, "__l", F.posexplode(pieces).alias("__i", "__p")).mapInArrow(run, schema)


def speech_only(samples: Column) -> Column:
    """The speech frames of a window, one after another as they overlap; none where there is no
    speech."""
    @F.pandas_udf("array<float>")
    def run(xs: pd.Series) -> pd.Series:
        from ..kernels import dsp

        size = max(64, dsp.RATE // 50)

        def one(x) -> np.ndarray:
            x = np.asarray(x if x is not None else [], np.float64)
            at = np.flatnonzero(dsp.speech(x[None])[0][0]) if len(x) else []
            return np.concatenate([x[i * (size // 2):i * (size // 2) + size] for i in at]).astype(np.float32) if len(at) else np.zeros(0, np.float32)

        return xs.map(one)

    return run(samples)


def vector(features, names: list[str]):
    """Features in a fixed order; missing ones are 0."""
    return F.array(*[F.coalesce(features[n], F.lit(0.0)) for n in names])


def feature_names() -> list[str]:
    """Every feature that ``extract`` gives, in a fixed order: the order of a model's vector."""
    from ..kernels import dsp

    return list(dsp.names())
