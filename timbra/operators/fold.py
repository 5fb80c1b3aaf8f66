"""Folds over the ordered rows of each call that never gather a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def folded(rows: DataFrame, step: Callable[[Any, tuple], tuple[Any, tuple | None]], out: dict[str, str]) -> DataFrame:
    """The first column of ``rows`` (the call) and the columns ``out`` (name: type).

    Rows are dealt by call, sorted by all columns and streamed: ``step(state, row)`` gets the
    state that the call's row before left (None at first) and gives the new one and a row of
    ``out``, or None for no row. A task holds one state and one Arrow batch, however long
    the call is."""
    kinds = list(out.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, state = False, None, None
        for b in batches:
            keys, made = [], []
            for call, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not started or call != now:
                    started, now, state = True, call, None
                state, new = step(state, tuple(row))
                if new is not None:
                    keys.append(call)
                    made.append(new)
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            schema = pa.schema([b.schema.field(0), *(pa.field(n, ARROW[k]) for n, k in out.items())])
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), *(pa.array(c, ARROW[k]) for c, k in zip(columns, kinds, strict=True))], schema=schema)

    whole = StructType([rows.schema[0], *(StructField(n, t.dataType) for n, t in zip(out, StructType.fromDDL(", ".join(f"c{i} {k}" for i, k in enumerate(kinds))), strict=True))])
    return rows.repartition(rows.columns[0]).sortWithinPartitions(*rows.columns).mapInArrow(run, whole)
