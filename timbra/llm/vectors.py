"""Vectors of a table as integer matrices in Arrow batches, and blocks of them as mail."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, numbered

#: Below this, sums of products are exact in doubles.
EXACT = float(1 << 53)
#: A block of rows as an Arrow stream.
BLOCK = "number long, blob binary"
#: What a task is sent: a block of queries, then at least GROUP blocks of rows in large tables.
QUERY_MAIL, ROW_MAIL, GROUP = 0, 1, 16


def valid(vectors: DataFrame, **more: Column) -> DataFrame:
    """(vec_id, embedding, each of ``more``, __rid) of the rows whose vector and components are
    there and finite (256 times a component, too). Nothing else of the table is read, whatever
    its columns are called."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *[c.alias(k) for k, c in more.items()])
    rows = numbered(rows).drop("__batch")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & ~bad)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(256 * x) of a list column, one row a vector, filled up with zeros: doubles whose
    products sum exactly, else Python integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = int(sizes.max(initial=0)) if width is None else width
    if len(flat) == len(sizes) * wide and (sizes == wide).all():
        out = flat.reshape(len(sizes), wide)
    else:
        out = np.zeros((len(sizes), wide))
        row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row[place < wide], place[place < wide]] = flat[place < wide]
    return out if exact(out, out) else integers(out)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold every sum of products of a row of ``a`` and one of ``b``."""
    if object in (a.dtype, b.dtype):
        return False
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < EXACT


def integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as wide as the wider one, in numbers whose products sum exactly."""
    wide = max(a.shape[1], b.shape[1])
    fill = lambda x: x if x.shape[1] == wide else np.hstack([x, np.zeros((len(x), wide - x.shape[1]), x.dtype)])
    a, b = fill(a), fill(b)
    return (a, b) if exact(a, b) else tuple(x if x.dtype == object else integers(x) for x in (a, b))


def stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def narrow(batch: pa.Table) -> pa.Table:
    """``embedding`` in single precision where that is what it holds."""
    at = batch.schema.get_field_index("embedding")
    column = batch.column(at).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        small = flat.astype(np.float32)
    if not np.array_equal(small.astype(np.float64), flat):
        return batch
    return batch.set_column(at, "embedding", pa.ListArray.from_arrays(pa.array(column.offsets.to_numpy() - column.offsets[0].as_py(), pa.int32()), pa.array(small)))


def blocks(rows: DataFrame, size: int, key: str | None = None, shape: Callable[[pa.Table], pa.Table] = narrow) -> DataFrame:
    """``rows`` (with __rid) in blocks of at most ``size``. A block's number is ``key``, at whose
    changes blocks end, or else a hash of its first row's place. A task holds one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def full() -> pa.RecordBatch:
            own = pa.concat_tables(held).combine_chunks()
            number = own.column(key)[0].as_py() if key else int.from_bytes(hashlib.blake2b(own.column("__rid")[0].as_py().encode(), digest_size=7).digest(), "little")
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([stream(shape(own))], pa.binary())], schema=arrow_schema(BLOCK))

        for b in batches:
            b = pa.Table.from_batches([b])
            keys = b.column(key).to_numpy() if key else np.zeros(b.num_rows)
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
            start = 0
            for end in ends:
                while start < end:
                    room = size - sum(x.num_rows for x in held)
                    if held and (not room or key and held[0].column(key)[0].as_py() != keys[start]):
                        yield full()
                        held = []
                        continue
                    n = min(end - start, room)
                    held.append(b.slice(start, n))
                    start += n
        if held:
            yield full()

    return rows.mapInArrow(run, BLOCK)


def rows_a_block(rows: DataFrame, least: int, most: int) -> int:
    """So many that every core has a block, within bounds."""
    return min(most, max(least, rows.count() // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


class Best:
    """The ``k`` highest scores so far, ties to the smaller id, then place."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> float:
        """What a further row must reach."""
        return -self.rows[-1][0] if len(self.rows) == self.k else float("-inf")

    def add(self, scores: list[int], ids, places) -> None:
        found = [(-s, i is None, i or 0, p) for s, i, p in zip(scores, ids, places, strict=True)]
        self.rows = sorted(self.rows + found)[:self.k]


def id_of(row: tuple):
    return None if row[1] else row[2]


def _walk(kind, *args):
    """Sorted mail of keys (query block, group): the queries, then the group's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(kind.schema)

        def full(found) -> Iterator[pa.RecordBatch]:
            rows = list(found.rows())
            for k in range(0, len(rows), 1 << 16):
                some = rows[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(schema)], schema=schema)

        now, found = None, None
        for b in batches:
            for block, group, mail, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, group) != now:
                    if found is not None:
                        yield from full(found)
                    now, found = (block, group), None
                if mail == QUERY_MAIL:
                    found = kind(table(blob), *args)
                elif found is not None:
                    found.look(table(blob))
        if found is not None:
            yield from full(found)

    return run


def met(queries: DataFrame, rows: DataFrame, kind, *args) -> DataFrame:
    """Every block of ``queries`` against every block of ``rows``. ``kind`` is made of a block of
    queries and ``args``, looks at each block of a group of rows and then gives ``rows()`` of its
    ``schema``. A task holds one block of each side; the rows are sent once for each block of
    queries."""
    numbers, n = [r[0] for r in queries.select("number").collect()], max(1, rows.count())  # one number a block
    groups = min(n, max(-(-n // GROUP), -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(numbers)))))
    left = queries.select("number", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(QUERY_MAIL).alias("mail"), "blob")
    right = rows.select(F.explode(F.lit(numbers).cast("array<long>")).alias("number"), F.pmod("number", F.lit(groups)).cast("int").alias("group"), F.lit(ROW_MAIL).alias("mail"), "blob")
    mail = left.unionByName(right).repartition("number", "group").sortWithinPartitions("number", "group", "mail")
    return mail.mapInArrow(_walk(kind, *args), kind.schema)
