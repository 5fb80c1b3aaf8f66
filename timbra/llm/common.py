"""Small helpers that the corpus operators share.

``docs`` arguments are DataFrames with at least ``doc_id`` (long) and ``text``
(string); every other column is carried or ignored, never interpreted. Where an
operator visits the texts twice, it matches rows by their place in the stored
files (``numbered``), which no retry changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..storage import cut as written

#: Rows of a scan that form one batch: the unit that messages go to and come from.
BATCH_BITS = 9


def cut(df: DataFrame, *instead_of: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any
    executor. Tables that ``cut`` made and ``df`` takes the place of are deleted then; the
    others stay until the folder is cleared."""
    out = written(df)
    for old in instead_of:
        for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            if path.rsplit("/", 1)[1].startswith("timbra-"):
                place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    return out


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``used`` under names that no operator takes for its own,
    and the function that gives them their names and order back. Names that an operator adds
    begin with two underscores; whatever the caller's columns are called, none is overwritten."""
    names = docs.columns
    held = [c if c in used else f"other{i}" for i, c in enumerate(names)]
    if "_metadata" in docs.columns:  # it would hide where rows are stored
        docs = cut(docs.toDF(*held))
    return docs.toDF(*held), lambda out: out.select(*held).toDF(*names)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__rid``, a name for each row, and ``__batch``, one for each run of at
    most 2**BATCH_BITS rows of a file. Both come from the row's place in its Parquet file,
    so every scan, split and retry gives the same ones; other inputs are written first."""
    place = lambda bits: F.concat_ws(":", F.xxhash64("_metadata.file_path"), F.shiftright("_metadata.row_index", bits))
    try:
        return docs.withColumns({"__rid": place(0), "__batch": place(BATCH_BITS)})
    except AnalysisException:
        return cut(docs).withColumns({"__rid": place(0), "__batch": place(BATCH_BITS)})


def wider(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of ``numbered`` with 2**bits neighbouring batches as one."""
    name = lambda k: F.substring_index("__batch", ":", k)
    return rows.withColumn("__batch", F.concat_ws(":", name(1), F.shiftright(name(-1).cast("long"), bits)))


def runs(batches: Iterator[pa.RecordBatch], key: str = "__batch") -> Iterator[tuple[str, pa.Table]]:
    """Cut a stream of Arrow batches where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        start = 0
        for k, own in groupby(b.column(b.schema.get_field_index(key)).to_pylist()):
            n = sum(1 for _ in own)
            if held and k != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k
            held.append(b.slice(start, n))
            start += n
    if held:
        yield now, pa.Table.from_batches(held)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what the number of partitions is taken from."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_for(spark: SparkSession, size: int, each: int) -> int:
    """So many partitions that one holds about ``each`` of ``size`` bytes; never fewer than
    ``spark.sql.shuffle.partitions``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def pack(payloads: list[bytes], level: int = 3) -> bytes:
    """Byte strings as one compressed blob."""
    import zstandard

    lengths = np.fromiter(map(len, payloads), "<u4", len(payloads))
    return zstandard.ZstdCompressor(level=level).compress(b"".join([np.uint32(len(payloads)).tobytes(), lengths.tobytes(), *payloads]))


def unpack(blob: bytes) -> Iterator[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = 4 + 4 * n
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        yield raw[at:at + size]
        at += size


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts in UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string, as Python tasks return it."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in (x.strip() for x in ddl.split(","))])
