"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, cut, numbered, set_aside
from .graph import components

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Two segments: of DISTANCE = 3 differing bits, one segment has at most one.
HALF = BITS // 2
#: Buckets beyond this many distinct fingerprints are cut again by the other segment.
BUCKET = 2048


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist(), strict=False)], "<u8")
    m = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, m, 1 << 16):  # a bounded matrix of bits, however long the text
        ones += np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and the columns ``more`` of every row."""
    kinds = "".join(f", {c} string" for c in more)
    schema = f"doc_id long, fp long{kinds}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter(map(fingerprint, as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], schema=arrow_schema(schema))

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, schema)


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key, sub): each segment once as it is and once with each of its bits left out."""
    v = F.explode(F.sequence(F.lit(0), F.lit(2 * (HALF + 1) - 1))).alias("v")
    w = F.col("v") % (HALF + 1)
    part = F.when(F.col("v") > HALF, F.col("fp").bitwiseAND((1 << HALF) - 1)).otherwise(F.shiftrightunsigned("fp", HALF))
    seen = F.when(w == HALF, part).otherwise(part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), w.cast("int")))))
    return fps.select("fp", v).select("fp", F.call_function("shiftleft", F.col("v").cast("long"), F.lit(HALF)).bitwiseOR(seen).alias("key"), F.lit(0).cast("long").alias("sub"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of links a-b, some that connect the same nodes without a cycle."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def links(fps: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of one bucket, enough of them to connect what it connects. In the
    bucket of a left-out bit only fingerprints that differ there are compared: the others
    meet where their whole segments are equal."""
    v = key >> HALF
    w = v % (HALF + 1)
    if w == HALF:
        rows, columns = fps, fps
    else:
        bit = (fps >> np.uint64(w + (0 if v > HALF else HALF))) & np.uint64(1)
        rows, columns = fps[bit == 0], fps[bit == 1]
    a, b = [], []
    if len(rows) and len(columns):
        for k in range(0, len(rows), 256):
            near = np.bitwise_count(rows[k:k + 256, None] ^ columns[None, :]) <= DISTANCE
            i, j = np.nonzero(near)
            x, y = rows[k:k + 256][i], columns[j]
            keep = x < y if w == HALF else slice(None)
            x, y = x[keep], y[keep]
            if len(x) > 512:
                few = _forest(x, y)
                x, y = x[few], y[few]
            a.append(x), b.append(y)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


LINKS = "a long, b long, more boolean"


def _matched(rows: DataFrame, bound: int | None) -> DataFrame:
    """Walk sorted buckets: links (a, b, false); or, from buckets beyond ``bound``, the rows
    (fingerprint, key, true) for a further cut. Memory: one bucket up to the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(LINKS)
        held, held_key, spilled = [], None, False

        def pack(a, b, more: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b).astype(np.int64) if more else np.asarray(b, np.uint64).view(np.int64)), pa.array(np.full(len(a), more))], schema=out)

        def done() -> Iterator[pa.RecordBatch]:
            if held and held_key is not None:
                fps = np.concatenate(held)
                if spilled:
                    yield pack(fps, np.full(len(fps), held_key[0]), True)
                elif len(fps) > 1:
                    a, b = links(fps, held_key[0])
                    if len(a):
                        yield pack(a, b, False)

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            if not len(fps):
                continue
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(subs) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            wide = np.flatnonzero(ends - starts > 1)
            wide = sorted({0, len(starts) - 1, *wide.tolist()})  # the ends may go on in other batches
            for g in wide:
                s, e = starts[g], ends[g]
                now = (int(keys[s]), int(subs[s]))
                if now != held_key:
                    yield from done()
                    held, held_key, spilled = [], now, False
                held.append(fps[s:e])
                if bound and sum(map(len, held)) > bound:
                    spilled = True
                    yield pack(np.concatenate(held), np.full(sum(map(len, held)), now[0]), True)
                    held = []
        yield from done()

    return rows.mapInArrow(run, LINKS)


def finer(rows: DataFrame) -> DataFrame:
    """(fp, key, sub) of crowded buckets: the other segment, too, is cut in two, of which one
    differs by at most one bit. A bucket then fixes 46 bits, so it has at most 2**18 members."""
    q = HALF // 2
    v = F.explode(F.sequence(F.lit(0), F.lit(2 * (q + 1) - 1))).alias("v")
    w = F.col("v") % (q + 1)
    low = F.col("key") > F.lit(((HALF + 1) << HALF) - 1)  # the key holds the low segment
    other = F.when(low, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND((1 << HALF) - 1))
    part = F.when(F.col("v") > q, other.bitwiseAND((1 << q) - 1)).otherwise(F.shiftrightunsigned(other, q))
    seen = F.when(w == q, part).otherwise(part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), w.cast("int")))))
    return rows.select("fp", "key", v).select("fp", "key", F.call_function("shiftleft", F.col("v").cast("long"), F.lit(q)).bitwiseOR(seen).alias("sub"))


def linked(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that connect all within DISTANCE."""
    dealt = lambda rows: rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
    first = cut(_matched(dealt(variants(fps)), BUCKET))
    crowded = first.filter("more").select(F.col("a").alias("fp"), F.col("b").alias("key"))
    second = _matched(dealt(finer(crowded)), None)
    return first.filter("not more").select("a", "b").union(second.select("a", "b"))


def classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``rows`` (doc_id, fp)."""
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(firsts.select("fp")))
    known = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(known.groupBy("root").agg(F.min("first").alias("component_id")))
    return cut(known.join(least, "root").select("fp", "component_id"))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; a null doc_id never
    is a component's smallest one unless all are null; repeated rows share a class; an empty
    table gives none. Copies with one fingerprint are one node, never pairs.
    """
    rows = cut(fingerprints(docs))
    return rows.join(classes(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each class the one with the smallest
    doc_id, of several such rows the first by place."""
    docs, given_back = set_aside(docs, "doc_id", "text")
    rows = cut(fingerprints(numbered(docs), "__rid"))
    best = rows.join(classes(rows), "fp").groupBy("component_id").agg(F.min_by("__rid", F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")).alias("__rid"))
    return given_back(numbered(docs).join(best.select("__rid"), "__rid", "left_semi"))
