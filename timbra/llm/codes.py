"""Vector code compression: product codes by Lloyd rounds over two trees.

Every batch of rows gets, for each part of the vectors, a tree of boxes over its parts; the
codebook's entries have one as well. Both are walked from the top: a pair of nodes is dropped
if its least distance exceeds the most that another pair of the same node can have. Where one
entry is left, all parts of the node are assigned and their cached sum is added at once; leaves
where several are left are decided by integer distances. A round is one scan without a shuffle
of rows: tasks return sums for each part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut
from .vectors import integers, matrix, valid

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Parts in a leaf at most.
LEAF = 16
#: Components beyond this are Python integers, whose squares do not overflow.
LARGE = float(1 << 26)


@dataclass
class Tree:
    """Balanced box trees, one for each part position. Level k has 2**k nodes a position, the
    last one the leaves. ``order`` lists the rows by leaf; rows from ``real`` on only fill up."""

    order: np.ndarray  # positions x rows
    points: np.ndarray  # positions x rows x width, by leaf
    real: int
    low: list[np.ndarray]  # for each level: (positions * nodes) x width
    high: list[np.ndarray]
    sums: list[np.ndarray]
    counts: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def tree(x: np.ndarray, leaf: int) -> Tree:
    """Trees over ``x`` (positions x rows x width)."""
    parts, n, width = x.shape
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    size = -(-n // (1 << depth))
    rows = np.minimum(np.arange(size << depth), n - 1)
    order = np.broadcast_to(np.arange(size << depth), (parts, size << depth)).copy()
    x = x[:, rows]
    for k in range(depth):
        cells = x.reshape(parts, 1 << k, -1, width)
        along = (cells.max(2) - cells.min(2)).argmax(2)
        by = np.take_along_axis(cells, along[:, :, None, None], 3)[..., 0].argsort(2, kind="stable")
        x = np.take_along_axis(cells, by[..., None], 2).reshape(parts, -1, width)
        order = np.take_along_axis(order.reshape(parts, 1 << k, -1), by, 2).reshape(parts, -1)
    cells = x.reshape(parts << depth, size, width)
    real = (order < n).reshape(parts << depth, size)
    low, high = [cells.min(1)], [cells.max(1)]
    sums, counts = [np.where(real[..., None], cells, 0).sum(1)], [real.sum(1)]
    for _ in range(depth):
        two = lambda a: a.reshape(len(a) // 2, 2, *a.shape[1:])
        low.insert(0, two(low[0]).min(1)), high.insert(0, two(high[0]).max(1))
        sums.insert(0, two(sums[0]).sum(1)), counts.insert(0, two(counts[0]).sum(1))
    return Tree(order, x, n, low, high, sums, counts)


def _starts(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))


@dataclass
class Assigned:
    """What one walk of both trees gives. ``pairs`` counts the bounds and distances computed."""

    entry: np.ndarray  # positions x rows
    sums: np.ndarray  # positions x entries x width
    counts: np.ndarray  # positions x entries
    pairs: int


def assign(points: Tree, entries: Tree, n_entries: int) -> Assigned:
    """The nearest entry of every part, ties to the lower index."""
    parts, rows, width = points.points.shape
    chosen = np.full((parts, rows), -1, np.int64)
    sums, counts = np.zeros((parts, n_entries, width), points.points.dtype), np.zeros((parts, n_entries), np.int64)
    node, other, k, j, pairs = np.arange(parts), np.arange(parts), 0, 0, 0
    while len(node):
        gap = np.maximum(np.maximum(entries.low[j][other] - points.high[k][node], points.low[k][node] - entries.high[j][other]), 0)
        reach = np.maximum(points.high[k][node] - entries.low[j][other], entries.high[j][other] - points.low[k][node])
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        pairs += len(node)
        starts = _starts(node)
        n = np.diff(np.concatenate([starts, [len(node)]]))
        kept = least <= np.repeat(np.minimum.reduceat(most, starts), n)
        node, other = node[kept], other[kept]
        starts = _starts(node)
        n = np.diff(np.concatenate([starts, [len(node)]]))
        if j == entries.depth:  # nodes are single entries now
            sure = starts[n == 1]
            at, e = node[sure], entries.order.ravel()[other[sure]]
            part, size = at >> k, rows >> k
            chosen.reshape(parts << k, size)[at] = e[:, None]
            np.add.at(sums, (part, e), points.sums[k][at])
            np.add.at(counts, (part, e), points.counts[k][at])
            open_ = np.repeat(n > 1, n)
            node, other = node[open_], other[open_]
            if k == points.depth:
                break
        if k < points.depth:
            node, other, k = (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(other, 2), k + 1
        if j < entries.depth:
            node, other, j = np.repeat(node, 2), (2 * other[:, None] + np.arange(2)).ravel(), j + 1
        by = np.lexsort((other, node))
        node, other = node[by], other[by]
        if j == entries.depth:
            there = entries.order.ravel()[other] < n_entries
            node, other = node[there], other[there]
    if len(node):  # uncertain leaves, by integers
        size = rows >> k
        cells = points.points.reshape(parts << k, size, width)
        e = entries.order.ravel()[other]
        away = cells[node] - entries.points.reshape(-1, width)[other][:, None]
        far = (away * away).sum(2)
        pairs += far.size
        starts = _starts(node)
        n = np.diff(np.concatenate([starts, [len(node)]]))
        best = np.repeat(np.minimum.reduceat(far, starts), n, axis=0)
        nearest = np.minimum.reduceat(np.where(far == best, e[:, None], n_entries), starts)
        at = node[starts]
        chosen.reshape(parts << k, size)[at] = nearest
        real = points.order.reshape(parts << k, size)[at] < points.real
        part = np.broadcast_to((at >> k)[:, None], nearest.shape)
        np.add.at(sums, (part[real], nearest[real]), cells[at][real])
        np.add.at(counts, (part[real], nearest[real]), 1)
    entry = np.empty_like(chosen)
    np.put_along_axis(entry, points.order, chosen, 1)
    return Assigned(entry[:, :points.real], sums, counts, pairs)


def cut_up(x: np.ndarray, parts: int) -> np.ndarray:
    """positions x rows x width of a matrix of whole vectors; integers that cannot overflow."""
    x = x if x.dtype == object else x.astype(np.int64) if float(np.abs(x).max(initial=0)) < LARGE else integers(x)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


SUMS = "part int, entry int, place int, total string, n long"
CODED = "vec_id long, label string, code string, error long"


@dataclass
class Codebooks:
    """positions x entries x width integers; ``width`` components of a vector are coded."""

    entries: np.ndarray
    width: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def walks(self, batch: pa.RecordBatch) -> tuple[np.ndarray, Assigned]:
        x = cut_up(matrix(batch.column(0), self.width), len(self.entries))
        e = self.entries
        if object in (x.dtype, e.dtype):
            x, e = x.astype(object), e.astype(object)
        return x, assign(tree(x, LEAF), tree(e, 1), e.shape[1])


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """Parts of the vectors with the smallest ids (null last; of equal ids the smaller vector)."""
    widest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-max(widest, 1) // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    x = matrix(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    return Codebooks(cut_up(x, parts), width)


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One Lloyd round: every used entry becomes the floor of its parts' mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, 0
        for b in batches:
            if b.num_rows:
                _, got = books.walks(b)
                wide = got.sums.astype(object)  # sums of any number of rows
                sums, counts = wide if sums is None else sums + wide, counts + got.counts
        if sums is not None:
            used = [(p, e, c, str(int(sums[p, e, c])), int(counts[p, e])) for p, e in np.argwhere(counts).tolist() for c in range(sums.shape[2])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in used], f.type) for i, f in enumerate(arrow_schema(SUMS))], schema=arrow_schema(SUMS))

    total = rows.select("embedding").mapInArrow(run, SUMS).groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = books.entries.astype(object)
    for r in total.collect():  # as many rows as the codebooks have components
        new[r.part, r.entry, r.place] = int(r.total) // r.n
    fits = max((abs(v) for v in new.ravel()), default=0) < LARGE
    return Codebooks(new.astype(np.int64) if fits else new, books.width)


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every row; an error too large for
    a long is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(CODED)
        for b in batches:
            if not b.num_rows:
                continue
            x, got = books.walks(b)
            near = np.take_along_axis(books.entries.astype(x.dtype), got.entry[..., None], 1)
            error = ((x - near) ** 2).sum((0, 2)).tolist()
            codes = got.entry.T.astype(np.uint8).tobytes().hex()
            w = 2 * len(x)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([codes[k * w:k * w + w] for k in range(b.num_rows)]), pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())], schema=schema)

    return rows.select("embedding", "vec_id", "label").mapInArrow(run, CODED)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    return reduce(lambda books, _: improved(rows, books), range(rounds), first_codebooks(rows, parts, entries))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of ``vectors`` (vec_id,
    embedding, label) that takes part.

    Null vectors and those with null or non-finite components (256 times as much, too) take no
    part. Vectors of other lengths, or of a length that ``parts`` does not divide, count as
    filled up with zeros. With fewer rows than ``entries`` the codebooks are smaller; rows that
    repeat an id are rows of their own; null labels share one label_error; an empty table gives
    none. Broadcast to the tasks are the codebooks only.
    """
    rows = valid(vectors, label=F.col("label").cast("string"))
    if rows.isEmpty():
        return coded(rows, Codebooks(np.zeros((parts, 1, 1), np.int64), parts)).select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = fit(rows, parts, entries, rounds)
    out = cut(coded(rows, books))
    each = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(each, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
