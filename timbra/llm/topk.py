"""Exact top-k search by columnar branch-and-bound.

Queries and candidates are packed into blocks. Every block of queries meets every block of
candidates: blocks of candidates are dealt to groups, and each (query block, group) is a key
of one shuffle, so no vector passes the driver and no task holds more than one block of each
kind. Query blocks are large, so that candidates are sent seldom. A task walks a group's blocks
in turn and carries the k best of each query along, whose least score bounds the search in the
blocks that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import Best, alike, blocks, id_of, matrix, met, rows_a_block, valid

#: Queries in a block, candidates in a block at least and at most, dimensions in a step.
QUERY_BLOCK, ROWS, STEP = 1 << 13, (1 << 12, 1 << 14), 8
FOUND = "query string, query_id long, vec_id long, rid string, score long"


class Block:
    """Candidates in vertical layout: dimensions by falling mass, and for each step the
    length (norm) of what remains of every candidate."""

    def __init__(self, x: np.ndarray):
        real = x.astype(np.float64)
        self.order = np.argsort(-(real ** 2).sum(1), kind="stable")
        self.x = np.ascontiguousarray(x[self.order])
        tail = np.cumsum((real[self.order] ** 2)[::-1], axis=0)[::-1]
        self.rest = [np.sqrt(tail[d]) if d < len(tail) else np.zeros(x.shape[1]) for d in range(0, len(x) + STEP, STEP)]

    def best(self, q: np.ndarray, k: int, least, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores): every candidate that may be among the k best or ties with
        them; ``least`` is a score that k others have already, or None."""
        q = q[self.order]
        alive = np.arange(self.x.shape[1])
        if skip is not None:
            alive = np.delete(alive, skip)
        total = np.zeros(len(alive), self.x.dtype)
        length = np.sqrt(np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1])
        for step, d in enumerate(range(0, len(q), STEP)):
            part = self.x[d:d + STEP] if len(alive) == self.x.shape[1] else self.x[d:d + STEP, alive]
            total = total + q[d:d + STEP] @ part
            if d + STEP >= len(q) or len(alive) <= k:
                continue
            slack = length[d + STEP] * self.rest[step + 1][alive] * (1 + 1e-9) + 1
            real = total.astype(np.float64)
            bound = np.partition(real - slack, len(alive) - k)[len(alive) - k]
            if least is not None:
                bound = max(bound, float(least))
            keep = real + slack >= bound
            alive, total = alive[keep], total[keep]
        return alive, total


class Search:
    """A block of queries with the k best candidates so far of each."""

    schema = FOUND

    def __init__(self, t: pa.Table, k: int):
        self.k, self.x = k, matrix(t.column("embedding"))
        self.ids, self.places = t.column("vec_id").to_pylist(), t.column("__rid").to_pylist()
        self.best = [Best(k) for _ in self.ids]

    def look(self, t: pa.Table) -> None:
        k, own_x = self.k, matrix(t.column("embedding"))
        q, x = alike(self.x, own_x)
        block = Block(np.ascontiguousarray(x.T))
        places, ids = t.column("__rid").to_pylist(), t.column("vec_id").to_pylist()
        where = {p: i for i, p in enumerate(places)}
        for row, place, best in zip(q, self.places, self.best, strict=True):
            at, scores = block.best(row, k, best.least() if len(best.rows) == k else None, where.get(place))
            good = scores >= best.least()
            at, scores = at[good], scores[good]
            if len(at) > 4 * k:
                few = np.argpartition(-scores.astype(np.float64), k)[:k]
                good = scores >= scores[few].min()
                at, scores = at[good], scores[good]
            best.add([int(s) for s in scores], [ids[i] for i in at], [places[i] for i in at])

    def rows(self) -> Iterator[tuple]:
        for i, place, best in zip(self.ids, self.places, self.best, strict=True):
            for r in best.rows:
                yield place, i, id_of(r), r[3], -r[0]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k
    rows other than itself with the highest inner products of floor(256 * x), ties to the
    smaller vec_id (null last, then by place).

    Each query block meets each candidate block once, where their key sends them; a group
    returns k rows a query. Null vectors and those with null or non-finite components take no
    part; vectors of other lengths count as filled up with zeros; rows that repeat a vec_id
    are rows of their own; an empty table gives none. Other columns are never read.
    """
    rows = cut(valid(vectors))
    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = cut(blocks(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK))), QUERY_BLOCK))
    parts = met(queries, cut(blocks(rows, rows_a_block(rows, *ROWS))), Search, k)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
