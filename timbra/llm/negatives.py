"""Hard-negative mining over rotated one-bit codes.

Every vector is kept as a few one-bit codes: the signs of the rotated vector, then of what
that code leaves, and so on, each with its alignment (the vector's product with the code's unit
vector), and the length of what all codes leave. An anchor's product with a code is popcounts
over bit planes of the rotated anchor; what the codes leave adds at most its length times the
anchor's (Cauchy-Schwarz), so each score has a certain interval. Rows whose interval cannot
reach the result go, code by code; the others are scored with integers.

Anchors and rows travel in blocks; each (anchor block, group of row blocks) is a key of one
shuffle, and anchor blocks are so large that a row is sent a few times in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import Best, alike, blocks, id_of, matrix, met, rows_a_block, valid

#: One-bit codes a vector, bits of an anchor's component, seed of the rotations.
CODES, PLANES, SEED = 4, 4, 7
#: Anchors in a block; rows in a block at least and at most.
ANCHORS, ROWS = 1 << 13, (1 << 11, 1 << 16)
POSITIVES = "anchor string, anchor_id long, positive string, positive_id long, score long"
NEGATIVES = "anchor string, anchor_id long, positive string, positive_id long, positive_score long, negative string, negative_id long, negative_score long"


@cache
def rotation(width: int, k: int) -> np.ndarray:
    """A seeded orthogonal matrix; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, k)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def padded(x: np.ndarray) -> np.ndarray:
    """Doubles, as wide as whole 64-bit words."""
    wide = max(64, -(-x.shape[1] // 64) * 64)
    return np.hstack([x.astype(np.float64), np.zeros((len(x), wide - x.shape[1]))])


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits: codes x rows x words, alignments: codes x rows, what is left: codes x rows)."""
    rest, bits, along, left = padded(x), [], [], []
    unit = 1 / np.sqrt(rest.shape[1])
    for k in range(CODES):
        turned = rest @ rotation(rest.shape[1], k)
        sign = np.where(turned > 0, unit, -unit)
        a = (turned * sign).sum(1)
        rest = rest - (a[:, None] * sign) @ rotation(rest.shape[1], k).T
        bits.append(np.packbits(turned > 0, axis=1, bitorder="little").view("<u8"))
        along.append(a), left.append(np.sqrt((rest ** 2).sum(1)))
    return np.array(bits), np.array(along), np.array(left)


class Planes:
    """Rotated anchors in bit planes; ``wrong`` is the length of what the planes leave out."""

    def __init__(self, x: np.ndarray):
        q = padded(x)
        self.width, self.length = q.shape[1], np.sqrt((q ** 2).sum(1))
        self.unit = 1 / np.sqrt(q.shape[1])
        self.least, self.step, self.bits, self.sums, self.wrong = [], [], [], [], []
        for k in range(CODES):
            turned = q @ rotation(q.shape[1], k)
            least = turned.min(1)
            step = (turned.max(1) - least) / ((1 << PLANES) - 1)
            step[step == 0] = 1.0
            u = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
            near = least[:, None] + step[:, None] * u
            self.bits.append(np.packbits((u[:, None] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1, axis=2, bitorder="little").view("<u8"))
            self.least.append(least), self.step.append(step), self.sums.append(near.sum(1))
            self.wrong.append(np.sqrt(((turned - near) ** 2).sum(1)))

    def along(self, i: int, k: int, bits: np.ndarray) -> np.ndarray:
        """Products of anchor ``i`` with the unit vectors of the codes ``bits`` (rows x words)."""
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        weighed = sum(np.bitwise_count(bits & p).sum(1, dtype=np.int64) << b for b, p in enumerate(self.bits[k][i]))
        return self.unit * (2 * (self.least[k][i] * ones + self.step[k][i] * weighed) - self.sums[k][i])


class Block:
    """Rows by label, with their codes."""

    def __init__(self, t: pa.Table):
        labels = t.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        self.labels = labels[order]
        self.x = matrix(t.column("embedding"))[order]
        self.ids = t.column("vec_id").to_numpy(zero_copy_only=False)[order] if not t.column("vec_id").null_count else np.array(t.column("vec_id").to_pylist(), object)[order]
        self.places = np.array(t.column("__rid").to_pylist(), object)[order]
        self.codes = encode(self.x) if self.x.dtype != object else None

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def survivors(self, rows: np.ndarray, i: int, planes: Planes | None, keep) -> np.ndarray:
        """Those of ``rows`` that ``keep(lowest, highest)`` keeps for anchor ``i``, code by code.
        Numbers that doubles do not hold have no intervals: all rows survive."""
        if planes is None or self.codes is None or padded(self.x[:1]).shape[1] != planes.width:
            return rows
        bits, along, left = self.codes
        near, off = np.zeros(len(rows)), np.zeros(len(rows))
        for k in range(CODES):
            if not len(rows):
                break
            a = along[k][rows]
            near = near + a * planes.along(i, k, bits[k][rows])
            off = off + a * planes.wrong[k][i]
            slack = (off + left[k][rows] * planes.length[i]) * (1 + 1e-9) + 1
            kept = keep(near - slack, near + slack)
            if not kept.all():
                rows, near, off = rows[kept], near[kept], off[kept]
        return rows

    def scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        a, b = alike(self.x[rows], q[None])
        return [int(v) for v in (a @ b[0]).tolist()] if len(rows) else []


class _Anchors:
    """A block of anchors with what was found for each."""

    def __init__(self, t: pa.Table):
        self.x = matrix(t.column("embedding"))
        self.labels, self.ids, self.places = (t.column(c).to_pylist() for c in ("label", "vec_id", "__rid"))
        self.planes = Planes(self.x) if self.x.dtype != object else None


class Positives(_Anchors):
    schema = POSITIVES

    def __init__(self, t: pa.Table, k: int):
        super().__init__(t)
        self.best = [Best(k) for _ in self.ids]

    def look(self, t: pa.Table) -> None:
        b = Block(t)
        for i, best in enumerate(self.best):
            own = b.of(self.labels[i])
            rows = np.arange(own.start, own.stop)
            rows = b.survivors(rows[b.places[rows] != self.places[i]], i, self.planes, self._reach(best))
            best.add(b.scores(rows, self.x[i]), b.ids[rows].tolist(), b.places[rows].tolist())

    @staticmethod
    def _reach(best: Best):
        def keep(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            least = best.least()
            if len(lowest) > best.k:
                least = max(least, np.partition(lowest, len(lowest) - best.k)[len(lowest) - best.k])
            return highest >= least

        return keep

    def rows(self) -> Iterator[tuple]:
        for i, place, best in zip(self.ids, self.places, self.best, strict=True):
            for r in best.rows:
                yield place, i, r[3], id_of(r), -r[0]


class Negatives(_Anchors):
    schema = NEGATIVES

    def __init__(self, t: pa.Table, k: int, share: tuple[int, int]):
        super().__init__(t)
        self.share = share
        self.positives = t.column("positives").to_pylist()
        self.best = [[Best(k) for _ in own] for own in self.positives]

    def look(self, t: pa.Table) -> None:
        b = Block(t)
        low, high = self.share
        for i, (positives, bests) in enumerate(zip(self.positives, self.best, strict=True)):
            own = b.of(self.labels[i])
            rows = np.concatenate([np.arange(own.start), np.arange(own.stop, len(b.ids))])
            ranges = [(max(low * p["score"] / 100 - 1, best.least()), high * p["score"] / 100 + 1) for p, best in zip(positives, bests, strict=True)]
            rows = b.survivors(rows, i, self.planes, lambda lowest, highest: np.any([(highest >= x) & (lowest <= y) for x, y in ranges], axis=0))  # noqa: B023
            scores = np.array(b.scores(rows, self.x[i]), object)
            if len(scores) and max(map(abs, scores)) < 1 << 53:
                scores = scores.astype(np.int64)
            for p, best in zip(positives, bests, strict=True):
                inside = np.flatnonzero((scores * 100 >= low * p["score"]) & (scores * 100 <= high * p["score"]) & (scores >= best.least()))
                if len(inside) > 4 * best.k:  # ties with the last one stay
                    s = scores[inside].astype(np.float64)
                    inside = inside[s >= np.partition(s, len(s) - best.k)[len(s) - best.k]]
                at = rows[inside]
                best.add([int(v) for v in scores[inside]], b.ids[at].tolist(), b.places[at].tolist())

    def rows(self) -> Iterator[tuple]:
        for i, place, positives, bests in zip(self.ids, self.places, self.positives, self.best, strict=True):
            for p, best in zip(positives, bests, strict=True):
                for r in best.rows:
                    yield place, i, p["place"], p["id"], p["score"], r[3], id_of(r), -r[0]


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of ``vectors`` (vec_id, embedding, label) whose vec_id is divisible by
    ``every``. Scores are integer products of floor(256 * x). For each anchor and each of its
    best ``positives`` other rows of its label come the best ``negatives`` rows of other labels
    whose score is ``share`` per cent of the positive's. Ties go to the smaller vec_id (null
    last, then by place).

    Null labels, null vectors and those with null or non-finite components take no part; shorter
    vectors count as filled up with zeros; rows that repeat a vec_id are rows of their own; an
    anchor without positives, or without negatives in range, and an empty table give no rows.
    """
    rows = cut(valid(vectors, label=F.col("label").cast("long")).filter("label is not null"))
    held = cut(blocks(rows, rows_a_block(rows, *ROWS)))
    asked = cut(rows.filter(F.col("vec_id") % every == 0))
    packed = lambda a: cut(blocks(a.repartition(max(1, -(-asked.count() // ANCHORS))), ANCHORS))
    found = met(packed(asked), held, Positives, positives)
    order = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1])
    best = found.withColumn("rank", F.row_number().over(order(["anchor"], [F.col("score").desc(), F.col("positive_id").asc_nulls_last(), "positive"]))).filter(F.col("rank") <= positives)
    listed = cut(best.groupBy("anchor").agg(F.collect_list(F.struct(F.col("positive").alias("place"), F.col("positive_id").alias("id"), "score")).alias("positives")))
    out = met(packed(asked.join(listed.withColumnRenamed("anchor", "__rid"), "__rid")), held, Negatives, negatives, share)
    rank = F.row_number().over(order(["anchor", "positive"], [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "negative"]))
    return out.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
