"""Quality rules: an isolation forest over rule statistics, calibrated on labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest looks at: word length, symbols, capitals and exclamation marks. Repeats are
#: left to the base rules: licence lines and personal data would isolate clean documents.
RATIOS = ("r_length", "r_symbols", "r_upper", "r_marks")
BINS = 4000


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # exact numbers for the windows: pairs, then pairs of pairs, then the last word
    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = pairs(at[:-1], at[1:])
    four = pairs(two[:-2], two[2:])
    five = pairs(four[:-1], at[4:])
    again = np.bincount(five)[five] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(text: str | None) -> tuple:
    """COUNTS, then RATIOS. A null text counts as empty; all are 0 without words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly [\x20\x09-\x0D]
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    symbols, dup, again = sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)
    per, size = max(n, 1), max(chars, 1)
    return n, chars, symbols, dup, again, chars / per, symbols / per, (len(raw) - len(raw.translate(None, UPPER))) / size, text.count("!") / per


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(MEASURED)
    for b in batches:
        ids = b.column(0)
        cols = list(zip(*map(statistics, b.column(1).to_pylist()), strict=True)) or [[]] * (len(COUNTS) + len(RATIOS))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(cols))], schema=schema)


MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def measured(docs: DataFrame) -> DataFrame:
    """Rule statistics of every whole text, one row each."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_measure, MEASURED)


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


class Forest:
    """Isolation forest: trees of random splits, as flat arrays.

    Every tree is grown on ``psi`` rows drawn without replacement; a split takes a random
    column that varies and a random value between its extremes. ``score`` is
    2 ** -(mean path length / c(psi)): near 1 for rows that few splits isolate.
    """

    def __init__(self, rows: np.ndarray, n_trees: int = 100, psi: int = 256, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(rows))
        self.limit = max(1, math.ceil(math.log2(max(self.psi, 2))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.psi, replace=False)], rng) for _ in range(n_trees if len(rows) else 0)]

    @staticmethod
    def c(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        column, value, left, length = [], [], [], []

        def leaf(depth: int, n: int) -> None:
            column.append(-1), value.append(0.0), left.append(0), length.append(depth + self.c(n))

        work = [(rows, 0, 0)]
        leaf(0, 0)
        while work:
            part, depth, at = work.pop()
            low, high = part.min(0), part.max(0)
            varies = np.flatnonzero(high > low)
            length[at] = depth + self.c(len(part))
            if depth >= self.limit or len(part) < 2 or not len(varies):
                continue
            k = int(rng.choice(varies))
            split = rng.uniform(low[k], high[k])
            column[at], value[at], left[at] = k, split, len(column)
            below = part[:, k] < split
            for side in (part[below], part[~below]):
                leaf(0, 0)
                if len(side):
                    work.append((side, depth + 1, len(column) - 1))
                else:
                    length[-1] = depth + 1
        return np.array(column), np.array(value), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for column, value, left, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.limit + 1):
                k = column[at]
                inner = k >= 0
                if not inner.any():
                    break
                right = rows[np.arange(len(rows)), np.maximum(k, 0)] >= value[at]
                at = np.where(inner, left[at] + right, at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.c(self.psi), 1e-9))


def fit_forest(stats: DataFrame, n_trees: int = 100, psi: int = 256, seed: int = 3) -> Forest:
    """Grow the forest on n_trees * psi rows that a seeded hash draws: a bound that does not
    grow with the table. Rows that the base rules fail are drawn as well."""
    bound = n_trees * psi
    n = stats.count()
    place = F.xxhash64(F.lit(seed), "doc_id", *COUNTS)
    few = stats if n <= 4 * bound else stats.filter(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * 4 * bound / n))
    drawn = few.select(*RATIOS, place.alias("place")).orderBy("place").limit(bound).toPandas()
    return Forest(drawn[list(RATIOS)].to_numpy(np.float64), n_trees, psi, seed)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in RATIOS])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(rows))], names=[*b.schema.names, "score"])

    return stats.mapInArrow(run, MEASURED + ", score double")


def calibrate(rows: DataFrame, labels: DataFrame, false_rate: float = 0.002) -> float:
    """The lowest score at which rejecting loses at most ``false_rate`` of the labelled good
    rows (quality 1) that the base rules keep. Without labelled rows of both kinds nothing is
    rejected."""
    marks = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).filter("quality is not null")
    own = rows.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", F.floor(F.col("score") * BINS).cast("int").alias("bin"))
    counts = own.join(marks, "doc_id").groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toPandas()
    if not counts["bad"].sum() or not counts["good"].sum():
        return math.inf
    counts = counts.sort_values("bin", ascending=False)
    lost = counts["good"].cumsum() <= false_rate * counts["good"].sum()
    taken = counts[lost.cummin()]
    return math.inf if taken.empty else float(taken["bin"].iloc[-1]) / BINS


def fitted(docs: DataFrame, labels: DataFrame, false_rate: float = 0.002) -> tuple[DataFrame, Forest, float]:
    """(scored statistics, forest, threshold). The statistics are a written table."""
    stats = cut(measured(docs))
    forest = fit_forest(stats)
    rows = scored(stats, forest)
    return rows, forest, calibrate(rows, labels, false_rate)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and score for every row of ``docs``.

    Null or empty texts have no words and fail the base rules; repeated rows are judged
    alike; an empty table gives none; with no labelled rows of either kind, good or bad,
    only the base rules reject.
    """
    rows, _, threshold = fitted(docs, labels)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return rows.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") < F.lit(threshold))).alias("kept"), "score")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns."""
    _, forest, threshold = fitted(docs, labels)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), len(COUNTS) + len(RATIOS))
        failed = (rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0])
        return pd.Series(~failed & (forest.score(rows[:, len(COUNTS):]) < threshold))

    return docs.filter(keep(docs["text"]))
