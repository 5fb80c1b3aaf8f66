"""Running totals and exact quantiles over any number of rows, without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def running(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Add ``before_<v>`` and ``all_<v>``: sums of v over the rows of the group with a smaller
    ``order``, and over all of them. ``order`` is a number, unique in its group.

    Rows are dealt by range, as many ranges as there are shuffle partitions, whatever their
    number, and written with the number of their range, so that every later step sees the same
    ranges; a window runs inside each range and a small one over the ranges' sums.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *by, order).withColumn("__range", F.spark_partition_id()))
    sums = rows.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "__range", *[F.coalesce(F.sum(f"__{v}").over(upto), F.lit(0)).alias(f"__before_{v}") for v in values], *[F.sum(f"__{v}").over(whole).alias(f"all_{v}") for v in values])
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, [*by, "__range"])
    added = {f"before_{v}": F.col(f"__before_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return joined.withColumns(added).drop("__range", *[f"__before_{v}" for v in values])


def quantiles(rows: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """by, samples, q: ARRAY<DOUBLE> of linearly interpolated quantiles, exact."""
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("c"))
    r = running(counts, by, "__v", ["c"])
    holds = lambda k: (F.col("before_c") <= k) & (k < F.col("before_c") + F.col("c"))
    cells = []
    for q in qs:
        at = (F.col("all_c") - 1) * F.lit(q)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("__v"))), F.max(F.when(holds(F.ceil(at)), F.col("__v")))
        part = F.max(at - F.floor(at))
        cells.append(low + (high - low) * part)
    return r.groupBy(*by).agg(F.max("all_c").alias("samples"), F.array(*cells).alias("q"))
