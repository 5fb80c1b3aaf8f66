"""Connected components by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Each round hooks every label to the smallest label beside it, follows the hooks twice and
    contracts the edges, whose distinct rows shrink at least by half; each round ends in
    written tables that take the place of the last round's. Joins read written tables on both sides, so Spark can broadcast small
    ones by their size and split skewed keys of large ones.
    """
    e = cut(edges.select("a", "b").filter("a <> b").distinct())
    label = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")))
    while not e.isEmpty():
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        hook = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        for _ in range(2):
            up = hook.select(F.col("x").alias("m"), F.col("m").alias("mm"))
            hook = cut(hook.join(up, "m", "left").select("x", F.coalesce("mm", "m").alias("m")), hook)
        label = cut(label.join(hook.select(F.col("x").alias("root"), "m"), "root", "left").select("node", F.coalesce("m", "root").alias("root")), label)
        for end in ("a", "b"):
            new = e.join(hook.select(F.col("x").alias(end), "m"), end, "left").withColumn(end, F.coalesce("m", end)).drop("m")
            e = cut(new.filter("a <> b").distinct() if end == "b" else new, e)
    return label


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) by alternating large-star and
    small-star, until nothing changes.

    Large-star links every larger neighbour of a node to the smallest node beside it (itself
    included); small-star links a node and its smaller neighbours to the smallest of them. The
    least neighbours come from a grouped minimum that is joined back, so a hub is never gathered
    in one task and Spark may split it.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), e)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now
