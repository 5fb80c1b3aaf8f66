"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, set_aside

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of the seeded order that each refinement of a source's cut-off settles.
LEVEL_BITS, LEVELS = 8, 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and ``u``, the row's seeded place."""
    return docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.coalesce(F.regexp_count(docs["text"], F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def source_key(source):
    """A non-null key that tells null from the empty string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source))


def place(seed: int, doc_id, size, skey):
    return F.xxhash64(F.lit(seed), doc_id, size, skey)


def ranked_sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """skey, source_size, weight: weights repeat along the sources in code point order,
    null last. The order is a distributed sort; only a count for each range meets in one task."""
    sums = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.max("source").alias("source"))
    at = cut(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("m", F.monotonically_increasing_id()))
    at = at.withColumn("part", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "start")
    rank = (F.col("start") + F.col("i")) % len(weights)
    return at.join(starts, "part").select("skey", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int, budget: float | None = None) -> DataFrame:
    """Add ``target``: each round clamps the sources above their cap and reshares what is
    left by weight among the others, until none is above. A round is one aggregate."""
    sources = cut(sources.withColumn("cap", F.col("source_size") * max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    total = total if budget is None else budget
    fixed, left = 0, sources.agg(F.sum("weight")).first()[0] or 0
    num, den = total, max(left, 1)
    above = lambda num, den: F.col("weight") * F.lit(float(num)) > F.col("cap") * F.lit(float(den))
    while True:
        fixed, used = sources.filter(above(num, den)).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        rest = max(left - used, 0)
        new = (total - fixed, rest) if rest else (num, den)
        if new == (num, den):
            break
        num, den = new
    level = F.col("weight") * F.lit(float(num)) / F.lit(float(den))
    return sources.withColumn("target", F.when(above(num, den), F.col("cap").cast("double")).otherwise(F.least(level, F.col("cap").cast("double"))))


def plan(rows: DataFrame, sources: DataFrame, max_epochs: int) -> DataFrame:
    """skey, source_size, target, whole, upto: a document is taken ``whole`` times, and once
    more if its place is at most ``upto`` (null: none). The cut-off in the seeded order is
    found by sums over ranges of places, refined range by range, so that no source's rows
    are ever gathered; the last range of some rows is walked."""
    ratio = F.col("target") / F.col("source_size")
    s = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(max_epochs))).otherwise(0).cast("long"))
    s = cut(s.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    live = s.filter("need > 0").select("skey", "need", F.lit(0).cast("long").alias("prefix"))
    for k in range(1, LEVELS + 1):
        kept = rows.filter("size > 0").join(live, "skey")
        if k > 1:
            kept = kept.filter(F.shiftrightunsigned("u", 64 - LEVEL_BITS * (k - 1)) == F.col("prefix"))
        sums = kept.groupBy("skey", F.shiftrightunsigned("u", 64 - LEVEL_BITS * k).alias("next")).agg(F.sum("size").alias("n"), F.first("need").alias("need"))
        upto = Window.partitionBy("skey").orderBy("next")
        sums = sums.withColumn("c", F.sum("n").over(upto)).filter((F.col("c") >= F.col("need")) & (F.col("c") - F.col("n") < F.col("need")))
        live = cut(sums.select("skey", (F.col("need") - F.col("c") + F.col("n")).alias("need"), F.col("next").alias("prefix")))
    last = rows.filter("size > 0").join(live, "skey").filter(F.shiftrightunsigned("u", 64 - LEVEL_BITS * LEVELS) == F.col("prefix"))
    # places compare as unsigned numbers: the top bit is flipped
    last = last.withColumn("place", F.col("u").bitwiseXOR(-(1 << 63))).groupBy("skey", "place").agg(F.sum("size").alias("n"), F.first("need").alias("need"), F.first("prefix").alias("prefix"))
    last = last.withColumn("c", F.sum("n").over(Window.partitionBy("skey").orderBy("place")))
    best = last.withColumn("off", F.abs(F.col("c") - F.col("need"))).groupBy("skey").agg(F.min_by("place", "off").alias("at"), F.min("off").alias("off"), F.max("need").alias("need"), F.max("prefix").alias("prefix"))
    edge = F.shiftleft("prefix", 64 - LEVEL_BITS * LEVELS).bitwiseXOR(-(1 << 63)) - 1
    best = best.select("skey", F.when(F.col("off") <= F.col("need"), F.col("at")).when(F.col("prefix") > 0, edge).alias("upto"))
    return s.join(best, "skey", "left").select("skey", "source_size", "target", "whole", "upto")


def copies(whole, upto, u):
    return (whole + F.when(u.bitwiseXOR(-(1 << 63)) <= upto, 1).otherwise(0)).cast("int")


def decisions(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): a row for each document, and each source's plan. Both are written tables."""
    rows = sizes(docs).withColumn("skey", source_key(F.col("source")))
    rows = cut(rows.withColumn("u", place(seed, F.col("doc_id"), F.col("size"), F.col("skey"))))
    sources = water_fill(ranked_sources(rows, weights), max_epochs)
    return rows, cut(plan(rows, sources, max_epochs))


def mix_report(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Sources share the sum of all sizes by weight; a source stops at ``max_epochs`` times its
    size and the excess is reshared. A document counts in whole repetitions; the fraction
    that is left takes whole documents in a seeded order up to the nearest document.
    Null or empty texts have size 0 and take nothing; a null source is a source of its own,
    last; rows with equal doc_id, size and source are taken alike; an empty table gives none.
    """
    rows, p = decisions(docs, max_epochs, weights, seed)
    n = copies(F.col("whole"), F.col("upto"), F.col("u"))
    return rows.join(p, "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"))


def mixed(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20) -> DataFrame:
    """The documents of the mix, all columns, each as often as it is taken. Documents
    without words stay out: they add nothing to any source."""
    docs, given_back = set_aside(docs, "doc_id", "text", "source")
    _, p = decisions(docs, max_epochs, weights, seed)
    p = p.select(F.col("skey").alias("__skey"), F.col("whole").alias("__whole"), F.col("upto").alias("__upto"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    n = F.when(F.col("__size") > 0, copies(F.col("__whole"), F.col("__upto"), place(seed, F.col("doc_id"), F.col("__size"), F.col("__skey")))).otherwise(0)
    rows = docs.withColumn("__size", size).withColumn("__skey", source_key(F.col("source"))).join(p, "__skey").withColumn("__n", n).filter("__n > 0")
    return given_back(rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))))
