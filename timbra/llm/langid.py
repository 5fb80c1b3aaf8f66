"""Language identification by Bayesian evidence fusion: text, declared language, address, host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, cut

#: Hashed classes of byte triples that each language has a likelihood for, and their pseudo-count.
BUCKETS, ALPHA = 1 << 14, 0.5
#: Triples overlap: so many of them count as one independent observation.
OVERLAP = 3.0
#: Weight of what stands above: a declaration's and a suffix's prior, the domain over the
#: host, all pages over the domain.
DECLARED_PRIOR, SUFFIX_PRIOR, DOMAIN_WEIGHT, GLOBAL_WEIGHT = 1.0, 5.0, 5.0, 5.0
DECLARED_FLOOR = 0.1
#: Languages whose likelihoods a task holds at once; more of them take more passes.
LANGUAGE_BLOCK = 64

DROPPED = re.compile(rb"(?is)<(script|style|nav|footer|head|noscript)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>")
TITLE, ARTICLE, TAG, ENTITY = re.compile(rb"(?is)<title[^>]*>(.*?)</title>"), re.compile(rb"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>"), re.compile(rb"(?s)<[^>]*>"), re.compile(rb"&#?[A-Za-z0-9]{1,10};")
DECLARED = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})"


def main_text(html: bytes) -> bytes:
    """The title and what a page says itself: its article if it has one, else all that is not
    navigation, advertising, script or footer."""
    title = TITLE.search(html)
    own = ARTICLE.search(html)
    body = own[2] if own else DROPPED.sub(b" ", html)
    return ENTITY.sub(b" ", TAG.sub(b" ", (title[1] if title else b"") + b" " + body))


def triples(text: bytes) -> np.ndarray:
    """Hashed classes of the byte triples of the text: A-Z lower-cased, digits and signs of
    ASCII are spaces, runs of spaces one."""
    line = b" ".join(text.lower().translate(_LETTERS).split())
    raw = np.frombuffer(line, np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def languages(docs: DataFrame) -> list[str]:
    """The languages that documents are in, in order."""
    return sorted(r[0] for r in docs.select(F.lower(F.trim("lang")).alias("lang")).filter("lang <> ''").distinct().collect())


def text_model(docs: DataFrame, names: list[str]) -> np.ndarray:
    """Log likelihoods [bucket, language] of ``names``, from all whole texts in one of them.
    Tasks send BUCKETS counts a language at most; so many reach the driver in all."""
    known = docs.select(F.lower(F.trim("lang")).alias("lang"), "text").filter(F.col("lang").isin(names))
    place = {n: k for k, n in enumerate(names)}
    schema = "language int, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), BUCKETS), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                seen[place[lang]] += np.bincount(triples(text), minlength=BUCKETS)
        a, c = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(seen[a, c])], schema=arrow_schema(schema))

    rows = known.mapInArrow(run, schema).groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(names)), ALPHA)
    counts[rows["bucket"], rows["language"]] += rows["n"]
    return np.log(counts / counts.sum(0))


READ = "page_id long, url string, declared string, html string, grams long, likelihood array<double>"


def _heard(table: np.ndarray, last: bool):
    """Add the likelihoods of one block of languages to each page; the last one drops the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(READ)
        for b in batches:
            rows = [triples(main_text(x)) for x in as_bytes(b.column(3))]
            ll = [[*known, *(table[r].sum(0) / OVERLAP).tolist()] for known, r in zip(b.column(5).to_pylist(), rows, strict=True)]
            html = pa.nulls(b.num_rows, pa.string()) if last else b.column(3)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], html, pa.array([len(r) for r in rows], pa.int64()), pa.array(ll, schema.field("likelihood").type)], schema=schema)

    return run


def read_pages(pages: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """Each page's text evidence, declared language, host, domain and suffix: a written table."""
    html = F.coalesce(pages["html"], F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(html, DECLARED, 1)), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), declared.alias("declared"), html.alias("html"), F.lit(0).cast("long").alias("grams"), F.array().cast("array<double>").alias("likelihood"))
    for start in range(0, len(names), LANGUAGE_BLOCK):
        table = text_model(docs, names[start:start + LANGUAGE_BLOCK])
        rows = rows.mapInArrow(_heard(table, start + LANGUAGE_BLOCK >= len(names)), READ)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    labels = F.split("host", r"\.")
    return cut(rows.withColumn("host", host).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")).withColumn("suffix", F.element_at(labels, -1)).drop("url", "html"))


def _counted(sure: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, name_n): for each key, pages by the language that their text alone says."""
    pairs = sure.groupBy(key, "guess").agg(F.count("*").cast("double").alias("c"))
    return cut(pairs.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("guess", "c"))).alias(name), F.sum("c").alias(f"{name}_n")))


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, probability for every row of ``pages``.

    log P(lang | page) is, up to a constant, the sum of the text's log likelihood, that of the
    declaration and of the suffix given the language, and the log of the host's prior. Tables
    for the last three are counts, by grouped aggregation over all pages, of what the text
    alone says; a page's own count is left out of its host's. The host's prior is smoothed by
    its domain's and that by all pages'. Null pages, urls and texts give no evidence of their
    kind; repeated rows are pages of their own; without languages ``lang`` is null; an empty
    table gives none; any number of languages is told apart; other columns are ignored.
    """
    names = languages(docs)
    n = len(names)
    rows = read_pages(pages, docs, names)
    none = F.lit(None).cast("string")
    if not n:
        return rows.select("page_id", "host", "suffix", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    every = F.lit(names)
    best = (F.array_position("likelihood", F.array_max("likelihood")) - 1).cast("int")
    said = F.when(F.col("declared").isNull(), n + 1).otherwise(F.coalesce(F.nullif(F.array_position(every, F.col("declared")), F.lit(0)) - 1, F.lit(n))).cast("int")
    rows = rows.withColumn("guess", F.when(F.col("grams") > 0, best)).withColumn("said", said)
    sure = rows.filter("guess is not null")
    whole = np.zeros(n)
    for g, c in sure.groupBy("guess").count().collect():
        whole[g] = c
    top = (whole + 1) / (whole.sum() + n)
    for key, name in (("suffix", "s"), ("domain", "d"), ("host", "h"), ("said", "a")):
        rows = rows.join(_counted(sure, key, name), key, "left")
    each, all_pages = F.lit([float(x) for x in whole]), F.lit([float(x) for x in top])
    mine = F.when(F.col("guess").isNotNull(), 1.0).otherwise(0.0)
    size = lambda c: F.coalesce(f"{c}_n", F.lit(0.0))
    at = lambda c, k: F.coalesce(F.try_element_at(F.col(c), k), F.lit(0.0))

    def score(k: Column) -> Column:
        own = F.when(F.col("guess") == k, 1.0).otherwise(0.0)
        pages_in = F.get(each, k)
        domain = (at("d", k) - own + GLOBAL_WEIGHT * F.get(all_pages, k)) / (size("d") - mine + GLOBAL_WEIGHT)
        host = (at("h", k) - own + DOMAIN_WEIGHT * domain) / (size("h") - mine + DOMAIN_WEIGHT)
        share = size("s") / F.lit(float(max(whole.sum(), 1)))
        suffix = F.when(size("s") > 0, F.ln((at("s", k) - own + SUFFIX_PRIOR * share) / (pages_in + SUFFIX_PRIOR))).otherwise(0.0)
        declared = F.ln((at("a", k) + F.when(F.col("said") == k, DECLARED_PRIOR).otherwise(0.0) + DECLARED_FLOOR) / (pages_in + DECLARED_PRIOR + DECLARED_FLOOR * (n + 2)))
        return F.get("likelihood", k) + F.when(F.col("said") == n + 1, 0.0).otherwise(declared) + suffix + F.ln(host)

    rows = rows.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), score))
    most = F.array_max("scores")
    odds = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - most))
    lang = F.element_at(every, F.array_position("scores", most).cast("int"))
    return rows.select("page_id", "host", "suffix", "declared", F.element_at(every, F.col("guess") + 1).alias("text_lang"), lang.alias("lang"), (1 / odds).alias("probability"))
