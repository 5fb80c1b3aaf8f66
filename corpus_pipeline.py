"""A corpus pipeline of five operators: what each stage keeps is all that the next one sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbra.llm.bpe import encoded
from timbra.llm.common import cut
from timbra.llm.linededup import deduped
from timbra.llm.mixing import mixed
from timbra.llm.quality import quality_filter
from timbra.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; every document stays."""
    return deduped(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, as digests, with the digest of what they decode to."""
    return encoded(docs, digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", bpe_encode),
]

#: The forest, the seeded sampling and the encoding have no SQL form; tests hold the
#: pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else cut(docs)
    return docs
