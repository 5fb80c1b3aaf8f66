"""Stored tables: reading by parameterised SQL, counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()])


def ask(spark: SparkSession, sql: str, args: list | dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with bound parameters over the named frames."""
    return spark.sql(sql, args=args, **frames)


def ask_one(spark: SparkSession, sql: str, args: list | dict | None = None, **frames: DataFrame):
    """The first row, or None."""
    return ask(spark, sql, args, **frames).first()
