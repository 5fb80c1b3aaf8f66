"""Written tables where lineage ends: files that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new
    temporary one only where none is set and all of Spark runs on this machine."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if here:
        return here
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = tempfile.mkdtemp(prefix="timbra-")
    spark.sparkContext.setCheckpointDir(here)
    return here


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The files stay until the folder is
    cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timbra-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
