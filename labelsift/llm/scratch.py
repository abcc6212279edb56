"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labelsift.session import ensure_checkpoint_dir


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or what a local session without one was given."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def write(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and return the written table, so that a lost executor costs a read only."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/labelsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``write`` returned; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(conf).delete(path, True)
