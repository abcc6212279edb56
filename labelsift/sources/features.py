"""Feature-set tables: Parquet, partitioned by feature kind, release and part."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("sm", "bow", "bert")
PARTS = ("", "_val", "_test")


def write_features(df: DataFrame, path: str, kind: str, part: str = "") -> None:
    """``df`` has ``release``. Only the partitions written are replaced."""
    _check(kind, part)
    (df.withColumn("feature", F.lit(kind)).withColumn("part", F.lit(part or "train"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("feature", "release", "part").parquet(path))


def read_features(spark: SparkSession, path: str, kind: str, release: int, part: str = "",
                  metrics: list[str] | None = None) -> DataFrame:
    """One partition. Metric columns become one vector with nulls and NaN as 0; the key stays."""
    _check(kind, part)
    df = spark.read.parquet(path).where(
        (F.col("feature") == kind) & (F.col("release") == release) & (F.col("part") == (part or "train")))
    df = df.drop("feature", "part")
    if kind != "sm":
        return df
    names = metrics or [f.name for f in df.schema if f.name not in ("file", "release")]
    return assemble(df, names)


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    filled = df.na.fill(0.0, names)  # covers NaN as well
    return VectorAssembler(inputCols=names, outputCol=out).transform(filled).drop(*names)


def stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _check(kind: str, part: str) -> None:
    if kind not in KINDS or part not in PARTS:
        raise ValueError(f"unknown feature set {kind}{part}")
