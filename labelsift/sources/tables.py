"""Readers with explicit schemas for labels, side tables and raw metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.operators import rollup
from labelsift.session import settle

LABELS = "file STRING, release INT, vulnerable BOOLEAN"
CODE = "file STRING, release INT, vulnerable BOOLEAN, code STRING"
SILENT = "file STRING, release INT, vulnerable BOOLEAN"
LATENT = "bug_report STRING, file STRING, first_appear INT, last_appear INT, reason STRING"


def raw_metric_schema() -> T.StructType:
    metrics = [*rollup.FILE_FIRST, *rollup.CLASS_SUM, *rollup.CLASS_MEAN, *rollup.FUNCTION_SPREAD]
    return T.StructType([T.StructField("Kind", T.StringType()), T.StructField("File", T.StringType())]
                        + [T.StructField(m, T.DoubleType()) for m in metrics])


def _read(spark: SparkSession, path: str, schema, fmt: str, **options) -> DataFrame:
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
                .options(**options).csv(path))
    return spark.read.schema(schema).format(fmt).load(path)


def read_labels(spark: SparkSession, path: str, release: int | None = None, fmt: str = "parquet") -> DataFrame:
    """``file, release, vulnerable`` as 0/1; the release filter reaches the scan."""
    df = _read(spark, path, LABELS, fmt).withColumn("vulnerable", F.coalesce(F.col("vulnerable"), F.lit(False)).cast("int"))
    return at_release(df, release) if release is not None else df


def read_code(spark: SparkSession, path: str, release: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Labels with source text; CSV values may hold line breaks. Prefer Parquet: a multi-line CSV
    file is read by one task."""
    df = _read(spark, path, CODE, fmt, multiLine=True)
    return at_release(df, release) if release is not None else df


def read_silent(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, SILENT, fmt).withColumn("vulnerable", F.col("vulnerable").cast("int"))


def read_latent(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, LATENT, fmt)


def source_order() -> Column:
    """Where a row stands in its source: file, start of the split it was read in, place in that split. Rows compare by it in the
    order of the files' lines, whatever splits the files are read in and however splits are packed into tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))


def read_raw_metrics(spark: SparkSession, path: str, release: int, order: str = "row_order") -> DataFrame:
    """Raw metric rows of one release; malformed lines are dropped. ``order`` is the source order."""
    df = _read(spark, path, raw_metric_schema(), "csv", mode="DROPMALFORMED", enforceSchema=False, columnPruning=False)
    return rollup.normalise_raw(df.select("*", F.lit(release).alias("release"), source_order().alias(order)))


def at_release(df: DataFrame, release: int) -> DataFrame:
    return df.where(F.col("release") == release)


def align(features: DataFrame, labels: DataFrame, key: tuple[str, ...] = ("file", "release"), check: bool = True) -> DataFrame:
    """Features and labels by key: the columns of ``features``, then the labels' others.

    With ``check`` a label row without features raises ValueError. One join does both: every label row is kept, the joined
    rows are settled while those without features are counted, and what was settled is returned.
    """
    if not check:
        return features.join(labels, list(key))
    joined = labels.join(features.withColumn("_found", F.lit(True)), list(key), "left")
    rows = settle(joined)
    lost = rows.agg(F.count_if(F.col("_found").isNull())).first()[0]
    if lost:
        rows.unpersist()
        raise ValueError(f"{lost} label rows have no features")
    return rows.select(*key, *[c for c in features.columns if c not in key], *[c for c in labels.columns if c not in key])
