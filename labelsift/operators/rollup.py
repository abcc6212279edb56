"""Metric features per labelled file from raw code-metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.functions.text import file_path, file_stem

# Metric names of the raw tables, by the way they are rolled up.
FILE_FIRST = [
    "AvgCyclomatic", "AvgCyclomaticModified", "AvgCyclomaticStrict", "AvgEssential", "AvgLine", "AvgLineBlank",
    "AvgLineCode", "AvgLineComment", "CountDeclClass", "CountDeclFunction", "CountLine", "CountLineBlank",
    "CountLineCode", "CountLineCodeDecl", "CountLineCodeExe", "CountLineComment", "CountSemicolon", "CountStmt",
    "CountStmtDecl", "CountStmtExe", "MaxCyclomatic", "MaxCyclomaticModified", "MaxCyclomaticStrict",
    "RatioCommentToCode", "SumCyclomatic", "SumCyclomaticModified", "SumCyclomaticStrict", "SumEssential",
]
CLASS_SUM = [
    "CountClassBase", "CountClassCoupled", "CountClassDerived", "CountDeclClassMethod", "CountDeclClassVariable",
    "CountDeclInstanceMethod", "CountDeclInstanceVariable", "CountDeclMethod", "CountDeclMethodPrivate",
    "CountDeclMethodProtected", "CountDeclMethodPublic",
]
CLASS_MEAN = ["MaxInheritanceTree", "PercentLackOfCohesion"]
FUNCTION_SPREAD = ["CountInput", "CountOutput", "CountPath", "MaxNesting"]


def metric_columns(file_first=FILE_FIRST, class_sum=CLASS_SUM, class_mean=CLASS_MEAN,
                   function_spread=FUNCTION_SPREAD) -> list[str]:
    """Feature columns in order."""
    spread = [f"{m}_{how}" for how in ("Min", "Mean", "Max") for m in function_spread]
    return [*file_first, *class_sum, *class_mean, *spread]


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Path with forward slashes as ``file``, plus ``stem``."""
    return raw.withColumn("file", file_path("File")).withColumn("stem", file_stem("file"))


def roll_up(labels: DataFrame, raw: DataFrame, order: str, file_first=FILE_FIRST, class_sum=CLASS_SUM,
            class_mean=CLASS_MEAN, function_spread=FUNCTION_SPREAD, by: tuple[str, ...] = ("release",),
            label_stem: str | None = None) -> DataFrame:
    """One feature row per label row; what a file lacks is 0.

    ``raw`` has ``Kind, file, stem`` (see ``normalise_raw``), the metrics, the ``by`` columns (all
    releases go in one job) and ``order``, the source order deciding which file row comes first. Both
    aggregations happen before the joins, so a file with very many functions is reduced map-side and
    no join multiplies rows.
    """
    kind = F.col("Kind")
    by = list(by)
    is_file, is_class, is_function = kind == "File", kind.contains("Class"), kind.contains("Function")

    def only(cond, m):
        return F.when(cond, F.col(m).cast("double"))

    # One place and one row of metrics for all of them: a place for each metric would be most of what is shuffled.
    first = F.struct(*[F.col(m).cast("double").alias(m) for m in file_first])
    per_file = [F.min_by(first, F.when(is_file, F.col(order))).alias("_first")] if file_first else []
    for how, agg in (("Min", F.min), ("Mean", F.avg), ("Max", F.max)):
        per_file += [agg(only(is_function, m)).alias(f"{m}_{how}") for m in function_spread]
    files = raw.where(is_file | is_function).groupBy(*by, "file").agg(*per_file)
    files = files.select("*", *[F.col("_first")[m].alias(m) for m in file_first]).drop("_first")
    classes = raw.where(is_class).groupBy(*by, "stem").agg(
        *[F.sum(F.col(m).cast("double")).alias(m) for m in class_sum],
        *[F.avg(F.col(m).cast("double")).alias(m) for m in class_mean])
    stem = F.col(label_stem) if label_stem else file_stem("file")
    out = (labels.withColumn("stem", stem)
           .join(classes, [*by, "stem"], "left").join(files, [*by, "file"], "left"))  # the narrower table is dealt out again
    features = metric_columns(file_first, class_sum, class_mean, function_spread)
    zero_nan = [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features]
    return out.select(*labels.columns, *zero_nan)
