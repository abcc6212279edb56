"""Result, prediction and model sinks, and the experiment grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.operators import evaluate, relabel

RUN_KEY = ["release", "classifier", "feature_type", "technique"]

# Result columns in order, and the techniques a run may name.
RESULT_COLUMNS = ["release", "classifier", "parameters", "feature_type", "technique", "val_auc", "accuracy",
                  "precision", "recall", "gmean", "auc", "f1", "mcc", "recall_u", "gmean_pu", "val_time",
                  "train_time", "pred_time"]
TECHNIQUES = ["baseline", "manual_cleaning", "pruning", "flipping", "adaptation", "biased", "regularize",
              "propagation1", "propagation2", "oneclass"]
TEXT_COLUMNS = {"classifier", "parameters", "feature_type", "technique"}


def result_schema() -> T.StructType:
    def kind(c):
        return T.IntegerType() if c == "release" else T.StringType() if c in TEXT_COLUMNS else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in RESULT_COLUMNS])


def append_results(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Each run adds its own file; no run rewrites another's."""
    writer = rows.select(*RESULT_COLUMNS).coalesce(1).write.mode("append").format(fmt)  # one row per run
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(result_schema()).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The results at ``path``, None before the first is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return read_results(spark, path)


def write_predictions(df: DataFrame, path: str) -> None:
    """``df`` has the run key, the test rows and ``predicted``. A rerun replaces its own partition.

    Rows are dealt out by run first, so that there are files for the size of a run and not one for every run in every task;
    a run too large for a task is split between several."""
    (df.hint("rebalance", *RUN_KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEY).parquet(path))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Run specifications without a header line."""
    return spark.read.schema("release INT, model STRING, feature STRING, technique STRING").csv(path)


def add_overall_recall(results: DataFrame, predictions: DataFrame, labels: DataFrame, silent: DataFrame,
                       latent: DataFrame) -> DataFrame:
    """Results plus ``recall_o``: recall of the stored predictions against corrected labels, for all
    runs in one job. Predictions have the run key, ``file``, ``test_release`` and ``predicted``."""
    truth = relabel.relabel(labels, silent, latent, value=1).select(
        "file", F.col("release").alias("test_release"), F.col("vulnerable").alias("truth"))
    scored = predictions.join(truth, ["file", "test_release"])
    recall = evaluate.recall_on(scored, "truth", by=RUN_KEY, name="recall_o")
    return results.join(recall, RUN_KEY, "left")


def write_overall_recall(spark: SparkSession, path: str, predictions_path: str, labels: DataFrame, silent: DataFrame,
                         latent: DataFrame, to: str) -> DataFrame:
    """A new version, at ``to``, of the results table at ``path`` that has ``recall_o`` as well; the old version stays. Runs without
    stored predictions have no figure."""
    out = add_overall_recall(read_results(spark, path), spark.read.parquet(predictions_path), labels, silent, latent)
    out.select(*RESULT_COLUMNS, "recall_o").write.mode("errorifexists").parquet(to)
    return spark.read.schema(f"{_ddl()}, recall_o DOUBLE").parquet(to)


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in result_schema())
