"""Predictions for rows with several labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.functions.multilabel import to_onehot

# Candidate cuts 0.05, 0.10, .. 0.85.
BOUNDARIES = [0.05 + i * 0.05 for i in range(17)]


def micro_f1_curve(probs: DataFrame, k: int) -> DataFrame:
    """``boundary, tp, fp, fn, f1`` for every candidate cut, in one pass over the rows.

    Each (row, class) cell only notes how many candidates lie below its probability; 17 cumulative
    counts over at most 36 rows give the rest.
    """
    cuts = F.array(*[F.lit(b) for b in BOUNDARIES])
    cells = probs.select(F.explode_outer(F.arrays_zip(F.col("psx").alias("p"), to_onehot("s", k).alias("t"))).alias("c"))
    passed = cells.select(F.col("c.t").alias("t"),
                          F.size(F.filter(cuts, lambda b: F.col("c.p") > b)).alias("passed"))
    hist = passed.groupBy("passed").agg(F.count_if(F.col("t") == 1).alias("pos"), F.count_if(F.col("t") == 0).alias("neg"))
    grid = probs.sparkSession.range(len(BOUNDARIES) + 1, numPartitions=1).select(
        F.col("id").cast("int").alias("passed"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    full = hist.unionByName(grid).groupBy("passed").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = W.partitionBy().orderBy(F.col("passed").desc())
    totals = full.select("passed", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
                         F.sum("pos").over(W.partitionBy()).alias("_p"))
    rows = totals.where("passed > 0").select(
        F.element_at(cuts, F.col("passed")).alias("boundary"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return rows.withColumn("f1", f1)


def best_boundary(probs: DataFrame, k: int) -> Column:
    """First cut with the best micro-F1, as a scalar subquery."""
    best = F.min_by("boundary", F.struct((-F.col("f1")).alias("f"), F.col("boundary").alias("b")))
    return micro_f1_curve(probs, k).agg(best).scalar()


def predicted_onehot(psx: Column | str, cut: Column) -> Column:
    return F.transform(psx, lambda p: (p > cut).cast("tinyint"))


def predicts_exactly(psx: str, labels: str, cut: Column, k: int) -> Column:
    """True when the cut predictions equal the label list."""
    given = to_onehot(labels, k)
    return F.forall(F.zip_with(psx, given, lambda p, t: (p > cut).cast("tinyint") == t), lambda same: same)


def predict(probs: DataFrame, k: int) -> DataFrame:
    """Probability frame plus the ``boundary`` used and ``predicted`` one-hot labels."""
    return (probs.withColumn("boundary", best_boundary(probs, k))
            .withColumn("predicted", predicted_onehot("psx", F.col("boundary"))))
