"""Prediction quality: binary metrics, positive-unlabelled scores, ROC, threshold choice, exact AUC.

Inputs are frames with a 0/1 label, a 0/1 ``predicted`` and, where needed, a score ``p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.operators import rank


def share(num: Column, den: Column) -> Column:
    """num / den, 0 when nothing is there to divide by."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def outcome_counts(label: str = "label", predicted: str = "predicted") -> list[Column]:
    t, p = F.col(label) == 1, F.col(predicted) == 1
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
            F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def metric_columns() -> dict[str, Column]:
    """Scalar formulas over ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": share(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "mcc": share(tp * tn - fp * fn, mcc_den),
        # Root of precision times recall.
        "gmean": F.sqrt(precision * recall),
        # Rows times squared recall, over predicted positives.
        "gmean_pu": F.try_divide(n * recall * recall, tp + fp),
        # Same numerator, over actual positives: the tuning score.
        "recall_score": F.try_divide(n * recall * recall, tp + fn),
    }


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted", by: list[str] = (),
                   places: int | None = 3) -> DataFrame:
    """All metrics in one aggregation (one row, or one per ``by`` group)."""
    sums = df.groupBy(*by).agg(*outcome_counts(label, predicted))
    cols = [(F.round(c, places) if places is not None else c).alias(n) for n, c in metric_columns().items()]
    return sums.select(*by, "tp", "fp", "fn", "tn", *cols)


def recall_on(df: DataFrame, truth: str, predicted: str = "predicted", by: list[str] = (),
              name: str = "recall_u") -> DataFrame:
    """Recall against another truth column, e.g. hidden positives or corrected labels."""
    t = F.col(truth).cast("boolean")
    return df.groupBy(*by).agg(share(F.count_if(t & (F.col(predicted) == 1)), F.count_if(t)).alias(name))


def pu_f1_estimate(df: DataFrame, label: str = "s", prob: str = "p") -> DataFrame:
    """Recall squared over twice the share of predicted positives, cut at 0.5; NaN without any, recall 0 without positives."""
    pred = F.col(prob) >= 0.5
    recall = share(F.count_if(pred & (F.col(label) == 1)), F.count_if(F.col(label) == 1))
    positive = share(F.count_if(pred), F.count(F.lit(1)))
    return df.agg(F.when(positive == 0, F.lit(float("nan"))).otherwise(
        F.try_divide(recall * recall, 2.0 * positive)).alias("pu_f1"))


def transductive_scores(df: DataFrame, by: list[str], places: int | None = 3) -> DataFrame:
    """Scores inside a training set: ``vulnerable`` in 0/1/2 (2 = hidden positive, 1 left out) and
    ``reliable``; a row is flagged when it is not reliable."""
    hidden, flagged = F.col("vulnerable") == 2, ~F.col("reliable")
    sums = df.where("vulnerable <> 1").groupBy(*by).agg(
        F.count_if(flagged & hidden).alias("tp"), F.count_if(flagged & ~hidden).alias("fp"),
        F.count_if(~flagged & hidden).alias("fn"), F.count(F.lit(1)).alias("n"), F.count_if(hidden).alias("pos"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    cols = {"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": recall,
            "gmean_pu": F.try_divide(F.col("n") * recall * recall, F.col("pos").cast("double"))}
    return sums.select(*by, *[(F.round(c, places) if places is not None else c).alias(n) for n, c in cols.items()])


def roc_points(df: DataFrame, label: str = "label", score: str = "p", ranges: int | None = None) -> DataFrame:
    """``score, tp, fp, tpr, fpr`` per distinct score: rates when predicting positive at or above it."""
    is_pos = (F.col(label) == 1).cast("bigint")
    cum = rank.running_totals(df.where(F.col(score).isNotNull()), score, {"pos": is_pos, "neg": 1 - is_pos},
                              descending=True, ranges=ranges)
    totals = cum.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.struct("p", "n").alias("t"))
    cum = cum.withColumn("_t", totals.scalar())
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return cum.select(F.col(score).alias("score"), tp.alias("tp"), fp.alias("fp"),
                      F.try_divide(tp.cast("double"), F.col("_t.p").cast("double")).alias("tpr"),
                      F.try_divide(fp.cast("double"), F.col("_t.n").cast("double")).alias("fpr"))


def youden_threshold(roc: DataFrame, places: int | None = None) -> DataFrame:
    """``threshold, j``: the score with the largest tpr - fpr, the highest on ties. Without any
    positive difference the curve's start wins: nothing is predicted (threshold max + 1)."""
    j = F.col("tpr") - F.col("fpr")
    if places is not None:
        j = F.round(j, places)
    best = roc.withColumn("j", j).agg(
        F.max_by(F.struct("score", "j"), F.struct("j", "score")).alias("b"), F.max("score").alias("top"))
    wins = F.col("b.j") > 0
    return best.select(F.when(wins, F.col("b.score")).otherwise(F.col("top") + 1).alias("threshold"),
                       F.when(wins, F.col("b.j")).otherwise(F.lit(0.0)).alias("j"))


def exact_auc(df: DataFrame, label: str = "label", score: str = "p", ranges: int | None = None) -> DataFrame:
    """``auc``: chance that a positive outranks a negative, ties half; 0 when one class is missing."""
    is_pos = (F.col(label) == 1).cast("bigint")
    cum = rank.running_totals(df.where(F.col(score).isNotNull()), score, {"pos": is_pos, "neg": 1 - is_pos},
                              descending=False, ranges=ranges)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return cum.agg(share(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def best_trial(trials: DataFrame, score: str = "score", trial: str = "trial") -> DataFrame:
    """The trial with the best score, the first on ties."""
    return trials.orderBy(F.col(score).desc(), F.col(trial).asc()).limit(1)


def precision_at_k(probs: DataFrame, k: int, name: str = "precision") -> DataFrame:
    from labelsift.functions.probability import in_top_k

    return probs.agg(F.avg(in_top_k("psx", "s", k).cast("double")).alias(name))


def weighted_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
                      weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg(share(F.sum(F.when(F.col(label) == F.col(prediction), w).otherwise(0.0)), F.sum(w)).alias("accuracy"))
