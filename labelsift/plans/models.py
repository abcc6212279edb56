"""Base classifiers and their seeded parameter search."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.operators import evaluate, joint
from labelsift.plans.balanced import BalancedForest, ClassWeighted
from labelsift.session import in_parallel, released, settle

# Search ranges.
RANGES = {"max_depth": (2, 15), "max_leaf_nodes": (2, 500), "n_estimators": (50, 500), "max_features": (0.01, 0.7)}
KINDS = ("rf", "brf", "xgb", "lr")


def with_class_weights(df: DataFrame, label: str = "s", out: str = "weight") -> DataFrame:
    """N / (2 n_k) per row."""
    n1 = F.avg((F.col(label) == 1).cast("double"))
    return df.withColumn("_p1", df.agg(n1).scalar()).withColumn(
        out, F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), F.col("_p1"))).otherwise(
            F.try_divide(F.lit(0.5), F.lit(1.0) - F.col("_p1")))).drop("_p1")


def with_ratio_weights(df: DataFrame, label: str = "s", out: str = "weight") -> DataFrame:
    """Positives weigh n0/n1."""
    ratio = joint.imbalance_ratio(joint.class_counts(df, 2, label)).select("ratio").scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def make_classifier(kind: str, params: dict, seed: int = 42, features: str = "features", label: str = "s", n_rows: int | None = None):
    """A Spark classifier for a parameter set. Its class weights, and for 'brf' its balanced bags, are made in each fit.

    Spark trees have no leaf-count limit; a limit of L leaves becomes at least rows/(4 L) rows per leaf.
    """
    common = {"featuresCol": features, "labelCol": label, "seed": seed}
    depth = int(params.get("max_depth", 5))
    min_rows = max(1, int((n_rows or 0) / (4 * params["max_leaf_nodes"]))) if "max_leaf_nodes" in params else 1
    share = params.get("max_features", 0.3)
    if kind in ("rf", "brf"):
        forest = RandomForestClassifier(maxDepth=depth, numTrees=int(params.get("n_estimators", 50)), minInstancesPerNode=min_rows,
                                        featureSubsetStrategy=str(float(share)), **common)
        if kind == "brf":
            return BalancedForest(forest, seed, label, features)
        return ClassWeighted(forest, "balanced", label, features)
    if kind == "xgb":
        return ClassWeighted(GBTClassifier(maxDepth=depth, maxIter=int(params.get("n_estimators", 50)), featureSubsetStrategy=str(float(share)),
                                           **common), "ratio", label, features)
    if kind == "lr":
        return ClassWeighted(LogisticRegression(featuresCol=features, labelCol=label), "balanced", label, features)
    raise ValueError(f"unknown model {kind}; one of {KINDS}")


def positive_score(df: DataFrame, column: str = "probability", out: str = "p") -> DataFrame:
    return df.withColumn(out, F.element_at(vector_to_array(column), 2))


def random_grid(n: int, seed: int = 42, ranges=RANGES) -> list[dict]:
    """Seeded parameter sets, integers where the range is whole."""
    rng = random.Random(seed)
    return [{p: rng.uniform(*r) if isinstance(r[0], float) else rng.randint(*r) for p, r in ranges.items()} for _ in range(n)]


@dataclass
class Tuned:
    params: dict
    score: float
    trials: DataFrame


def search(kind: str, train: DataFrame, val: DataFrame, grid: list[dict], objective: str = "auc", seed: int = 42,
           parallelism: int = 2) -> Tuned:
    """Fit every parameter set on the training rows, score on the validation rows, keep the first best.

    Objectives: ``auc``, or ``recall`` (rows times squared recall over actual positives). Trials run as
    Spark jobs, a few at a time.
    """
    train, val = settle(train), settle(val)
    n_rows = train.count()

    def trial(params: dict) -> float:
        with released():
            model = make_classifier(kind, params, seed, n_rows=n_rows).fit(train)
            scored = positive_score(model.transform(val)).select(F.col("s").alias("label"), "p", F.col("prediction").alias("predicted"))
            if objective == "auc":
                return float(evaluate.exact_auc(scored).first()["auc"])
            return float(evaluate.binary_metrics(scored, places=None).first()["recall_score"] or 0.0)

    scores = in_parallel(train.sparkSession, trial, grid, parallelism)
    best = max(range(len(grid)), key=lambda i: (scores[i], -i))
    trials = train.sparkSession.createDataFrame([(i, str(g), s) for i, (g, s) in enumerate(zip(grid, scores))],
                                                "trial int, params string, score double")
    return Tuned(grid[best], scores[best], trials)
