"""Tuning of the noisy-label classifier on a validation split."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.operators import evaluate, joint, sampling
from labelsift.plans import crossval
from labelsift.plans.models import positive_score
from labelsift.plans.noisy_labels import NoisyLabelClassifier, NoisyLabelModel
from labelsift.session import in_parallel, settle

# Candidate removals of class 0, and the steps below the class-1 threshold.
BUDGETS = [50, 100, 500, 1000]
THRESHOLD_STEP, THRESHOLD_STEPS = 0.05, range(2, 7)


@dataclass
class TunedLabels:
    model: NoisyLabelModel
    params: dict
    scores: list[tuple[dict, float]] = field(default_factory=list)


def nested_probabilities(classifier, rows: DataFrame, n_folds: int = 4, method: str = "prune_by_noise_rate", flip: bool = False,
                         clean_class: int = 1, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """``id, s, features, fold, psx``: every row scored by a noisy-label classifier that did not see its fold.

    Such a classifier itself needs out-of-sample probabilities of the rows it learns from. With the same folds outside and inside,
    the model that saw neither of two folds scores the one for the learner that leaves out the other, and the other way round. So
    ``n (n - 1) / 2`` models serve all learners, and each learner adds one fit on what it keeps: 10 fits for 4 folds, where
    a cross-validation within each fold of another takes 16.
    """
    spark = rows.sparkSession
    base = classifier.copy({classifier.labelCol: "s"})
    folded = settle(sampling.stratified_folds(rows.select("id", "s", "features"), n_folds, seed=seed))
    pairs = [(i, j) for i in range(n_folds) for j in range(i + 1, n_folds)]
    models = dict(zip(pairs, in_parallel(spark, lambda p: base.fit(folded.where(~F.col("fold").isin(*p))), pairs, parallelism)))

    def scored(model, df: DataFrame) -> DataFrame:
        return model.transform(df).select(*folded.columns, vector_to_array(base.getProbabilityCol()).alias("psx"))

    def learner(out: int) -> DataFrame:
        inside = [scored(models[min(out, j), max(out, j)], folded.where(F.col("fold") == j)) for j in range(n_folds) if j != out]
        probs = reduce(DataFrame.unionByName, inside).drop("fold")
        fitted = NoisyLabelClassifier(classifier, labelCol="s", psxCol="psx", pruneMethod=method, cleanClass=clean_class, flipLabels=flip, seed=seed).fit(probs)
        return scored(fitted, folded.where(F.col("fold") == out))

    return reduce(DataFrame.unionByName, in_parallel(spark, learner, range(n_folds), parallelism))


def tune(classifier, train: DataFrame, val: DataFrame, method: str = "prune_by_noise_rate", flip: bool = False,
         tuning_folds: int = 2, fit_folds: int = 4, seed: int = 42, parallelism: int = 2, nested: bool = False) -> TunedLabels:
    """Best thresholds (or removal budget) by validation AUC, first on ties.

    Probabilities are computed once per fold count and shared by all candidates: the candidates differ
    only in thresholds or budgets. ``train`` and ``val`` have ``id, s, features``. With ``nested`` the thresholds that candidates start
    from are class means of a noisy-label classifier's probabilities (``nested_probabilities`` over ``fit_folds``), not of the
    plain one's.
    """
    base = classifier.copy({classifier.labelCol: "s"})
    psx = settle(crossval.cross_val_probabilities(train, base, fit_folds, seed).drop("fold"))
    val = settle(val)
    if method == "prune_by_class":
        candidates = [{"budget": [float(b), 0.0]} for b in BUDGETS]
    else:
        first = (nested_probabilities(classifier, train, fit_folds, method, flip, seed=seed, parallelism=parallelism) if nested
                 else crossval.cross_val_probabilities(train, base, tuning_folds, seed))
        t = {r["s"]: r["t"] for r in joint.class_thresholds(first).collect()}  # 2 rows
        candidates = [{"thresholds": [t[0], max(0.0, t[1] - THRESHOLD_STEP * i)]} for i in THRESHOLD_STEPS]

    def fit(params: dict) -> NoisyLabelModel:
        return NoisyLabelClassifier(classifier, labelCol="s", psxCol="psx", pruneMethod=method, cleanClass=1,
                                    flipLabels=flip, seed=seed, **params).fit(psx)

    def score(params: dict) -> tuple[float, NoisyLabelModel]:
        model = fit(params)
        scored = positive_score(model.transform(val)).select(F.col("s").alias("label"), "p")
        return float(evaluate.exact_auc(scored).first()["auc"]), model

    tried = in_parallel(train.sparkSession, score, candidates, parallelism)
    best = max(range(len(candidates)), key=lambda i: (tried[i][0], -i))
    return TunedLabels(tried[best][1], candidates[best], [(c, t[0]) for c, t in zip(candidates, tried)])
