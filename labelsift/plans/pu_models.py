"""Positive-unlabelled estimators over any Spark classifier.

Training frames have ``id, s`` (1 = positive, 0 = unlabelled) and ``features`` (vector).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.operators import evaluate, pu, rank, sampling
from labelsift.plans.balanced import mean_probability
from labelsift.plans.models import positive_score
from labelsift.session import in_parallel, settle, ship_package


class ElkanNoto:
    """p(y=1|x) = p(s=1|x) / c with c the mean score of held-out positives."""

    def __init__(self, classifier, hold_out: float = 0.2, seed: int = 0, key: Column | None = None):
        self.classifier, self.hold_out, self.seed, self.key = classifier, hold_out, seed, key
        self.model, self.c = None, None

    def fit(self, df: DataFrame) -> "ElkanNoto":
        split = settle(sampling.hold_out_positives(df, self.hold_out, seed=self.seed, key=self.key))
        self.model = self.classifier.fit(split.where(~F.col("held_out")))
        held = positive_score(self.model.transform(split.where("held_out")))
        self.c = held.agg(F.avg("p")).first()[0]
        if not self.c:
            raise ValueError("no held-out positives to estimate the label frequency from")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return positive_score(self.model.transform(df)).withColumn("p", F.col("p") / F.lit(float(self.c)))


class BaggingPU:
    """Mean score of models trained on all positives and one share of the unlabelled rows each."""

    def __init__(self, classifier, n_bags: int = 15, seed: int = 42, parallelism: int = 2, key: Column | None = None):
        self.classifier, self.n_bags, self.seed, self.parallelism, self.key = classifier, n_bags, seed, parallelism, key
        self.models: list = []

    def fit(self, df: DataFrame) -> "BaggingPU":
        df = settle(df)
        bag = lambda b: self.classifier.fit(sampling.bag(df, b, self.n_bags, seed=self.seed, key=self.key))
        self.models = in_parallel(df.sparkSession, bag, range(self.n_bags), self.parallelism)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """All models score in one pass over the rows."""
        out, p, added = mean_probability(df, self.models, self.classifier.getFeaturesCol() if self.classifier else "features")
        return out.withColumn("p", p[1]).drop(*added)


class TwoStagePU:
    """Reliable negatives by centroid distance, the weight of the positive distance picked on
    validation AUC, then a fit on what is reliable.

    ``compat_subset``: refine the rows left by the last candidate instead of all rows.
    """

    def __init__(self, classifier, metric: str = "cosine", alphas=pu.ALPHAS, compat_subset: bool = False, parallelism: int = 2):
        self.classifier, self.metric, self.alphas = classifier, metric, list(alphas)
        self.compat_subset, self.parallelism = compat_subset, parallelism
        self.model, self.alpha, self.scores = None, None, None

    def distances(self, df: DataFrame) -> DataFrame:
        x = df.withColumn("_x", vector_to_array("features"))
        return pu.with_centroid_distances(x, self.metric, x="_x").drop("_x")

    def fit(self, df: DataFrame, val: DataFrame) -> "TwoStagePU":
        near = settle(self.distances(df))
        val = settle(val)

        def score(alpha: float) -> float:
            model = self.classifier.fit(pu.reliable_rows(near, alpha))
            scored = positive_score(model.transform(val)).select(F.col("s").alias("label"), "p")
            return float(evaluate.exact_auc(scored).first()["auc"])

        self.scores = in_parallel(df.sparkSession, score, self.alphas, self.parallelism)
        self.alpha = self.alphas[max(range(len(self.alphas)), key=lambda i: (self.scores[i], -i))]
        kept = near
        if self.compat_subset:
            last = pu.reliable_rows(near, self.alphas[-1]).drop("d")
            kept = settle(self.distances(last))
        self.model = self.classifier.fit(pu.reliable_rows(kept, self.alpha))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return positive_score(self.model.transform(df))


class LabelPropagation:
    """Rows the two-stage model scores at or above the threshold become positive; refit on all rows. Class weights
    belong to the classifier's fit (``plans.balanced``) and follow the new labels."""

    def __init__(self, classifier, metric: str = "cosine", threshold: float = 0.5, **two_stage):
        self.classifier, self.threshold = classifier, threshold
        self.first = TwoStagePU(classifier, metric, **two_stage)
        self.model = None

    def fit(self, df: DataFrame, val: DataFrame) -> "LabelPropagation":
        self.first.fit(df, val)
        spread = self.first.transform(df).withColumn("s", F.when(F.col("p") >= self.threshold, 1).otherwise(F.col("s")))
        self.model = self.classifier.fit(spread.select(*df.columns))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return positive_score(self.model.transform(df))


def lower_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact: for each share the value of the row with rank ``ceil(share * N)``, the first at least."""
    values = settle(df.select(F.lit(0).alias("g"), (-F.col(column)).alias("v")))
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        raise ValueError("no rows to take quantiles of")
    wanted = [{"g": 0, "i": i, "m": min(n, max(1, math.ceil(round(q * n, 9))))} for i, q in enumerate(shares)]
    cuts = {c["i"]: -c["cut"] for c in rank.nth_largest(values, ["g", "i"], "v", wanted, (lo, hi + 1e-9), on=["g"])}
    return [cuts[i] for i in range(len(shares))]


class OneClass:
    """Density score learnt from positives only: random Fourier features approximate a Gaussian kernel
    mean map, the score of a row is its similarity to that mean, and the cut is the ``nu`` quantile of
    the training scores. ``predicted`` is 1 inside the boundary.
    """

    def __init__(self, nu: float = 0.1, width: int = 256, gamma: float | None = None, seed: int = 42):
        self.nu, self.width, self.gamma, self.seed = nu, width, gamma, seed
        self.mean, self.cut = None, None
        self.directions, self.phases = None, None

    def _features(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        directions, phases, scale = self.directions, self.phases, np.sqrt(2.0 / self.width)

        @F.pandas_udf("array<double>")
        def mapped(x):
            import pandas as pd

            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ directions + phases)))

        return df.withColumn("_z", mapped(vector_to_array("features")))

    def fit_map(self, df: DataFrame) -> "OneClass":
        """The projection and the mean map; independent of ``nu``."""
        stats = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col("features")).alias("m")).select("m.*").first()
        mean, d = stats["mean"].toArray(), len(stats["mean"])
        # over all entries, so spread between features counts
        var = float((stats["normL2"].toArray() ** 2).sum() / (stats["count"] * d) - mean.mean() ** 2)
        gamma = self.gamma or 1.0 / (d * var if var > 0 else 1.0)
        rng = np.random.default_rng(self.seed)
        self.directions = rng.normal(scale=np.sqrt(2.0 * gamma), size=(d, self.width))
        self.phases = rng.uniform(0.0, 2.0 * np.pi, self.width)
        mean = self._features(df).select(Summarizer.mean(array_to_vector("_z")).alias("m")).first()["m"]
        self.mean = mean.toArray()
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """Frame plus ``density``."""
        ship_package(df.sparkSession)
        directions, phases, mean, scale = self.directions, self.phases, self.mean, np.sqrt(2.0 / self.width)

        @F.pandas_udf("double")
        def density(x):
            import pandas as pd

            return pd.Series(scale * np.cos(np.stack(x.to_numpy()) @ directions + phases) @ mean)

        return df.withColumn("density", density(vector_to_array("features")))

    def set_cut(self, scored: DataFrame) -> "OneClass":
        self.cut = lower_quantiles(scored, "density", [self.nu])[0]
        return self

    def fit(self, positives: DataFrame) -> "OneClass":
        self.fit_map(positives)
        return self.set_cut(self.score(positives))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("predicted", (F.col("density") >= self.cut).cast("int"))


def tune_one_class(positives: DataFrame, val: DataFrame, nus: list[float], **kwargs) -> tuple[OneClass, float]:
    """Sweep ``nu`` on the validation MCC; the density is computed once, and all candidates are judged
    in one aggregation."""
    model = OneClass(**kwargs).fit_map(positives)
    cuts = lower_quantiles(model.score(positives), "density", nus)
    scored = model.score(val).select("s", "density")
    tried = scored.select(F.col("s").alias("label"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("trial"), (F.col("density") >= c).cast("int").alias("predicted")) for i, c in enumerate(cuts)])).alias("t"))
    m = evaluate.binary_metrics(tried.select("label", "t.*"), by=["trial"], places=None).withColumn("score", F.col("mcc"))
    best = evaluate.best_trial(m).first()
    model.nu, model.cut = nus[best["trial"]], cuts[best["trial"]]
    return model, float(best["score"])


