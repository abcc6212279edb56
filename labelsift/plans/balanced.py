"""Class weights that belong to the fit, and forests of balanced bags."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.ordering import hash_key
from labelsift.session import in_parallel

WEIGHT = "_fit_weight"


def class_weight(df: DataFrame, label: str, how: str) -> Column:
    """Weight of a row from the class counts of ``df``: ``balanced`` (N / (2 n_k)), ``ratio`` (positives n0 / n1) or ``none``."""
    if how == "none":
        return F.lit(1.0)
    n, n1 = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    n0 = n - n1
    if not n0 or not n1:
        return F.lit(1.0)
    positive, other = (n / (2.0 * n1), n / (2.0 * n0)) if how == "balanced" else (n0 / n1, 1.0)
    return F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(other))


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol):
    """Columns of a classifier; a weight column that is set multiplies the class weights."""

    def own_weight(self) -> Column:
        return F.col(self.getWeightCol()) if self.isSet(self.weightCol) else F.lit(1.0)


class ClassWeighted(Estimator, _Columns):
    """A classifier whose class weights are those of the labels and rows it is fitted on.

    Weights therefore follow every flip, prune, fold, bag or propagation, and noise weights given in ``weightCol``
    apply on top. The fitted model is the wrapped classifier's.
    """

    def __init__(self, classifier, how: str = "balanced", label: str = "s", features: str = "features"):
        super().__init__()
        self.classifier, self.how = classifier, how
        self._setDefault(labelCol=label, featuresCol=features, predictionCol="prediction", probabilityCol="probability")

    def _fit(self, df: DataFrame) -> Model:
        c = self.classifier
        weighted = df.withColumn(WEIGHT, class_weight(df, self.getLabelCol(), self.how) * self.own_weight())
        return c.copy({c.labelCol: self.getLabelCol(), c.featuresCol: self.getFeaturesCol(), c.predictionCol: self.getPredictionCol(),
                       c.probabilityCol: self.getProbabilityCol(), c.weightCol: WEIGHT}).fit(weighted)


def bag_of(label: str, small: int, bag: int, n_bags: int, key: Column) -> Column:
    """Whether a row is in a bag: all rows of the small class, and of the other class those whose order ``key`` falls to it. Each row
    of the larger class is in exactly one bag, so all bags together use every row."""
    return (F.col(label) == small) | (F.pmod(key, F.lit(n_bags)) == bag)


class BalancedForest(Estimator, _Columns):
    """A forest whose trees see balanced bags: forests of a few trees each, one per bag, averaged.

    As many bags as the larger class is times the smaller one, at most one per tree; what imbalance is left in a bag is
    weighed out. ``forest`` has the total number of trees. Rows need ``id``.
    """

    def __init__(self, forest: RandomForestClassifier, seed: int = 42, label: str = "s", features: str = "features", parallelism: int = 2):
        super().__init__()
        self.forest, self.seed, self.parallelism = forest, seed, parallelism
        self._setDefault(labelCol=label, featuresCol=features, predictionCol="prediction", probabilityCol="probability")

    def plan(self, df: DataFrame) -> tuple[int, int]:
        """The small class and the number of bags."""
        n, n1 = df.agg(F.count(F.lit(1)), F.count_if(F.col(self.getLabelCol()) == 1)).first()
        small, low = (1, n1) if 2 * n1 <= n else (0, n - n1)
        return small, max(1, min(self.forest.getNumTrees(), round((n - low) / low))) if low else 1

    def _fit(self, df: DataFrame) -> "BalancedForestModel":
        small, n_bags = self.plan(df)
        trees = -(-self.forest.getNumTrees() // n_bags)
        f = self.forest
        f = f.copy({f.labelCol: self.getLabelCol(), f.featuresCol: self.getFeaturesCol(), f.weightCol: WEIGHT, f.numTrees: trees})
        weighed = df.withColumn("_own", self.own_weight())

        def one(bag: int):
            rows = weighed.where(bag_of(self.getLabelCol(), small, bag, n_bags, hash_key(self.seed, "id")))
            rows = rows.withColumn(WEIGHT, class_weight(rows, self.getLabelCol(), "balanced") * F.col("_own"))
            return f.copy({f.seed: self.seed + bag}).fit(rows)

        models = in_parallel(df.sparkSession, one, range(n_bags), self.parallelism)
        return BalancedForestModel(models, self.getFeaturesCol(), self.getProbabilityCol(), self.getPredictionCol())


def mean_probability(df: DataFrame, models: list, features: str) -> tuple[DataFrame, list[Column], list[str]]:
    """The rows scored by all models in one pass, the mean probability of each class, and columns to drop."""
    out, added = df, []
    for i, m in enumerate(models):
        m = m.copy({m.featuresCol: features, m.probabilityCol: f"_prob{i}", m.rawPredictionCol: f"_raw{i}", m.predictionCol: f"_pred{i}"})
        out = m.transform(out)
        added += [f"_prob{i}", f"_raw{i}", f"_pred{i}"]
    of = lambda i, k: F.coalesce(F.get(vector_to_array(f"_prob{i}"), F.lit(k)), F.lit(0.0))
    return out, [sum((of(i, k) for i in range(1, len(models))), of(0, k)) / len(models) for k in range(2)], added


class BalancedForestModel(Model, _Columns):
    """Mean of the bags' forests."""

    def __init__(self, models: list[RandomForestClassificationModel], features: str = "features", probability: str = "probability", prediction: str = "prediction"):
        super().__init__()
        self.models = models
        self._setDefault(featuresCol=features, probabilityCol=probability, predictionCol=prediction)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out, p, added = mean_probability(df, self.models, self.getFeaturesCol())
        out = out.withColumn(self.getProbabilityCol(), array_to_vector(F.array(*p)))
        return out.withColumn(self.getPredictionCol(), (F.get(vector_to_array(self.getProbabilityCol()), F.lit(1)) > 0.5).cast("double")).drop(*added)
