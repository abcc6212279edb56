"""The noisy-label classifier: estimate noise, find errors, prune or flip, weight, refit."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.operators import evaluate, frames, joint, latent, prune, validate
from labelsift.plans import crossval
from labelsift.session import settle


def require_classifier(estimator) -> None:
    """Any Spark ML estimator with probability and label columns will do."""
    for needed in ("fit", "getProbabilityCol", "getLabelCol", "getFeaturesCol"):
        if not hasattr(estimator, needed):
            raise TypeError(f"the classifier must have {needed}()")


def takes_weights(estimator) -> bool:
    return estimator.hasParam("weightCol")


class NoisyLabelClassifier(Estimator, HasFeaturesCol, HasLabelCol):
    """Wraps a classifier so that it learns from labels with errors.

    ``fit`` expects an ``id`` column for deterministic folds. Out-of-sample probabilities may be given
    in ``psxCol``; else they come from cross-validation of the wrapped classifier. Weights in the
    classifier's ``weightCol`` are carried along and multiplied with the noise weights.
    """

    numFolds = Param(Params._dummy(), "numFolds", "cross-validation folds", TypeConverters.toInt)
    pruneMethod = Param(Params._dummy(), "pruneMethod", "how rows are flagged", TypeConverters.toString)
    converge = Param(Params._dummy(), "converge", "make the latent estimates consistent", TypeConverters.toBoolean)
    cleanClass = Param(Params._dummy(), "cleanClass", "class without label errors, -1 for none", TypeConverters.toInt)
    flipLabels = Param(Params._dummy(), "flipLabels", "flip flagged labels of two classes instead of pruning", TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "seed of the fold assignment", TypeConverters.toInt)
    psxCol = Param(Params._dummy(), "psxCol", "column with given probabilities, empty for none", TypeConverters.toString)
    # Weights in flip mode: the published procedure leaves them at 1.
    unitFlipWeights = Param(Params._dummy(), "unitFlipWeights", "keep all weights at 1 when flipping", TypeConverters.toBoolean)

    def __init__(self, classifier=None, thresholds=None, budget=None, noise_matrix: DataFrame | None = None,
                 inverse_noise_matrix: DataFrame | None = None, keep: str = "persist", **params):
        super().__init__()
        self.classifier = classifier if classifier is not None else LogisticRegression()
        require_classifier(self.classifier)
        self.thresholds, self.budget, self.keep = thresholds, budget, keep
        self.noise_matrix, self.inverse_noise_matrix = noise_matrix, inverse_noise_matrix
        self._setDefault(numFolds=4, pruneMethod="prune_by_noise_rate", converge=False, cleanClass=-1, flipLabels=False,
                         seed=0, psxCol="", unitFlipWeights=False, featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in params.items() if v is not None})

    def _fit(self, df: DataFrame) -> "NoisyLabelModel":
        get = self.getOrDefault
        label, features, psx = self.getLabelCol(), self.getFeaturesCol(), get("psxCol")
        base = self.classifier.copy({self.classifier.labelCol: "s", self.classifier.featuresCol: features})
        given = base.getWeightCol() if takes_weights(base) and base.isSet(base.weightCol) else None
        rows = df.select("id", F.col(label).cast("int").alias("s"), F.col(features), *([F.col(psx).alias("psx")] if psx else []),
                         *([F.col(given).alias("_given")] if given else []))
        if given:
            base = base.copy({base.weightCol: "_given"})
        if not psx:
            rows = crossval.cross_val_probabilities(rows, base, get("numFolds"), get("seed"), keep=self.keep).drop("fold")
        probs = settle(rows, self.keep)
        k = frames.num_classes(probs)
        validate.check_probs(probs, k)
        ps = joint.prior(joint.class_counts(probs, k))
        cj = settle(joint.confident_joint(probs, k, self.thresholds), self.keep)
        nm, inv, py = self._noise(cj, ps)
        clean = get("cleanClass")
        if k == 2 and clean >= 0:
            nm, inv, cj = (latent.pu_constrain(m, clean, kind) for m, kind in ((nm, "nm"), (inv, "inv"), (cj, "joint")))
        errors = prune.find_label_errors(probs, k, cj, get("pruneMethod"), budget=self.budget, keep="none")
        errors = settle(errors, self.keep)
        flip = get("flipLabels") and k == 2
        train = prune.flip_labels(errors, k) if flip else prune.prune_rows(errors)
        if takes_weights(base):
            unit = flip and get("unitFlipWeights")
            w = F.lit(1.0) if unit else F.element_at("_w", F.col("s") + 1)
            train = train.withColumn("_w", latent.sample_weights(nm, k)).withColumn(
                "_weight", w * F.col("_given") if given else w).drop("_w")
            base = base.copy({base.weightCol: "_weight"})
        fitted = base.fit(train)
        return NoisyLabelModel(fitted, errors=errors.select("id", "s", "is_error"), joint=cj, noise_matrix=nm,
                               inverse_noise_matrix=inv, prior=py, label_col=label)

    def _noise(self, cj: DataFrame, ps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        nm, inv = self.noise_matrix, self.inverse_noise_matrix
        if nm is not None:
            validate.check_trace(nm, "noise_matrix")
        if inv is not None:
            validate.check_trace(inv, "inverse_noise_matrix")
        if nm is None and inv is None:
            py, nm, inv = latent.estimate_latent(cj, ps, converge=self.getOrDefault("converge"))
            return nm, inv, py
        if inv is None:
            py, inv = latent.prior_and_inverse(ps, nm)
        else:
            nm = nm if nm is not None else latent.noise_from_inverse(ps, inv)
            py = latent.latent_prior(ps, nm, inv, "marginal_ps")
        return nm, inv, py


class NoisyLabelModel(Model):
    """Fitted classifier plus what was learnt about the labels, as frames."""

    def __init__(self, model, errors, joint, noise_matrix, inverse_noise_matrix, prior, label_col="label"):
        super().__init__()
        self.model, self.errors, self.joint = model, errors, joint
        self.noise_matrix, self.inverse_noise_matrix, self.prior = noise_matrix, inverse_noise_matrix, prior
        self.label_col = label_col

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def score(self, df: DataFrame, weight: str | None = None) -> float:
        """Accuracy, optionally weighted."""
        scored = self.transform(df)
        return evaluate.weighted_accuracy(scored, self.label_col, "prediction", weight).first()["accuracy"]

    def save(self, path: str) -> None:
        """The classifier and, next to it, the flagged rows and the noise estimates; see ``sources.model_store``."""
        from labelsift.sources import model_store

        model_store.save(self, path)
