"""Saving and loading fitted models: Spark models by their own writer, the engine's own ones by their parts."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from labelsift.plans.balanced import BalancedForestModel
from labelsift.plans.noisy_labels import NoisyLabelModel
from labelsift.plans.pu_models import BaggingPU, ElkanNoto, LabelPropagation, OneClass, TwoStagePU

#: Per class: plain values, models, lists of models, and frames.
PARTS: dict[type, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    BalancedForestModel: ((), (), ("models",), ()),
    NoisyLabelModel: (("label_col",), ("model",), (), ("errors", "joint", "noise_matrix", "inverse_noise_matrix", "prior")),
    ElkanNoto: (("c", "hold_out", "seed"), ("model",), (), ()),
    BaggingPU: (("n_bags", "seed"), (), ("models",), ()),
    TwoStagePU: (("metric", "alphas", "alpha", "scores", "compat_subset"), ("model",), (), ()),
    LabelPropagation: (("threshold",), ("model", "first"), (), ()),
    OneClass: (("nu", "width", "gamma", "seed", "cut", "mean", "directions", "phases"), (), (), ()),
}


def save(model, path: str) -> None:
    """Write a fitted model below ``path``, replacing what is there. A model that cannot be saved raises."""
    spark = SparkSession.getActiveSession()
    if type(model) not in PARTS:
        if not hasattr(model, "write"):
            raise TypeError(f"{type(model).__name__} cannot be saved")
        model.write().overwrite().save(f"{path}/spark")
        _note(spark, path, {"kind": "spark"})
        return
    plain, single, several, frames = PARTS[type(model)]
    values = {n: (v.tolist() if isinstance(v := getattr(model, n), np.ndarray) else v) for n in plain}
    if isinstance(model, BalancedForestModel):
        values |= {"features": model.getFeaturesCol(), "probability": model.getProbabilityCol(), "prediction": model.getPredictionCol()}
    for name in single:
        save(getattr(model, name), f"{path}/{name}")
    for name in several:
        for i, part in enumerate(getattr(model, name)):
            save(part, f"{path}/{name}/{i}")
        values[f"n_{name}"] = len(getattr(model, name))
    for name in frames:
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    _note(spark, path, {"kind": type(model).__name__, "values": values})


def load(spark: SparkSession, path: str):
    """The model that ``save`` wrote; it scores as the original does. Classifiers to fit anew are not kept."""
    note = json.loads(spark.read.text(f"{path}/note").first()["value"])
    if note["kind"] == "spark":
        return DefaultParamsReader.loadParamsInstance(f"{path}/spark", spark.sparkContext)
    kind = next(k for k in PARTS if k.__name__ == note["kind"])
    plain, single, several, frames = PARTS[kind]
    values = note["values"]
    parts = {n: load(spark, f"{path}/{n}") for n in single}
    parts |= {n: [load(spark, f"{path}/{n}/{i}") for i in range(values[f"n_{n}"])] for n in several}
    parts |= {n: spark.read.parquet(f"{path}/{n}") for n in frames}
    if kind is BalancedForestModel:
        return BalancedForestModel(parts["models"], values["features"], values["probability"], values["prediction"])
    if kind is NoisyLabelModel:
        return NoisyLabelModel(**parts, label_col=values["label_col"])
    model = kind.__new__(kind)
    model.classifier, model.parallelism = None, 2
    for name in plain:
        value = values[name]
        setattr(model, name, np.array(value) if name in ("mean", "directions", "phases") else value)
    for name, part in parts.items():
        setattr(model, name, part)
    return model


def _note(spark: SparkSession, path: str, note: dict) -> None:
    frame: DataFrame = spark.createDataFrame([(json.dumps(note),)], "value string")
    frame.coalesce(1).write.mode("overwrite").text(f"{path}/note")
