"""Out-of-sample class probabilities."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.probability import entries
from labelsift.operators import pu, sampling
from labelsift.session import in_parallel, settle, ship_package


def cross_val_probabilities(df: DataFrame, estimator, n_folds: int = 5, seed: int = 0, key: Column | None = None,
                            parallelism: int = 2, keep: str = "persist") -> DataFrame:
    """Frame ``id, s, .., features`` plus ``fold`` and ``psx``: every row scored by a model that did
    not see its fold. Folds are stratified by label; fits run ``parallelism`` at a time."""
    folded = settle(sampling.stratified_folds(df, n_folds, seed=seed, key=key), keep)

    def scored(fold: int) -> DataFrame:
        model = estimator.fit(folded.where(F.col("fold") != fold))
        out = model.transform(folded.where(F.col("fold") == fold))
        return out.select(*folded.columns, vector_to_array(estimator.getProbabilityCol()).alias("psx"))

    parts = in_parallel(df.sparkSession, scored, range(n_folds), parallelism)
    return reduce(DataFrame.unionByName, parts)


def centroid_cv_probabilities(df: DataFrame, k: int, n_folds: int, fold: Column, sharpness: float = 8.0,
                              places: int = 6) -> DataFrame:
    """Frame ``id, s, x`` plus ``psx`` without any model fit: softmax of the cosine similarity to the
    class centroids of the other folds.

    One aggregation gives a mean per (class, fold); leaving a fold out is a sum over those few rows.
    """
    folded = df.withColumn("fold", fold.cast("int"))
    cells = pu.centroids(folded, by=["s", "fold"]).select("s", "fold", "n", F.posexplode("c").alias("i", "v"))
    outs = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col("fold"))
    left_out = (cells.withColumn("out", F.explode(outs)).groupBy("out", "s", "i")
                .agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")))
    centers = np.zeros((n_folds, k, 0))
    for r in left_out.collect():  # folds x classes x dimensions
        if centers.shape[2] <= r["i"]:
            centers = np.pad(centers, ((0, 0), (0, 0), (0, r["i"] + 1 - centers.shape[2])))
        centers[r["out"], r["s"], r["i"]] = r["v"]

    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def softmax_of_similarity(x: pd.Series, fold: pd.Series) -> pd.Series:
        rows, held = pu.vector_batch(x), fold.to_numpy()
        out = np.empty((len(rows), k))
        for f in np.unique(held):
            out[held == f] = 1.0 - pu.batch_distances(rows[held == f], centers[f], "cosine")
        e = np.exp(out * sharpness)
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    scored = folded.withColumn("_p", softmax_of_similarity("x", "fold"))
    return scored.withColumn("psx", F.array(*[F.round(p, places) for p in entries("_p", k)])).drop("_p")
