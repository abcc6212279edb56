"""Positive-unlabelled building blocks on ``id, s, x ARRAY`` frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.distance import METRICS
from labelsift.session import ship_package

# Candidate weights of the positive distance.
ALPHAS = [0.8, 0.9, 1.0, 1.1, 1.2]


def centroids(df: DataFrame, by: list[str] = ("s",), x: str = "x") -> DataFrame:
    """``by.., n, c``: mean vector per group, one vector-valued partial aggregate."""
    v = array_to_vector(F.col(x).cast("array<double>"))
    agg = df.groupBy(*by).agg(Summarizer.metrics("mean", "count").summary(v).alias("m"))
    return agg.select(*by, F.col("m.count").alias("n"), vector_to_array("m.mean").alias("c"))


def center_matrix(centers: DataFrame, key: str = "s", value: str = "c") -> np.ndarray:
    """The centres as a matrix on the driver: one vector per class."""
    return np.array([r[value] for r in sorted(centers.select(key, value).collect(), key=lambda r: r[key])])


def vector_batch(x: pd.Series) -> np.ndarray:
    """A batch of equally long arrays as one matrix."""
    return np.stack(x.to_numpy()).astype(np.float64)


def batch_distances(rows: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """Rows x centres distance matrix of one Arrow batch."""
    if metric == "euclidean":
        return np.sqrt(((rows[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
    norms = np.sqrt((rows ** 2).sum(axis=1))[:, None] * np.sqrt((centers ** 2).sum(axis=1))[None, :]
    return 1.0 - (rows @ centers.T) / np.where(norms == 0, np.nan, norms)


def with_centroid_distances(df: DataFrame, metric: str = "cosine", x: str = "x",
                            centers: DataFrame | None = None) -> DataFrame:
    """Frame plus ``d``: distance to each class centroid.

    Centroids are K vectors and travel with the task; rows are not shuffled. Dense vectors go through
    NumPy in Arrow batches, which is far faster than array lambdas at embedding widths.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    c = center_matrix(centers if centers is not None else centroids(df, x=x))

    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def distances(batch: pd.Series) -> pd.Series:
        return pd.Series(list(batch_distances(vector_batch(batch), c, metric)))

    return df.withColumn("d", distances(x))


def is_reliable(alpha: float | Column, d: str = "d", s: str = "s") -> Column:
    """Positive, or strictly closer to the unlabelled centroid than alpha times the positive one."""
    return (F.element_at(d, 1) < F.element_at(d, 2) * alpha) | (F.col(s) == 1)


def reliable_rows(distances: DataFrame, alpha: float = 1.0) -> DataFrame:
    return distances.where(is_reliable(alpha))


def alpha_sweep(distances: DataFrame, alphas=ALPHAS) -> DataFrame:
    """``alpha, kept, kept_positive`` for all candidates in one pass."""
    sums = []
    for i, a in enumerate(alphas):
        keep = is_reliable(float(a))
        sums += [F.count_if(keep).alias(f"k{i}"), F.count_if(keep & (F.col("s") == 1)).alias(f"p{i}")]
    row = distances.agg(*sums)
    items = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"k{i}").alias("kept"),
                               F.col(f"p{i}").alias("kept_positive")) for i, a in enumerate(alphas)])
    return row.select(F.inline(items))
