"""Masks of unreliable training rows for all releases at once.

A mask says of every row ``file, release`` whether its label is reliable. Rows have ``file, release, s, x``. Nothing is fitted
release by release: means, thresholds, joints and cuts are aggregates grouped by release, of which there are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.operators import frames, prune, pu, rank
from labelsift.session import settle, ship_package

MOST_RELEASES = 10_000  # their centroids travel with every task


def releases_of(rows: DataFrame) -> list[int]:
    found = [r["release"] for r in rows.select("release").distinct().limit(MOST_RELEASES + 1).collect()]
    if len(found) > MOST_RELEASES:
        raise ValueError(f"more than {MOST_RELEASES} releases")
    return sorted(found)


def centres(rows: DataFrame, releases: list[int], by: list[str] = ()) -> dict[tuple, tuple[int, np.ndarray]]:
    """``(release, class, by..) -> rows, mean vector``, from one aggregation."""
    cells = pu.centroids(rows, by=["release", "s", *by]).collect()  # a vector for each release, class and fold
    return {(r["release"], r["s"], *(r[b] for b in by)): (r["n"], np.array(r["c"])) for r in cells}


def _vectors(x: pa.Array) -> np.ndarray:
    """A batch of equally long arrays as one matrix, null components as NaN."""
    lengths = np.unique(x.value_lengths().to_numpy(zero_copy_only=False)) if len(x) else np.zeros(1)
    if x.null_count or len(lengths) > 1:
        raise ValueError("vectors must be there and equally long")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), int(lengths[0]))


def _groups(keys: tuple[pa.Array, ...]):
    """Each key of a batch and the places of its rows; a key with a null is none."""
    code, sizes = np.zeros(len(keys[0]), dtype=np.int64), []
    for k in keys:
        k = k.dictionary_encode()
        values, index = k.dictionary.to_pylist(), k.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        code = np.where((code < 0) | (index < 0), -1, code * len(values) + index)
        sizes.append(values)
    order = np.argsort(code, kind="stable")
    found, starts = np.unique(code[order], return_index=True)
    for c, at in zip(found.tolist(), np.split(order, starts[1:])):
        if c >= 0:
            key = []
            for values in reversed(sizes):
                c, i = divmod(c, len(values))
                key.append(values[i])
            yield tuple(reversed(key)), at


def _with_distances(rows: DataFrame, places: dict, metric: str, key: list[str], name: str) -> DataFrame:
    """``rows`` plus the array ``name``: the distances to the centres of classes 0 and 1 that belong to the row's ``key``; null
    where a class has no centre."""
    ship_package(rows.sparkSession)

    @F.arrow_udf("array<double>")
    def distances(x: pa.Array, *keys: pa.Array) -> pa.Array:
        out = np.full((len(x), 2), np.nan)
        m = _vectors(x)
        for k, at in _groups(keys):
            for c in (0, 1):
                if (*k, c) in places:
                    out[at, c] = pu.batch_distances(m[at], places[*k, c][None], metric)[:, 0]
        flat = out.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 2), pa.array(flat, mask=np.isnan(flat)))

    return rows.withColumn(name, distances("x", *key))


def propagation_mask(rows: DataFrame, metric: str = "cosine", alpha: float = 1.0) -> DataFrame:
    """``file, release, reliable``: positives, and rows closer to their release's unlabelled centre than ``alpha`` times to its
    positive one. A release without positives, or without unlabelled rows, has no unreliable rows."""
    means = centres(rows, releases_of(rows))
    near = _with_distances(rows, {(r, c): v for (r, c), (_, v) in means.items()}, metric, ["release"], "d")
    return near.select("file", "release", F.coalesce(pu.is_reliable(alpha), F.lit(True)).alias("reliable"))


def centroid_probabilities(rows: DataFrame, fold: Column, n_folds: int, metric: str = "euclidean", places: int = 6) -> DataFrame:
    """``rows`` plus ``fold`` and ``p``, the out-of-sample probability of class 1: the share that the distance to the centre of class 0
    has of both distances, centres being those of the release's other folds. No model is fitted. Where only one class has a
    centre, it is certain; where neither has, 0.5."""
    folded = rows.withColumn("fold", fold.cast("int"))
    releases = releases_of(rows)
    cells = centres(folded, releases, ["fold"])
    held: dict[tuple, np.ndarray] = {}
    for r in releases:
        for f in range(n_folds):
            for c in (0, 1):
                rest = [cells[r, c, g] for g in range(n_folds) if g != f and (r, c, g) in cells]
                if rest:
                    held[r, f, c] = sum(n * v for n, v in rest) / sum(n for n, _ in rest)
    near = _with_distances(folded, held, metric, ["release", "fold"], "_d")
    d0, d1 = F.element_at("_d", 1), F.element_at("_d", 2)
    share = F.coalesce(F.try_divide(d0, d0 + d1), F.lit(0.5))
    p = F.when(d0.isNull() & d1.isNull(), 0.5).when(d1.isNull(), 0.0).when(d0.isNull(), 1.0).otherwise(share)
    return near.withColumn("p", F.round(p, places)).drop("_d")


def as_one_problem(scored: DataFrame, releases: list[int], keep: tuple[str, ...] = ("file", "release")) -> tuple[DataFrame, int]:
    """Two classes in each of many releases as one problem of as many blocks of two classes, and their number.

    ``block`` is the place of the row's release among all, ``psx`` has the two probabilities of its own release, whatever the number of releases.
    """
    number = F.array_position(F.array(*[F.lit(r) for r in releases]), F.col("release")).cast("int") - 1
    return scored.select(*keep, number.alias("block"), F.col("s").cast("int").alias("s"), F.array(1.0 - F.col("p"), F.col("p")).alias("psx")), len(releases)


def pruning_mask(rows: DataFrame, fold: Column, n_folds: int, metric: str = "euclidean", method: str = "prune_by_noise_rate", keep: str = "persist") -> DataFrame:
    """``file, release, reliable``: rows that confident learning does not flag in their release."""
    releases = releases_of(rows)
    if not releases:
        return rows.select("file", "release", F.lit(True).alias("reliable"))
    scored = settle(centroid_probabilities(rows, fold, n_folds, metric).select("file", "release", "s", "p"), keep)
    probs, blocks = as_one_problem(scored, releases)
    flagged = prune.find_label_errors(probs, 2, method=method, keep="none", blocks=blocks)
    return flagged.select("file", "release", (~F.col("is_error")).alias("reliable"))


def one_class_mask(rows: DataFrame, nu: float = 0.1, width: int = 256, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """``file, release, reliable``: rows outside the density of their release's positives.

    One random Fourier map serves all releases. Each has the mean of its positives' features as its density model, from one grouped
    aggregation, and its cut is the value of rank ``ceil(nu * n)`` among its positives' densities, exact order statistics of all
    releases in the same passes. Rows inside the boundary look like positives; a release without positives has none.
    """
    releases = releases_of(rows)
    ship_package(rows.sparkSession)
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return rows.select("file", "release", F.lit(True).alias("reliable"))
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=np.sqrt(2.0 * gamma), size=(first["n"], width))
    phases, scale = rng.uniform(0.0, 2.0 * np.pi, width), np.sqrt(2.0 / width)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(scale * np.cos(pu.vector_batch(x) @ directions + phases))) if len(x) else pd.Series([], dtype=object)

    maps = rows.where("s = 1").groupBy("release").agg(Summarizer.mean(array_to_vector(mapped("x"))).alias("m"), F.count(F.lit(1)).alias("n"))
    found = {r["release"]: (r["m"].toArray(), r["n"]) for r in maps.collect()}  # a vector for each release

    @F.pandas_udf("double")
    def density(x: pd.Series, release: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        z = scale * np.cos(pu.vector_batch(x) @ directions + phases) if len(x) else np.zeros((0, width))
        for r, at in release.reset_index(drop=True).groupby(release.to_numpy(), sort=False).indices.items():
            if r in found:
                out[at] = z[at] @ found[r][0]
        return pd.Series(out)

    scored = settle(rows.select("file", "release", "s", F.round(density("x", "release"), 9).alias("density")))
    wanted = [{"release": int(r), "m": int(max(1, np.ceil(round(nu * n, 9))))} for r, (_, n) in found.items()]
    values = scored.where("s = 1").select("release", (-F.col("density")).alias("v"))
    cuts = {c["release"]: -c["cut"] for c in rank.nth_largest(values, ["release"], "v", wanted, (-2.0, 2.0))} if wanted else {}
    cut = F.element_at(frames.constant_array(rows.sparkSession, [float(cuts[r]) if r in cuts else None for r in releases]),
                       F.array_position(F.array(*[F.lit(r) for r in releases]), F.col("release")).cast("int"))
    inside = F.coalesce(F.col("density") >= cut, F.lit(False))
    return scored.select("file", "release", (~inside).alias("reliable"))
