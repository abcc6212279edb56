"""Synthetic minority oversampling: new rows between a minority row and one of its nearest ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.ordering import hash_key, unit_interval
from labelsift.operators import joint, sampling
from labelsift.plans import neighbours
from labelsift.session import settle


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``vid, x, copies``: equal vectors are one row, so a much-copied vector is no hot group."""
    return rows.groupBy("x").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("copies"))


def smote(df: DataFrame, k: int = 2, seed: int = 42, label: str = "s", key: Column | None = None, n_classes: int = 2,
          pick_key: Callable[[int], Column] | None = None) -> DataFrame:
    """Synthetic rows ``id, copy, s, x`` that lift every smaller class to the size of the largest.

    ``df`` has ``id, s, x ARRAY<DOUBLE>``. Neighbours are exact whatever the size of a class. ``key`` orders the rows
    that get one copy more; ``pick_key`` gives the order keys of the neighbour (1) and of the place on the line (2).
    """
    sizes = {r["s"]: r["n"] for r in joint.class_counts(df, n_classes, label).collect()}
    top = max(sizes.values())
    pick_key = pick_key or (lambda i: hash_key(seed + i, "id", "copy"))
    parts = [_synthesise(df.where(F.col(label) == c), c, n, top - n, k, label, key if key is not None else hash_key(seed, "id"), pick_key, seed)
             for c, n in sizes.items() if 0 < n < top]
    if not parts:
        return df.limit(0).select("id", F.lit(0).alias("copy"), label, "x")
    return reduce(DataFrame.unionByName, parts)


def _synthesise(rows: DataFrame, c: int, n: int, short: int, k: int, label: str, key: Column, pick_key, seed: int) -> DataFrame:
    vectors = settle(distinct_vectors(rows))
    near = neighbours.nearest(vectors.select("vid", "x"), k, seed)
    # Copies of a vector are its nearest rows, at distance 0.
    twins = F.array_repeat("vid", F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    known = vectors.join(near, "vid", "left").select(
        F.col("x").alias("_vx"), F.slice(F.concat(twins, F.coalesce("near", F.array().cast("array<bigint>"))), 1, k).alias("_near"))
    # Rows meet their vector before they are repeated; the copies meet their neighbour by its number.
    rows = rows.select("id", label, "x").join(known, F.col("x") == F.col("_vx")).drop("_vx")
    made = sampling.extra_copies(rows, c, n, short, label, key)
    pick = F.pmod(pick_key(1), F.greatest(F.size("_near"), F.lit(1))).cast("int")
    made = made.withColumn("_o", F.get("_near", pick))
    made = made.join(vectors.select(F.col("vid").alias("_o"), F.col("x").alias("_n")), "_o", "left")
    u = unit_interval(pick_key(2))
    return made.select("id", "copy", label, F.zip_with("x", F.coalesce("_n", "x"), lambda a, b: a + (b - a) * u).alias("x"))
