"""Folds, label noise, oversampling, hold-outs and bags, all driven by deterministic order keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.functions.ordering import hash_key
from labelsift.operators import joint, rank


def _key(key: Column | None, seed: int) -> Column:
    return key if key is not None else hash_key(seed, "id")


def _sizes(df: DataFrame, k: int, label: str) -> dict[int, int]:
    return {r["s"]: r["n"] for r in joint.class_counts(df, k, label).collect()}  # K rows


def _classes(df: DataFrame, label: str, k: int | None) -> int:
    return k if k is not None else 1 + df.agg(F.max(label)).first()[0]


def stratified_folds(df: DataFrame, n_folds: int, label: str = "s", seed: int = 0, key: Column | None = None,
                     k: int | None = None) -> DataFrame:
    """Frame plus ``fold`` 0..n-1; per class, fold sizes differ by at most one.

    Folds are consecutive stretches of each class along the order key, so n - 1 exact cuts per class
    decide and the rows are not moved.
    """
    k, key = _classes(df, label, k), _key(key, seed)
    wanted = [{"g": c, "band": j - 1, "m": j * n // n_folds} for c, n in _sizes(df, k, label).items()
              for j in range(1, n_folds) if j * n // n_folds > 0]
    out, inside = rank.within(df, rank.first_rows(df, label, key, wanted), label, key, k, n_folds - 1)
    passed = sum(((~c).cast("int") for c in inside[1:]), (~inside[0]).cast("int"))
    return out.withColumn("fold", passed).drop("_cuts")


def noise_bands(y_counts: DataFrame, nm: DataFrame, k: int) -> DataFrame:
    """``y, s, moves, upto, n``: cumulative numbers of rows of true class y to move to each s.

    Fractions are dropped; a class with fewer rows than moves is left alone.
    """
    n = F.sum("n").over(W.partitionBy())
    shares = y_counts.select(F.col("s").alias("y"), "n", (F.col("n") / n).alias("py"), n.alias("all"))
    cells = nm.join(F.broadcast(shares), "y")  # K rows
    moves = F.when(F.col("s") == F.col("y"), F.lit(0)).otherwise(
        F.floor(F.col("p") * F.col("py") * F.col("all"))).cast("bigint")
    cells = cells.withColumn("moves", moves)
    w = W.partitionBy("y")
    upto = F.sum("moves").over(w.orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    cells = cells.withColumn("upto", upto).withColumn("total", F.sum("moves").over(w))
    return cells.where("total <= n").select("y", "s", "moves", "upto", "n")


def inject_noise(df: DataFrame, nm: DataFrame, k: int, seed: int = 0, key: Column | None = None) -> DataFrame:
    """Frame ``id, y, ..`` plus noisy ``s``, moving an exact number of rows per (true, noisy) pair: the
    first rows along the order key go to the lowest noisy class, the next ones to the next."""
    key = _key(key, seed)
    bands = noise_bands(joint.class_counts(df, k, "y"), nm, k).where("moves > 0").collect()  # K*K rows
    wanted = [{"g": r["y"], "band": r["s"], "m": r["upto"]} for r in bands]
    out, inside = rank.within(df, rank.first_rows(df, "y", key, wanted), "y", key, k, k)
    s = F.coalesce(*[F.when(c, F.lit(j)) for j, c in enumerate(inside)], F.col("y")).cast("int")
    return out.withColumn("s", s).drop("_cuts")


def repeat(df: DataFrame, times: Column, name: str = "copy", block: int = 1024) -> DataFrame:
    """Each row ``times`` times, numbered from 1. Large repeats are cut into blocks that spread over the
    cluster before they are written out, so no row turns into one huge array in one task."""
    rows = df.withColumn("_times", times.cast("bigint")).where("_times > 0")
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_times - 1) div {block}"))))
    blocks = blocks.repartition("id", "_block")
    start = F.col("_block") * block
    numbers = F.sequence((start + 1).cast("int"), F.least(start + block, F.col("_times")).cast("int"))
    return blocks.withColumn(name, F.explode(numbers)).drop("_times", "_block")


def extra_copies(df: DataFrame, c: int, n: int, short: int, label: str, key: Column) -> DataFrame:
    """``short`` repeats of the n rows of class c, shared out evenly; ``copy`` counts from 1."""
    rows = df.where(F.col(label) == c)
    more = short % n
    base = F.lit(short // n)
    if not more:
        return repeat(rows, base)
    cuts = rank.first_rows(rows, label, key, [{"g": c, "band": 0, "m": more}])
    out, inside = rank.within(rows, cuts, label, key, c + 1, 1)
    return repeat(out.withColumn("_more", inside[0].cast("int")).drop("_cuts"), base + F.col("_more")).drop("_more")


def oversample(df: DataFrame, k: int = 2, label: str = "s", seed: int = 0, key: Column | None = None) -> DataFrame:
    """Repeat rows of the smaller classes until all are as large as the largest. ``copy`` numbers the
    repeats, 0 being the row itself. Only rows that are repeated are shuffled."""
    key = _key(key, seed)
    sizes = _sizes(df, k, label)
    top = max(sizes.values())
    out = df.withColumn("copy", F.lit(0))
    for c, n in sizes.items():
        if 0 < n < top:
            out = out.unionByName(extra_copies(df, c, n, top - n, label, key))
    return out


def hold_out_positives(df: DataFrame, ratio: float = 0.2, label: str = "s", seed: int = 0,
                       key: Column | None = None) -> DataFrame:
    """Frame plus ``held_out``: the given share of the positives, rounded up."""
    key = _key(key, seed)
    n = df.where(F.col(label) == 1).count()
    if n == 0:
        return df.withColumn("held_out", F.lit(False))
    cuts = rank.first_rows(df.where(F.col(label) == 1), label, key, [{"g": 1, "band": 0, "m": math.ceil(n * ratio)}])
    out, inside = rank.within(df, cuts, label, key, 2, 1)
    return out.withColumn("held_out", inside[0]).drop("_cuts")


def bag_of_row(n_bags: int, seed: int = 0, key: Column | None = None) -> Column:
    """Bag of an unlabelled row: every bag gets about 1/n of them."""
    return F.pmod(_key(key, seed), F.lit(n_bags)).cast("int")


def bag(df: DataFrame, b: int, n_bags: int, label: str = "s", seed: int = 0, key: Column | None = None) -> DataFrame:
    """Rows of one bag: all positives and its share of the unlabelled rows."""
    return df.where((F.col(label) == 1) | (bag_of_row(n_bags, seed, key) == b))
