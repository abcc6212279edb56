"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.llm import scratch
from labelsift.llm.components import components
from labelsift.session import ship_package

MOST_PIVOTS = 1024  # bound of what is broadcast: so many vectors
CANDIDATES = 4  # vectors drawn for each pivot wanted, so that enough are left after thinning
WIDEST = 0.9  # cosine from which one pivot stands for another
CHUNK = 512  # rows of an inverted list that one block holds
KEYS = ["label", "dim", "pivot", "lo", "hi"]


def can_link(id_col: str, vector_col: str, label_col: str) -> F.Column:
    """Neither id nor label is null; the vector has no null or non-finite component and is not zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    filled = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    return F.coalesce(filled & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vector, dim`` of the rows that can link."""
    v = F.col(vector_col).cast("array<double>")
    return vectors.where(can_link(id_col, vector_col, label_col)).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector"), F.size(v).alias("dim"))


def scaled(vectors: list) -> np.ndarray:
    m = np.array(vectors, dtype=np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def apart(unit: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` rows with no cosine of ``WIDEST`` or more to one taken before. A group of near copies
    yields one pivot: the order of several would be noise that its members do not share."""
    taken: list[int] = []
    free = np.ones(len(unit), dtype=bool)
    for i in range(len(unit)):
        if free[i] and len(taken) < most:
            taken.append(i)
            free &= unit @ unit[i] < WIDEST
    return np.array(taken, dtype=np.int64)


def describe(classes: DataFrame, n_pivots: int, prefix: int, seed: int) -> DataFrame:
    """Adds ``near``: the numbers of the ``prefix`` nearest pivots, nearest first. Pivots are the vectors with the
    smallest seeded hash that are not near one another. Where a dimension has no pivot, the one list ``-1`` takes every vector."""
    spark = classes.sparkSession
    chosen = classes.select("dim", "vector").orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(CANDIDATES * n_pivots).collect()
    by_dim: dict[int, list] = {}
    for i, row in enumerate(chosen):
        by_dim.setdefault(row["dim"], []).append((i, row["vector"]))
    pivots_of = {}
    for d, v in by_dim.items():
        numbers, unit = np.array([i for i, _ in v]), scaled([x for _, x in v])
        kept = apart(unit, max(1, n_pivots * len(v) // len(chosen)))  # each dimension has its share
        pivots_of[d] = numbers[kept], unit[kept]
    shared = spark.sparkContext.broadcast(pivots_of)

    @F.pandas_udf("array<int>")
    def nearest(vector: pd.Series) -> pd.Series:
        out: list = [None] * len(vector)
        dims = vector.map(len).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            numbers, pivots = shared.value.get(int(d), (np.array([-1]), None))
            if pivots is None:
                ranked = np.full((len(at), 1), -1)
            else:
                cosines = scaled(vector.iloc[at].tolist()) @ pivots.T
                ranked = numbers[np.argsort(-cosines, axis=1, kind="stable")[:, :prefix]]
            for i, r in zip(at, ranked):
                out[i] = r.astype(np.int32)
        return pd.Series(out, dtype=object)

    return classes.withColumn("near", nearest("vector"))


def blocks(described: DataFrame) -> DataFrame:
    """Entries of the inverted lists, dealt to pairs of chunks of at most about ``CHUNK`` rows."""
    entries = described.select("vec_id", "n", "label", "dim", "vector", "near", F.explode("near").alias("pivot"))
    sizes = entries.groupBy("label", "dim", "pivot").agg(F.count("*").alias("entries")).where("entries > 1")
    sizes = sizes.withColumn("chunks", F.ceil(F.col("entries") / CHUNK).cast("int")).drop("entries")
    entries = entries.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    return entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns(
        {"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("chunks", "other")


def verified(block: pd.DataFrame, least_cosine: float, shared_pivots: int) -> pd.DataFrame:
    """Of one block: per class, how many vectors it links with, and the smallest class reached inside the block.

    A pair counts in the list of its smallest shared pivot only, and if it shares enough of them.
    """
    pivot, lo, hi = int(block["pivot"].iloc[0]), int(block["lo"].iloc[0]), int(block["hi"].iloc[0])
    block = block.sort_values("vec_id", ignore_index=True)
    own = block["own"].to_numpy()
    a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    ids, n = block["vec_id"].to_numpy(), block["n"].to_numpy()
    unit = scaled(block["vector"].tolist())
    near = np.array(block["near"].tolist())
    best, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    # pivots shared are counted by products of rows that hold 1 for each pivot described by
    numbers, place = np.unique(near, return_inverse=True)
    holds = np.zeros((len(near), len(numbers)), dtype=np.float32)
    holds[np.arange(len(near))[:, None], place.reshape(near.shape)] = 1
    before = holds[:, numbers < pivot]
    first, second = [], []
    step = max(1, 2_000_000 // max(1, len(b)))
    for s in range(0, len(a), step):
        rows = a[s:s + step]
        found = unit[rows] @ unit[b].T >= least_cosine
        rows, columns = rows[found.any(axis=1)], b[found.any(axis=0)]
        found = found[found.any(axis=1)][:, found.any(axis=0)]
        found &= (holds[rows] @ holds[columns].T >= min(shared_pivots, near.shape[1])) & (before[rows] @ before[columns].T == 0)
        i, j = np.nonzero(found)
        i, j = rows[i], columns[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        first.append(i)
        second.append(j)
    i, j = np.concatenate(first or [a[:0]]), np.concatenate(second or [a[:0]])
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    while True:
        low = np.minimum(best[i], best[j])
        if (low == best[i]).all() and (low == best[j]).all():
            break
        np.minimum.at(best, i, low)
        np.minimum.at(best, j, low)
    hit = links > 0
    return pd.DataFrame({"vec_id": ids[hit], "links": links[hit], "to": ids[best[hit]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least_cosine: float = 0.98, prefix: int = 8, shared_pivots: int = 2, n_pivots: int | None = None, seed: int = 42) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    Vectors of one label link if they share ``shared_pivots`` of their ``prefix`` nearest pivots and their cosine, in
    double precision, is at least ``least_cosine``. Equal vectors are one class and counted, not paired. Pivots: at
    most 1,024, else the square root of the number of classes (64 at least), and none near another, so that a group of
    near copies shares one list and its links cost the square of its distinct vectors. Every class is indexed; a list is compared in blocks of bounded size, each of which returns a row per class, not per pair.
    Vectors that are null, zero or hold null or non-finite components, and rows without label or id, link with
    nothing. Repeated rows are vectors of their own. Other dimensions than a vector's own never link with it.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = scratch.write(usable(vectors, id_col, vector_col, label_col))
    classes = scratch.write(rows.groupBy("label", "vector", "dim").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    n_pivots = n_pivots or min(MOST_PIVOTS, max(64, int(classes.count() ** 0.5)))
    kind = classes.schema["vec_id"].dataType.simpleString()
    found = blocks(describe(classes, n_pivots, prefix, seed)).groupBy(*KEYS).applyInPandas(
        lambda block: verified(block, least_cosine, shared_pivots), f"vec_id {kind}, links bigint, to {kind}")
    found = scratch.write(found)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select("vec_id", "to"), "vec_id", "to").withColumnRenamed("node", "vec_id")
    classes = classes.join(links, "vec_id", "left").join(roots, "vec_id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    linked = rows.join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    others = vectors.where(~can_link(id_col, vector_col, label_col)).select(
        F.col(id_col).alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
