"""Exact nearest neighbours in many dimensions: boxes in a principal basis, partial distances, shrinking radii."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.functions.ordering import hash_key
from labelsift.operators.pu import vector_batch
from labelsift.session import settle, ship_package

LEAF = 512  # vectors of a leaf, on average, until there are MOST_LEAVES
MOST_LEAVES = 4_096  # their boxes travel with every task
PER_LEAF = 4  # sampled vectors for each leaf; they place the cuts of the tree
CHUNK = 1_024  # vectors of a block; larger leaves have several
LEADING = 16  # coordinates that bounds and partial distances use; the others enter by their length
FIRST_VISITS = 4  # leaves looked into before the radius is taken anew


@dataclass
class Tree:
    """A principal basis and a tree of median cuts along its leading coordinates."""

    basis: np.ndarray
    cuts: list  # per level: the coordinate and the cut of each node

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Leading coordinates, then the length of the rest: distances between such rows are never larger than the true ones."""
        y = x @ self.basis
        lead, rest = y[:, :LEADING], y[:, LEADING:]
        return np.concatenate([lead, np.sqrt((rest * rest).sum(axis=1))[:, None]], axis=1)

    def leaves(self, placed: np.ndarray) -> np.ndarray:
        at = np.zeros(len(placed), dtype=np.int64)
        rows = np.arange(len(placed))
        for axes, cuts in self.cuts:
            at = 2 * at + (placed[rows, axes[at]] > cuts[at])
        return at


def principal_basis(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the covariance of all rows, by falling variance; each task sends one sum of products."""

    def run(batches):
        n, total, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = vector_batch(batch.column(0).to_pandas())
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()]), pa.array([products.tobytes()])], names=["n", "total", "products"])

    def add(sums: pd.DataFrame) -> pd.DataFrame:
        n, total = sums["n"].sum(), sum(np.frombuffer(t) for t in sums["total"])
        products = sum(np.frombuffer(p) for p in sums["products"])
        return pd.DataFrame({"n": [n], "total": [total.tobytes()], "products": [products.tobytes()]})

    kind = "n bigint, total binary, products binary"
    few = F.pmod(F.spark_partition_id(), F.lit(32))  # two steps, so that no task adds up all of them
    parts = vectors.select("x").mapInArrow(run, kind).groupBy(few.alias("g")).applyInPandas(add, kind)
    rows = parts.collect()  # 32 sums at most
    n, total = sum(r["n"] for r in rows), sum(np.frombuffer(r["total"]) for r in rows)
    mean = total / max(n, 1)
    covariance = sum(np.frombuffer(r["products"]).reshape(dim, dim) for r in rows) / max(n, 1) - np.outer(mean, mean)
    return np.linalg.eigh(covariance)[1][:, ::-1].copy()


def grow(basis: np.ndarray, sample: np.ndarray, leaves: int) -> Tree:
    """Cuts at the median of the widest leading coordinate of what a sample has in each node."""
    tree = Tree(basis, [])
    placed = tree.placed(sample)
    at = np.zeros(len(placed), dtype=np.int64)
    while 1 << len(tree.cuts) < leaves:
        n = 1 << len(tree.cuts)
        axes, cuts = np.zeros(n, dtype=np.int64), np.zeros(n)
        for node in range(n):
            own = placed[at == node]
            if len(own):
                axes[node] = own.var(axis=0).argmax()
                cuts[node] = np.median(own[:, axes[node]])
        tree.cuts.append((axes, cuts))
        at = 2 * at + (placed[np.arange(len(placed)), axes[at]] > cuts[at])
    return tree


def gaps(placed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least possible distance ``[row, box]`` to anything in each box."""
    out = np.zeros((len(placed), len(lo)))
    for j in range(placed.shape[1]):
        x = placed[:, j][:, None]
        d = np.maximum(np.maximum(lo[:, j] - x, x - hi[:, j]), 0.0)
        out += d * d
    return np.sqrt(out)


def nearest_of_block(tree: Tree, ids: np.ndarray, x: np.ndarray, radius: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """Per row the k nearest others of the block within its radius, ``(distance, id)``, and how many rows it was compared with.

    Partial distances leave most of the block out; the others are measured by the differences themselves, so that a
    pair's distance is the same in every block.
    """
    mine, theirs = tree.placed(x), tree.placed(other)
    partial = (mine * mine).sum(axis=1)[:, None] + (theirs * theirs).sum(axis=1)[None] - 2.0 * (mine @ theirs.T)
    pad = 1e-9 * max(np.abs(mine).max(initial=0.0), np.abs(theirs).max(initial=0.0))
    room = radius * (1 + 1e-9) + pad
    partial[ids[:, None] == other_ids[None]] = np.inf
    scale = 1e-9 * (np.abs(mine).max(initial=0.0) + np.abs(theirs).max(initial=0.0)) ** 2 * mine.shape[1]
    out, compared = [], np.zeros(len(ids), dtype=np.int64)
    for i in range(len(ids)):
        close = np.flatnonzero((partial[i] <= room[i] * room[i] + scale) & np.isfinite(partial[i]))
        if len(close) > 4 * k:  # the closest by partial distance first: they bound the rest
            first = close[np.argpartition(partial[i, close], k - 1)[:k]]
            near = np.sqrt(((other[first] - x[i]) ** 2).sum(axis=1)).max()
            close = close[partial[i, close] <= (near * (1 + 1e-9) + pad) ** 2 + scale]
            compared[i] += k
        exact = np.sqrt(((other[close] - x[i]) ** 2).sum(axis=1))
        compared[i] += len(close)
        order = np.lexsort((other_ids[close], exact))[:k]
        out.append([(float(exact[j]), int(other_ids[close[j]])) for j in order if exact[j] <= radius[i]])
    return out, compared


FOUND = "vid bigint, near array<struct<d:double,o:bigint>>, compared bigint"


def _frame(ids: np.ndarray, found: list, compared: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"vid": ids, "near": [[{"d": d, "o": o} for d, o in f] for f in found], "compared": compared}).astype({"vid": "int64", "compared": "int64"})


def searched(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``vid, near, compared``: like ``nearest``, with distances and the number of rows that each vector was measured against."""
    spark = vectors.sparkSession
    ship_package(spark)
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], FOUND)
    leaves = 1 << max(0, int(min(MOST_LEAVES, n // LEAF)).bit_length() - 1) if n >= 2 * LEAF else 1
    basis = principal_basis(vectors, dim)
    drawn = vectors.orderBy(hash_key(seed, "vid"), "vid").limit(PER_LEAF * leaves).select("x").toArrow()["x"].to_pandas()
    tree = grow(basis, vector_batch(drawn), leaves)
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("leaf bigint, y array<double>")
    def place(x: pd.Series) -> pd.DataFrame:
        placed = shared.value.placed(vector_batch(x))
        return pd.DataFrame({"leaf": shared.value.leaves(placed), "y": list(placed)})

    placed = settle(vectors.select("vid", "x", place("x").alias("p")).select("vid", "x", "p.*"))
    width = min(dim, LEADING) + 1
    ends = [f(F.get("y", j)).alias(f"{name}{j}") for name, f in (("lo", F.min), ("hi", F.max)) for j in range(width)]
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("leaf").collect()  # MOST_LEAVES rows at most
    numbers = np.array([b["leaf"] for b in boxes])
    lo, hi = (np.array([[b[f"{name}{j}"] for j in range(width)] for b in boxes]) for name in ("lo", "hi"))
    chunks = np.zeros(1 << len(tree.cuts), dtype=np.int64)
    chunks[numbers] = [-(-b["n"] // CHUNK) for b in boxes]
    bounds = spark.sparkContext.broadcast((numbers, lo, hi, chunks == 1))
    n_chunks = F.element_at(F.lit([int(c) for c in chunks]), (F.col("leaf") + 1).cast("int"))
    rows = placed.select("leaf", F.pmod(hash_key(seed + 1, "vid"), F.greatest(n_chunks, F.lit(1))).alias("block"), "vid", "x")
    parts = -(-n // CHUNK)

    def own(block: pd.DataFrame) -> pd.DataFrame:
        ids, x = block["vid"].to_numpy(), vector_batch(block["x"])
        return _frame(ids, *nearest_of_block(shared.value, ids, x, np.full(len(ids), np.inf), ids, x, k))

    def merge(found: DataFrame) -> DataFrame:
        best = found.groupBy("vid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"), F.sum("compared").alias("compared"))
        return best  # k rows for each block visited

    def visit(best: DataFrame, first: int, last: int | None) -> DataFrame:
        """Look into the leaves that can hold a nearer vector, by rising bound from the ``first`` to the ``last`` but one of them."""

        @F.pandas_udf("array<bigint>")
        def chosen(x: pd.Series, radius: pd.Series) -> pd.Series:
            tree, (numbers, lo, hi, whole) = shared.value, bounds.value
            placed = tree.placed(vector_batch(x))
            least = gaps(placed, lo, hi)
            mine = tree.leaves(placed)
            mine[~whole[mine]] = -1  # a leaf of several blocks is visited like others
            pad = 1e-9 * max(np.abs(a).max(initial=0.0) for a in (placed, lo, hi))  # for rounding in the rotated coordinates
            room = radius.to_numpy(dtype=np.float64, na_value=np.inf) * (1 + 1e-9) + pad
            out = []
            for i in range(len(x)):
                order = np.argsort(least[i], kind="stable")[: None if last is None else last + 1]
                order = order[numbers[order] != mine[i]][first:last]
                out.append(numbers[order][least[i, order] <= room[i]])
            return pd.Series(out, dtype=object)

        known = vectors.select("vid", "x").join(best, "vid", "left").withColumn("r", F.coalesce(F.get("near", k - 1)["d"], F.lit(float("inf"))))
        asked = known.withColumn("leaf", F.explode(chosen("x", "r"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks - 1)))
        asked = asked.select("leaf", "block", F.pmod(hash_key(seed + 2, "vid"), F.lit(parts)).alias("part"), "vid", "x", "r")
        asked = settle(asked)
        wanted = asked.select("leaf", "block", F.col("part").alias("of")).distinct()
        base = rows.join(wanted, ["leaf", "block"]).select(F.col("leaf").alias("base_leaf"), F.col("block").alias("base_block"), "of", F.col("vid").alias("o"), F.col("x").alias("ox"))

        def answer(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(held):
                return _frame(np.empty(0, np.int64), [], np.empty(0, np.int64))
            ids = queries["vid"].to_numpy()
            return _frame(ids, *nearest_of_block(shared.value, ids, vector_batch(queries["x"]), queries["r"].to_numpy(), held["o"].to_numpy(), vector_batch(held["ox"]), k))

        found = asked.groupBy("leaf", "block", "part").cogroup(base.groupBy("base_leaf", "base_block", "of")).applyInPandas(answer, FOUND)
        return merge(best.unionByName(found))

    best = settle(rows.groupBy("leaf", "block").applyInPandas(own, FOUND))
    best = settle(visit(best, 0, FIRST_VISITS))
    return visit(best, FIRST_VISITS, None)


def nearest(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``vid, near``: ids of the k nearest other vectors, nearest first, ties by id. ``vectors`` has ``vid BIGINT, x``.

    Vectors are turned into the principal basis of all rows. A tree of median cuts deals them to leaves, each of which has
    a box of the leading coordinates and of the length of the rest. The k-th distance in a vector's own block is its first
    radius; then it looks into the leaves whose boxes come within the radius, the closest few first, which shrinks
    it. Inside a block partial distances leave rows out before any is measured. All bounds are exact, and one path serves
    any number of vectors. How many rows are compared depends on how fast the variance falls along the basis; where it does
    not fall at all, as in noise, boxes overlap and work grows with the square.
    """
    return searched(vectors, k, seed).select("vid", F.transform("near", lambda e: e.o).alias("near"))
