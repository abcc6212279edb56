"""Hard negatives by score windows, read from Hilbert-ordered Parquet blocks chosen by zone maps."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelsift.llm import scratch
from labelsift.session import ship_package

BLOCK = 1_024  # rows of a block
SHARD_ROWS, MOST_SHARDS = 16_384, 4_096  # rows of a Parquet folder of blocks, until there are so many folders
ANCHORS = 4_096  # anchors, about, that travel together
BITS = 2  # of each component on the curve
LARGEST = 1 << 28  # of a component's size, so that a score fits 64 bits
NONE = np.iinfo(np.int64).min


def hilbert_keys(u: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve through a grid of ``2 ** bits`` steps in every dimension, as bytes in order.

    Skilling's transform, on all rows at once.
    """
    x = u.astype(np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(x.shape[1]):
            hit = (x[:, i] & step) != 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(hit, low, swap)
            x[:, i] ^= swap
        step >>= 1
    for i in range(1, x.shape[1]):
        x[:, i] ^= x[:, i - 1]
    turn, step = np.zeros(len(x), dtype=np.int64), 1 << (bits - 1)
    while step > 1:
        turn ^= np.where((x[:, -1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= turn[:, None]
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)], axis=1).reshape(len(x), -1).astype(np.uint8)
    return [r.tobytes() for r in np.packbits(planes, axis=1)]


def scores(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where these hold them, else by 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(rows).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ rows.astype(np.int64).T


def intervals(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: bounds of each anchor's scores with anything between ``lo`` and ``hi``, rounded outwards."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    least, most = up @ lo + down @ hi, up @ hi + down @ lo
    slack = 1e-9 * (np.abs(least) + np.abs(most)) + 1
    return least - slack, most + slack


def best_rows(found: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest, ties to the first."""
    if len(found) > k:
        cut = np.partition(found, len(found) - k)[len(found) - k]
        over, at = np.flatnonzero(found > cut), np.flatnonzero(found == cut)
        keep = np.concatenate([over, at[:k - len(over)]])
    else:
        keep = np.arange(len(found))
    return keep[np.lexsort((keep, -found[keep]))]


def padded(vectors, dim: int) -> np.ndarray:
    """Integer matrix; missing components at the end are 0."""
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


BLOCKS = ("block bigint, shard int, label bigint, lo array<bigint>, hi array<bigint>, ids array<bigint>, rows binary, "
          "anchors array<int>, known array<bigint>")


def blocks_of(points: DataFrame, dim: int, positives: int) -> DataFrame:
    """One row per block of sorted ``points``: its zone map, its rows in order of id, which of them are anchors and the lowest of
    the ``positives`` best scores that an anchor has inside its own block. Labels are never mixed in a block."""

    def close(held: list, number: int) -> tuple:
        held.sort(key=lambda r: r[1])
        m = padded([r[2] for r in held], dim)
        anchors = [i for i, r in enumerate(held) if r[3]]
        ids, known = np.array([r[1] for r in held]), []
        for i, s in zip(anchors, scores(m[np.array(anchors, dtype=np.int64)], m)):
            s = s[ids != ids[i]]
            known.append(int(np.partition(s, len(s) - positives)[len(s) - positives]) if len(s) >= positives else NONE)
        part = TaskContext.get().partitionId()
        return (part << 33) + number, part, held[0][0], m.min(axis=0), m.max(axis=0), ids, m.astype(np.int32).tobytes(), anchors, known

    def run(batches):
        held, number, before = [], 0, None
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        as_batch = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "id", "v", "asks"))):
                if before and row[:3] == before[:3]:
                    continue  # a repeated row
                if held and (len(held) == BLOCK or row[0] != held[0][0]):
                    yield as_batch(close(held, number))
                    held, number = [], number + 1
                held.append(row)
                before = row
        if held:
            yield as_batch(close(held, number))

    return points.mapInArrow(run, BLOCKS)


def best_positives(blocks: DataFrame, chunk, dim: int, k: int) -> DataFrame:
    """``a, id, score``: the ``k`` best rows of an anchor's label that a task has read. ``chunk``: anchors ``a, id, label, known`` and their matrix."""

    def run(batches):
        (number, own, label, known), a = chunk.value
        best: list[list] = [[] for _ in number]
        for batch in batches:
            for lo, hi, ids, rows, of in zip(*(batch.column(c) for c in ("lo", "hi", "ids", "rows", "label"))):
                mine = np.flatnonzero(label == of.as_py())
                if not len(mine):
                    continue
                _, most = intervals(a[mine], np.array(lo.as_py()), np.array(hi.as_py()))
                floor = np.array([max(known[i], best[i][-1][0] if len(best[i]) == k else NONE) for i in mine])
                mine = mine[most >= floor]
                if not len(mine):
                    continue
                ids, m = np.array(ids.as_py()), np.frombuffer(rows.as_py(), dtype=np.int32).reshape(-1, dim)
                for i, s in zip(mine, scores(a[mine], m)):
                    other = np.flatnonzero(ids != own[i])
                    top = other[best_rows(s[other], k)]
                    best[i] = sorted(best[i] + [(int(s[j]), int(ids[j])) for j in top], key=lambda x: (-x[0], x[1]))[:k]
        rows = [(int(number[i]), d, s) for i, found in enumerate(best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [(), (), ()])], names=["a", "id", "score"])

    found = blocks.select("lo", "hi", "ids", "rows", "label").mapInArrow(run, "a bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    return found.withColumn("p", place).where(F.col("p") <= k)


def best_negatives(blocks: DataFrame, chunk, dim: int, k: int) -> DataFrame:
    """``a, p, id, score``: the ``k`` best rows of other labels in each window that a task has read. ``chunk``: windows
    ``a, p, row, label, least, most`` and the matrix of anchors that ``row`` leads to."""

    def run(batches):
        (number, p, row, label, least, top), a = chunk.value
        best: list[list] = [[] for _ in number]
        floor = least.copy()  # what a row must score to matter; rises when a window is full
        for batch in batches:
            for lo, hi, ids, rows, of in zip(*(batch.column(c) for c in ("lo", "hi", "ids", "rows", "label"))):
                under, over = intervals(a, np.array(lo.as_py()), np.array(hi.as_py()))
                asks = np.flatnonzero((label != of.as_py()) & (over[row] >= floor) & (under[row] <= top))
                if not len(asks):
                    continue
                ids, m = np.array(ids.as_py()), np.frombuffer(rows.as_py(), dtype=np.int32).reshape(-1, dim)
                used, back = np.unique(row[asks], return_inverse=True)
                s = scores(a[used], m)
                order = np.argsort(-s, axis=1, kind="stable")
                ranked = np.take_along_axis(s, order, axis=1)
                for w, r in zip(asks, back):
                    start = np.searchsorted(-ranked[r], -top[w], "left")
                    got = ranked[r, start:start + k]
                    got = got[got >= floor[w]]
                    if len(got):
                        new = [(int(x), int(ids[j])) for x, j in zip(got, order[r, start:])]
                        best[w] = sorted(best[w] + new, key=lambda x: (-x[0], x[1]))[:k]
                        if len(best[w]) == k:
                            floor[w] = best[w][-1][0]
        out = [(int(number[w]), int(p[w]), d, s) for w, found in enumerate(best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [(), (), (), ()])], names=["a", "p", "id", "score"])

    found = blocks.select("lo", "hi", "ids", "rows", "label").mapInArrow(run, "a bigint, p bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def zone_maps(blocks: DataFrame, dim: int) -> tuple[np.ndarray, ...]:
    """Of every folder of blocks (``MOST_SHARDS`` at most): number, smallest and largest label, and of every component."""
    ends = [f(F.get(c, j)).alias(f"{c}{j}") for c, f in (("lo", F.min), ("hi", F.max)) for j in range(dim)]
    rows = blocks.groupBy("shard").agg(F.min("label").alias("first"), F.max("label").alias("last"), *ends).collect()
    lo, hi = (np.array([[r[f"{c}{j}"] for j in range(dim)] for r in rows]) for c in ("lo", "hi"))
    return *(np.array([r[c] for r in rows]) for c in ("shard", "first", "last")), lo, hi


def anchors_of(blocks: DataFrame, dim: int) -> DataFrame:
    """``a, id, label, known, v`` of all anchors, in chunks of neighbours: the column ``chunk``."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for block, label, ids, m, at, known in zip(*(batch.column(c) for c in ("block", "label", "ids", "rows", "anchors", "known"))):
                m, ids = np.frombuffer(m.as_py(), dtype=np.int32).reshape(-1, dim), ids.as_py()
                rows += [(block.as_py() * BLOCK + i, ids[i], label.as_py(), k, m[i]) for i, k in zip(at.as_py(), known.as_py())]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=["a", "id", "label", "known", "v"])

    held = blocks.where(F.size("anchors") > 0)
    total = held.agg(F.sum(F.size("anchors"))).first()[0] or 0
    chunks = max(1, math.ceil(total / ANCHORS))
    found = held.select("block", "label", "ids", "rows", "anchors", "known").mapInArrow(run, "a bigint, id bigint, label bigint, known bigint, v array<int>")
    if chunks == 1:
        return scratch.write(found.withColumn("chunk", F.lit(0)))
    return scratch.write(scratch.write(found).repartitionByRange(chunks, "a").withColumn("chunk", F.spark_partition_id()))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its
    ``positives`` best rows of the same label, the best ``negatives`` rows of other labels whose score is from ``least`` to
    ``most`` per cent of the positive's.

    Components are ``floor(scale * x)``, scores integer inner products; higher ones come first, ties by smaller id. Rows are
    sorted by label and place on the Hilbert curve and written as Parquet in blocks of 1,024 with the smallest and largest
    value of every component. Interval arithmetic over these zone maps tells which blocks can hold one of the best
    positives or lie in a window: first for whole folders of blocks, which are then not read, next for each block. What
    an anchor finds in its own block is the first threshold; it rises as better rows are found. Nothing is left out
    that could change the result. About 4,096 neighbouring anchors travel together and read the blocks they need, so
    rows are shuffled once only. Where vectors are spread evenly over many dimensions the bounds are wide, and anchors
    read most blocks.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part. Components above
    2**28 in size count as 2**28. Missing components of shorter vectors count as 0. Repeated rows (id, label, vector) count
    once; rows with the anchor's id are not its positives. A positive with a negative score has an empty window. No anchors
    or an empty table: empty result. Columns of any other name play no part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.coalesce(F.col(id_col).isNotNull() & label.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))
    bound = float(LARGEST)
    whole = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(bound)), F.lit(-bound)).cast("int")
    points = vectors.where(fit).select(label.cast("bigint").alias("label"), F.col(id_col).cast("bigint").alias("id"),
                                       F.transform(v, whole).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    n, dim, low, high = points.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    shards, dim = max(1, min(MOST_SHARDS, math.ceil(n / SHARD_ROWS))), dim or 1

    @F.pandas_udf("binary")
    def place(v: pd.Series) -> pd.Series:
        u = (padded(v, dim) - low) * (1 << BITS) // (high - low + 1)
        return pd.Series(hilbert_keys(np.clip(u, 0, (1 << BITS) - 1), BITS))

    order = ["label", "key", "id", "v"]
    ordered = scratch.write(points.withColumn("key", place("v"))).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    path = f"{scratch.folder(spark).rstrip('/')}/labelsift-{uuid.uuid4().hex}"
    blocks_of(ordered, dim, positives).write.partitionBy("shard").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shard, first, last, lo, hi = zone_maps(blocks, dim)
    anchors = anchors_of(blocks, dim)
    out = None
    for c in range(anchors.select(F.max("chunk")).first()[0] + 1 if len(shard) and not anchors.isEmpty() else 0):
        rows = anchors.where(F.col("chunk") == c).collect()  # about ANCHORS rows
        if not rows:
            continue
        a = np.array([r["v"] for r in rows], dtype=np.int64)
        number, own, of, known = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("a", "id", "label", "known"))
        wanted = [int(s) for s, f, t, x, y in zip(shard, first, last, lo, hi) if ((of >= f) & (of <= t) & (intervals(a, x, y)[1] >= known)).any()]
        chunk = spark.sparkContext.broadcast(((number, own, of, known), a))
        found = best_positives(blocks.where(F.col("shard").isin(wanted)), chunk, dim, positives).collect()  # positives x ANCHORS rows
        at = {int(k): i for i, k in enumerate(number)}
        windows = [(r["a"], r["p"], at[r["a"]], int(of[at[r["a"]]]), -(-least * r["score"] // 100), most * r["score"] // 100, r["id"], r["score"])
                   for r in found if r["score"] >= 0]
        if not windows:
            continue
        w = [np.array(c, dtype=np.int64) for c in list(zip(*windows))[:6]]
        wanted = []
        for s, f, t, x, y in zip(shard, first, last, lo, hi):
            under, over = intervals(a, x, y)
            if (((w[3] != f) | (f != t)) & (over[w[2]] >= w[4]) & (under[w[2]] <= w[5])).any():
                wanted.append(int(s))
        chunk = spark.sparkContext.broadcast((w, a))
        got = best_negatives(blocks.where(F.col("shard").isin(wanted)), chunk, dim, negatives)
        named = spark.createDataFrame([(x[0], x[1], int(own[x[2]]), x[6], x[7]) for x in windows],
                                      "a bigint, p bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        got = scratch.write(got.join(F.broadcast(named), ["a", "p"]).select(  # positives x ANCHORS rows
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
