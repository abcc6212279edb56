"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelsift.llm import scratch
from labelsift.session import ship_package

SAMPLE = 2_048  # vectors that set the bucket width and first bound a query's distances
CHUNK = 4_096  # vectors of a bucket that one cell holds; larger buckets are dealt to several cells
CELL = 16_384  # bucket entries of a cell, on average
QUERIES = 1_024  # queries that travel together where the rows are read instead of buckets
GRID = np.linspace(-8.0, 8.0, 8_001)
NORMAL = np.array([0.5 * (1.0 + math.erf(z / math.sqrt(2.0))) for z in GRID])


@dataclass(frozen=True)
class Tables:
    """``tables`` hash tables of ``functions`` projections on Gaussian vectors, cut into slots of ``width``."""

    tables: int = 8
    functions: int = 8
    width: float = 1.0
    seed: int = 42

    def places(self, x: np.ndarray) -> np.ndarray:
        """Coordinates ``[vector, table, function]`` in slots; the whole part names the bucket."""
        a, b = projections(x.shape[1], self.tables, self.functions, self.seed)
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.nan_to_num((x @ a) / self.width + b, nan=0.0)
        return np.clip(at, -1e15, 1e15).reshape(len(x), self.tables, self.functions)

    def keys(self, slots: np.ndarray, dim: int) -> np.ndarray:
        """64-bit names of buckets ``[.., table, .., function]``; the table and the dimension are part of the name."""
        h = np.full(slots.shape[:-1], dim, dtype=np.uint64)
        h += np.arange(self.tables, dtype=np.uint64).reshape(1, -1, *[1] * (h.ndim - 2)) << np.uint64(32)
        for j in range(self.functions):
            h = (h ^ (slots[..., j].astype(np.int64).view(np.uint64) + np.uint64(j))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


@functools.lru_cache(maxsize=16)
def projections(dim: int, tables: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * functions)), rng.uniform(size=tables * functions)


@functools.lru_cache(maxsize=4)
def steps(functions: int) -> np.ndarray:
    """Every perturbation of a bucket by -1, 0 or 1 slot in each function."""
    return np.stack(np.meshgrid(*[np.array([-1, 0, 1], dtype=np.int8)] * functions, indexing="ij"), axis=-1).reshape(-1, functions)


def success(places: np.ndarray, reach: np.ndarray, width: float) -> np.ndarray:
    """``[query, table, perturbation]``: the probability that a vector at distance ``reach`` lies in the perturbed bucket.

    Along each projection such a vector is displaced by ``reach`` times a standard normal number.
    """
    inside = places - np.floor(places)
    spread = np.maximum(reach / width, 1e-9)[:, None, None]
    edge = lambda o: np.interp((o - inside) / spread, GRID, NORMAL)
    edges = [edge(o) for o in (-1, 0, 1, 2)]
    chance = np.ones((*places.shape[:2], 1))
    for j in range(places.shape[2]):
        moved = np.stack([edges[k + 1][..., j] - edges[k][..., j] for k in range(3)], axis=-1)
        chance = (chance[..., None] * moved[:, :, None, :]).reshape(*places.shape[:2], -1)
    return chance


def probes(x: np.ndarray, reach: np.ndarray, tables: Tables, target: float, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per query the buckets to visit and the estimated share of vectors within ``reach`` that they hold.

    Each table's perturbed buckets are taken in order of estimated success, as many from every table as bring the
    estimate over all tables to ``target``, ``most`` at most.
    """
    names, reached = [], np.zeros(len(x))
    moves = steps(tables.functions)
    for lo in range(0, len(x), 16):
        places = tables.places(x[lo:lo + 16])
        chance = success(places, reach[lo:lo + 16], tables.width)
        most = min(most, chance.shape[-1])
        best = np.argpartition(-chance, most - 1, axis=-1)[..., :most]
        order = np.argsort(-np.take_along_axis(chance, best, -1), axis=-1, kind="stable")
        best = np.take_along_axis(best, order, -1)
        missed = np.prod(1.0 - np.minimum(np.cumsum(np.take_along_axis(chance, best, -1), axis=-1), 1.0), axis=1)
        enough = (missed > 1.0 - target).sum(axis=1) + 1
        keys = tables.keys(np.floor(places)[:, :, None, :] + moves[best], x.shape[1])
        for i, n in enumerate(np.minimum(enough, most)):
            names.append(keys[i, :, :n].ravel())
            reached[lo + i] = 1.0 - missed[i, n - 1]
    return names, reached


def distances(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, differences are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        d = rows - a
        out = np.sqrt((d * d).sum(axis=1))
        if (odd := np.flatnonzero(~np.isfinite(out) | (out < 1e-150))).size:
            half = rows[odd] / 2 - a / 2
            top = np.abs(half).max(axis=1)
            out[odd] = np.sqrt(((half / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1)) * top * 2
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> Column:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def by_dimension(vectors: pd.Series):
    """Rows and matrix of each dimension that occurs."""
    sizes = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, int)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.array(vectors.iloc[at].tolist(), dtype=np.float64)


def bounds(sample: dict[int, np.ndarray], dim: int, x: np.ndarray, k: int) -> np.ndarray:
    """The distance to the k-th nearest sampled vector, itself left out: no less than the true one."""
    own = sample.get(dim)
    if own is None or len(own) <= k:
        return np.full(len(x), np.inf)
    return np.array([np.partition(distances(v, own), k)[k] for v in x])


def nearest_of(x: np.ndarray, rows: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest, ties by id, of rows that each stand for a few ids."""
    d = distances(x, rows)
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    return sorted((float(d[i]), int(v)) for i in near for v in ids[i])[:k]


NEAR = "q bigint, vec_id bigint, score double"


def visited(classes: DataFrame, asked: DataFrame, entries: DataFrame, k: int, cells: int) -> DataFrame:
    """``q, vec_id, score``: the ``k`` nearest that each query of ``asked (q, v, keys)`` finds in its buckets.

    A bucket's vectors and the queries that visit it meet in a cell of many buckets; a bucket above ``CHUNK`` vectors is
    dealt to several cells and visited in all of them. Keys are joined alone; vectors move once to each of their cells.
    """
    visits = asked.select("q", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = sizes.join(visits.select("key").distinct(), "key")
    cell = lambda chunk: F.pmod(F.xxhash64("key", chunk), F.lit(cells)).cast("int").alias("cell")
    held = entries.join(sizes, "key").select("c", "key", cell(F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")))
    held = held.groupBy("c", "cell").agg(F.collect_list("key").alias("keys")).join(classes.select("c", "v", "ids"), "c")
    come = visits.join(sizes, "key").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("q", "key", cell(F.col("chunk")))
    come = come.distinct().groupBy(F.col("q"), F.col("cell").alias("at")).agg(F.collect_list("key").alias("keys"))
    come = come.join(asked.select("q", "v"), "q")

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            of = np.repeat(np.arange(len(rows)), rows["keys"].map(len))
            keys = np.concatenate(rows["keys"].to_list())
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            ids, x = rows["ids"].to_list(), {}
            for at, m in by_dimension(rows["v"]):
                place = np.full(len(rows), -1)
                place[at] = np.arange(len(at))
                x[m.shape[1]] = place, m
            for q, v, wanted in zip(queries["q"], queries["v"], queries["keys"]):
                lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                found = [of[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if a < b]
                if not found or len(v) not in x:
                    continue
                near = np.zeros(len(rows), dtype=bool)
                near[np.concatenate(found)] = True
                place, m = x[len(v)]
                near = np.flatnonzero(near & (place >= 0))
                if len(near):
                    out += [(q, i, d) for d, i in nearest_of(np.asarray(v, dtype=np.float64), m[place[near]], [ids[j] for j in near], k)]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"]).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    found = held.groupBy("cell").cogroup(come.groupBy("at")).applyInPandas(meet, NEAR)
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query over all cells or blocks."""
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.distinct().withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def scanned(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """Exact answers for ``asked (q, v)``: blocks of about ``QUERIES`` of them travel with the code and every vector is
    read once for each block, without a shuffle of vectors."""
    spark, total = classes.sparkSession, asked.count()
    blocks, out = math.ceil(total / QUERIES), None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about QUERIES rows
        block = spark.sparkContext.broadcast([(r["q"], np.array(r["v"], dtype=np.float64)) for r in mine])

        def run(batches, block=block):
            best: dict = {q: [] for q, _ in block.value}
            for batch in batches:
                for at, m in by_dimension(batch.column("v").to_pandas()):
                    ids = batch.column("ids").take(pa.array(at)).to_pylist()
                    for q, v in block.value:
                        if len(v) == m.shape[1]:
                            best[q] = sorted(best[q] + nearest_of(v, m, ids, k))[:k]
            rows = [(q, i, d) for q, found in best.items() for d, i in found]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                                             names=["q", "vec_id", "score"])

        found = scratch.write(merged(classes.select("v", "ids").mapInArrow(run, NEAR), k))
        out = found if out is None else out.unionByName(found)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.95,
           most_probes: int = 1_024, tables: int = 8, functions: int = 8, seed: int = 42) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``is_query``, their ``k`` nearest other rows by Euclidean distance.

    Every vector is entered in ``tables`` hash tables. A query first visits few buckets of each; the distance to the
    k-th vector found then says how many of the perturbed buckets, in order of estimated success, hold ``target`` of what
    lies within it. Queries that would need more than ``most_probes`` buckets a table, or have found fewer than ``k``,
    are compared with all rows, so every query has ``k`` answers where there are ``k`` other rows. All distances are exact.

    The slot width comes from a sample of 2,048 vectors by hash; every row is indexed. Equal vectors are one entry with
    their ``k + 1`` smallest ids, which is all that can be among the nearest. Rows whose id is null, and vectors that are
    null, zero or hold null or non-finite components, take no part. A row that repeats id and vector counts once; rows that
    share the query's id are not its neighbours. Vectors of other lengths than the query's are no candidates. No queries, or an empty
    table: empty result. Columns of any other name play no part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(usable(vectors, id_col, vector_col)).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: x + F.lit(0).cast("float")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    few = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    smallest = rows.withColumn("_r", few).where(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = scratch.write(smallest.withColumn("c", F.monotonically_increasing_id()))
    queries = scratch.write(rows.where("asks").select("id", "v"))
    sample: dict[int, np.ndarray] = {}
    drawn = pd.DataFrame(classes.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(SAMPLE).collect(), columns=["v"])
    for _, m in by_dimension(drawn["v"]):
        sample[m.shape[1]] = m
    reach = np.concatenate([bounds(sample, d, m[:256], min(k, max(1, len(m) - 1))) for d, m in sample.items()] or [np.ones(1)])
    reach = reach[np.isfinite(reach) & (reach > 0)]
    made = Tables(tables, functions, float(1.8 * np.median(reach)) if len(reach) else 1.0, seed)
    shared = spark.sparkContext.broadcast(sample)

    @F.pandas_udf("array<bigint>")
    def buckets(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        for at, m in by_dimension(v):
            for i, keys in zip(at, made.keys(np.floor(made.places(m)), m.shape[1])):
                out[i] = keys
        return pd.Series(out, dtype=object)

    def looks(first: int | None):
        @F.pandas_udf("keys array<bigint>, reached double")
        def look(v: pd.Series, known: pd.Series) -> pd.DataFrame:
            keys, reached = [None] * len(v), np.zeros(len(v))
            known = known.to_numpy(dtype=np.float64, na_value=np.inf)
            for at, m in by_dimension(v):
                d = np.minimum(known[at], bounds(shared.value, m.shape[1], m, k))
                wide = np.where(np.isfinite(d), d, 2.0 * made.width)
                names, r = probes(m, wide, made, target, first or most_probes)
                reached[at] = np.where(np.isfinite(d), r, 0.0)
                for i, n in zip(at, names):
                    keys[i] = n
            return pd.DataFrame({"keys": keys, "reached": reached})
        return look

    entries = scratch.write(classes.select("c", F.explode(buckets("v")).alias("key")))
    cells = max(1, math.ceil(entries.count() / CELL))
    asked = scratch.write(queries.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))
    plan = lambda df, first: scratch.write(df.withColumn("p", looks(first)("v", "known")).select("q", "v", "known", "p.*"))
    first = scratch.write(visited(classes, plan(asked.withColumn("known", F.lit(None).cast("double")), 16), entries, k + 1, cells))
    known = first.groupBy("q").agg(F.max("score").alias("known"), F.count("*").alias("found")).where(F.col("found") > k).drop("found")
    second = plan(asked.join(known, "q", "left"), None)
    sure = second.where((F.col("reached") >= target) & F.col("known").isNotNull())
    found = scratch.write(visited(classes, sure, entries, k + 1, cells)).withColumn("probed", F.lit(True))
    done = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > k).select("q")
    rest = scanned(classes, scratch.write(second.select("q", "v").join(done, "q", "left_anti")), k + 1)
    found = found.join(done, "q", "left_semi")
    if rest is not None:
        found = found.unionByName(rest.withColumn("probed", F.lit(False)))
    lists = found.groupBy("q", "probed").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = scratch.write(asked.join(lists, "q").select("v", "near", "probed"))
    out = queries.join(answers, "v").select("id", "probed", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near"))
    out = out.select(F.col("id").alias("query_id"), "probed", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), "probed")
