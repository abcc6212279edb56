"""The two frame shapes every operator uses, and lookups from small tables.

Probability frame: ``id, s INT, psx ARRAY<DOUBLE>`` (``s ARRAY<INT>`` for several labels per row).
Matrix frame: one row per class pair, ``s, y`` and a value; K*K rows, so its size is set by the
number of classes and not by the data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_probs(df: DataFrame, id_col: str, label_col: str, psx_col: str, *keep: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("s"),
                     F.col(psx_col).cast("array<double>").alias("psx"), *keep)


def num_classes(probs: DataFrame, k: int | None = None) -> int:
    """K as given, else the width of the probability arrays."""
    return k if k is not None else probs.select(F.max(F.size("psx"))).first()[0]


def class_range(spark: SparkSession, k: int) -> DataFrame:
    return spark.range(k, numPartitions=1).select(F.col("id").cast("int").alias("s"))


def pair_grid(spark: SparkSession, k: int, blocks: int = 1) -> DataFrame:
    """All K*K class pairs, of each block of K classes, from a range (no join)."""
    s = (F.col("id") / k).cast("int")
    return spark.range(blocks * k * k, numPartitions=1).select(s.alias("s"), (s - s % k + F.col("id") % k).cast("int").alias("y"))


def local_frame(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """Class-sized driver values as a local relation: known size, no job, no Python worker."""
    return spark.createDataFrame(pa.table({n: pa.array(v, t) for n, (t, v) in columns.items()}))


def matrix_frame(spark: SparkSession, rows, value: str = "n") -> DataFrame:
    """Long frame of a nested list."""
    kind, cast = (pa.int64(), int) if value == "n" else (pa.float64(), float)
    cells = [(i, j, cast(v)) for i, row in enumerate(rows) for j, v in enumerate(row)]
    return local_frame(spark, {"s": (pa.int32(), [c[0] for c in cells]), "y": (pa.int32(), [c[1] for c in cells]),
                               value: (kind, [c[2] for c in cells])})


def vector_frame(spark: SparkSession, values, key: str = "s", value: str = "p") -> DataFrame:
    return local_frame(spark, {key: (pa.int32(), list(range(len(values)))), value: (pa.float64(), [float(v) for v in values])})


def constant_array(spark: SparkSession, values: list) -> Column:
    """Driver values, a list or a list of lists of numbers, as an array constant."""
    nested = bool(values) and isinstance(values[0], list)
    kind = pa.list_(pa.list_(pa.float64())) if nested else pa.list_(pa.float64())
    return local_frame(spark, {"v": (kind, [values])}).scalar()


def pinned(small: DataFrame) -> DataFrame:
    """A class-sized frame (K*K rows at most) taken once and held as a local relation in one partition: what is derived from it
    neither reads the large side again nor needs an exchange."""
    return small.sparkSession.createDataFrame(small.toArrow()).coalesce(1)


def meet(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Join of class-sized frames. Where both are in one partition already, it takes neither an exchange nor a broadcast."""
    return a.join(b.hint("merge"), on)


def by_class(small: DataFrame, key: str, value: str, k: int) -> Column:
    """A K-row table as one array column, indexed by class, for use in any row expression.

    It becomes a scalar subquery: computed once, then a constant in the scan of the large side. No
    join and no shuffle of the large side. Classes without a row are null.
    """
    packed = small.where(F.col(key).isNotNull()).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col(key).cast("int").alias("k"), F.col(value).alias("v")))).alias("m"))
    dense = packed.select(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                      lambda c: F.try_element_at("m", c)).alias("v"))
    return dense.scalar()


def by_pair(small: DataFrame, outer: str, inner: str, value: str, k: int) -> Column:
    """A K*K-row table as one nested array column indexed ``[outer][inner]``; see ``by_class``."""
    rows = small.groupBy(outer).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col(inner).cast("int").alias("k"), F.col(value).alias("v")))).alias("m"))
    dense = rows.select(F.col(outer), F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                                  lambda c: F.try_element_at("m", c)).alias("v"))
    return by_class(dense, outer, "v", k)
