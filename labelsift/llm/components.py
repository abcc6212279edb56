"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.llm import scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links`` that is not the smallest of its component.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest node seen. Minima are
    partial aggregates and the joins have a plain equality key, so a node with very many links is split over
    tasks. A round is written to the shared folder; links never reach the driver.
    Nulls on either side and links of a node with itself count as no link. No links: an empty table.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = scratch.write(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(smallest.select("u", F.col("m").alias("v"))).distinct())
        after = scratch.write(small)
        scratch.drop(edges)
        edges, before = after, now
