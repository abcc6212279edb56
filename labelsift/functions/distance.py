"""Vector distances on plain arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column | str, v: Column | str) -> Column:
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(u: Column | str, v: Column | str) -> Column:
    """1 - u.v / (|u| |v|); null when either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(u, v), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))


def euclidean_distance(u: Column | str, v: Column | str) -> Column:
    squares = F.zip_with(u, v, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance}
