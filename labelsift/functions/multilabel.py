"""One-hot and label-list conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_onehot(labels: Column | str, k: int) -> Column:
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda c: F.array_contains(labels, c).cast("tinyint"))


def from_onehot(onehot: Column | str) -> Column:
    marked = F.transform(onehot, lambda v, i: F.when(v == 1, i.cast("int")))
    return F.filter(marked, lambda v: v.isNotNull())
