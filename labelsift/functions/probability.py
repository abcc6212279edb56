"""Row expressions over a probability array ``psx`` (one entry per class)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(values: Column | str, k: int) -> list[Column]:
    """The K entries of an array as separate columns."""
    return [F.element_at(values, i + 1) for i in range(k)]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def argmax_class(psx: Column | str) -> Column:
    """0-based class with the largest probability; the first one on ties."""
    return (F.array_position(psx, F.array_max(psx)) - 1).cast("int")


def prob_of(psx: Column | str, s: Column) -> Column:
    """Probability of one class."""
    return F.element_at(psx, s + 1)


def self_confidence(psx: Column | str, labels: Column | str) -> Column:
    """Mean probability over a list of given labels."""
    picked = F.transform(labels, lambda k: F.element_at(psx, k + 1))
    return F.aggregate(picked, F.lit(0.0), lambda acc, p: acc + p) / F.size(labels)


def array_total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def clip_rescale(values: Column | str, low: float = 0.0, high: float = 1.0, total: float | None = 1.0) -> Column:
    """Clip every entry to [low, high], then scale so that the entries add up to ``total``
    (to their former sum if ``total`` is None)."""
    clipped = F.transform(values, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))
    goal = F.lit(total) if total is not None else array_total(values)
    # One-element array: names the clipped entries and their sum, so that neither is worked out per entry.
    parts = F.array(F.struct(clipped.alias("v"), array_total(clipped).alias("t"), goal.alias("g")))
    return F.element_at(F.transform(parts, lambda x: F.transform(x.v, lambda v: F.try_divide(v * x.g, x.t))), 1)


def agrees(psx: Column | str, s: Column | str) -> Column:
    """True when the most probable class is the given label."""
    return argmax_class(psx) == F.col(s) if isinstance(s, str) else argmax_class(psx) == s


def at_least(p: Column | str, threshold: float | Column) -> Column:
    """0/1 prediction ``p >= threshold``."""
    p = F.col(p) if isinstance(p, str) else p
    return (p >= threshold).cast("int")


def in_top_k(psx: Column | str, s: Column | str, k: int) -> Column:
    """True when the label is one of the k most probable classes (lower class first on ties)."""
    n = F.size(psx)
    pairs = F.zip_with(psx, F.sequence(F.lit(0), n - 1),
                       lambda p, c: F.struct((-p).alias("neg"), c.alias("c")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: x.c)
    return F.array_contains(best, F.col(s) if isinstance(s, str) else s)
