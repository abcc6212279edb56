"""Deterministic pseudo-random order keys in [0, 2**32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SPAN = 1 << 32


def hash_key(seed: int, *ids: Column | str) -> Column:
    """Default order key: the upper half of a 64-bit hash of the seed and the row id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in ids]), 32)


def arithmetic_key(id_col: Column | str, seed: int = 0) -> Column:
    """Multiplicative order key of an integer id; plain arithmetic, so other engines can compute it."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod((F.pmod(c, F.lit(1 << 31)) + F.lit(seed)) * F.lit(2654435761), F.lit(KEY_SPAN))


def unit_interval(key: Column) -> Column:
    """Order key as a number in [0, 1)."""
    return key / F.lit(float(KEY_SPAN))
