"""Input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_probs(probs: DataFrame, k: int, multi_label: bool = False) -> None:
    """One aggregate pass; raises ValueError when any row breaks the contract."""
    labels = F.col("s") if multi_label else F.array("s")
    bad_p = F.exists("psx", lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    bad_s = F.exists(labels, lambda c: c.isNull() | (c < 0) | (c >= k))
    row = probs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("psx").isNull() | (F.size("psx") != k)).alias("width"),
        F.count_if(bad_p).alias("p"),
        F.count_if(bad_s | F.col("s").isNull()).alias("s"),
    ).first()
    if row["n"] == 0:
        raise ValueError("no rows")
    if row["width"]:
        raise ValueError(f"{row['width']} rows do not have {k} probabilities")
    if row["p"]:
        raise ValueError(f"{row['p']} rows have probabilities outside [0, 1]")
    if row["s"]:
        raise ValueError(f"{row['s']} rows have labels outside 0..{k - 1}")


def check_trace(matrix: DataFrame, name: str, value: str = "p") -> None:
    """A noise matrix is admissible only if its trace exceeds 1."""
    trace = matrix.where("s = y").agg(F.sum(value)).first()[0]
    if trace is None or trace <= 1:
        raise ValueError(f"the diagonal of {name} adds up to {round(trace or 0.0, 2)}; it must exceed 1")
