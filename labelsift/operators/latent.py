"""Noise matrices, latent priors and posteriors, all on class-sized frames.

``nm`` holds P(s|y), ``inv`` holds P(y|s), both as ``s, y, p``; priors are ``s, p`` or ``y, p``.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.functions.probability import clip_rescale
from labelsift.operators import frames

# Bounds that must match the published definitions.
MAX_NOISE_RATE = 0.9999
PRIOR_FLOOR = 1e-5
INVERSION_PRIOR_FLOOR = 0.001
OUTER_ROUNDS, INNER_ROUNDS = 3, 5
PRIOR_METHODS = ("cnt", "eqn", "marginal", "marginal_ps")


def clip_rates(m: DataFrame, given: str, value: str = "p") -> DataFrame:
    """Clip off-diagonal rates and rescale so that each conditional distribution adds up to 1.
    ``given`` is the column the matrix conditions on."""
    c = F.when(F.col("s") == F.col("y"), F.col(value)).otherwise(
        F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(MAX_NOISE_RATE)))
    return m.withColumn(value, c).withColumn(
        value, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(given))))


def clip_prior(p: DataFrame, value: str = "p", low: float = PRIOR_FLOOR) -> DataFrame:
    return (p.withColumn(value, F.least(F.greatest(F.col(value), F.lit(low)), F.lit(1.0)))
            .withColumn(value, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy()))))


def conditional(cj: DataFrame, given: str) -> DataFrame:
    """Shares within the conditioning class; without any count the class is taken as clean."""
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy(given)).cast("double"))
    return cj.select("s", "y", F.coalesce(share, (F.col("s") == F.col("y")).cast("double")).alias("p"))


def noise_matrix(cj: DataFrame) -> DataFrame:
    """P(s|y), unclipped."""
    return conditional(cj, "y")


def inverse_noise_matrix(cj: DataFrame) -> DataFrame:
    """P(y|s), unclipped."""
    return conditional(cj, "s")


def diagonal(m: DataFrame, name: str) -> DataFrame:
    return m.where("s = y").select("s", F.col("p").alias(name))


def latent_prior(ps: DataFrame, nm: DataFrame, inv: DataFrame, method: str = "cnt",
                 cj: DataFrame | None = None) -> DataFrame:
    """``y, p``: prior of the true classes."""
    if method not in PRIOR_METHODS:
        raise ValueError(f"no way {method!r} to estimate a prior; known are {', '.join(PRIOR_METHODS)}")
    if method == "marginal":
        if cj is None:
            raise ValueError("method 'marginal' needs the confident joint")
        by_y = cj.groupBy("y").agg(F.sum("n").cast("double").alias("n"))
        raw = by_y.select("y", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())).alias("p"))
    elif method == "cnt":
        joined = frames.meet(frames.meet(ps.select("s", F.col("p").alias("ps")), diagonal(inv, "i"), "s"), diagonal(nm, "m"), "s")
        raw = joined.select(F.col("s").alias("y"), (F.try_divide(F.col("i"), F.col("m")) * F.col("ps")).alias("p"))
    elif method == "marginal_ps":
        joined = frames.meet(inv, ps.select("s", F.col("p").alias("ps")), "s")
        raw = joined.groupBy("y").agg(F.sum(F.col("p") * F.col("ps")).alias("p"))
    else:
        m, prior = to_numpy(nm), vector_to_numpy(ps, "s")
        raw = frames.vector_frame(ps.sparkSession, np.linalg.solve(m, prior), key="y")
    return clip_prior(raw)


def to_numpy(m: DataFrame, value: str = "p") -> np.ndarray:
    """K*K rows to the driver."""
    rows = m.select("s", "y", value).collect()
    k = 1 + max(r["s"] for r in rows)
    out = np.zeros((k, k))
    for r in rows:
        out[r["s"], r["y"]] = r[value]
    return out


def vector_to_numpy(v: DataFrame, key: str, value: str = "p") -> np.ndarray:
    """K rows to the driver."""
    return np.array([r[value] for r in sorted(v.select(key, value).collect(), key=lambda r: r[key])], dtype=float)


def inverse_from_noise(py: DataFrame, nm: DataFrame, ps: DataFrame | None = None) -> DataFrame:
    """Bayes: P(y|s) from P(y), P(s|y) and P(s); P(s) is the marginal of the joint if not given."""
    joint = frames.meet(nm, py.select("y", F.col("p").alias("py")), "y").select("s", "y", (F.col("p") * F.col("py")).alias("j"))
    return clip_rates(_bayes(joint, ps, "s"), given="s")


def noise_from_inverse(ps: DataFrame, inv: DataFrame, py: DataFrame | None = None) -> DataFrame:
    """Bayes: P(s|y) from P(s), P(y|s) and P(y); P(y) is the marginal of the joint if not given."""
    joint = frames.meet(inv, ps.select("s", F.col("p").alias("ps")), "s").select("s", "y", (F.col("p") * F.col("ps")).alias("j"))
    return clip_rates(_bayes(joint, py, "y"), given="y")


def _bayes(joint: DataFrame, marginal: DataFrame | None, given: str) -> DataFrame:
    if marginal is None:
        return joint.select("s", "y", F.try_divide("j", F.sum("j").over(W.partitionBy(given))).alias("p"))
    named = marginal.select(given, F.col("p").alias("_m"))
    return frames.meet(joint, named, given).select("s", "y", F.try_divide("j", "_m").alias("p"))


def prior_and_inverse(ps: DataFrame, nm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P(y) by solving P(s|y) P(y) = P(s), and P(y|s) from it."""
    solved = np.linalg.solve(to_numpy(nm), vector_to_numpy(ps, "s"))
    py = clip_prior(frames.vector_frame(nm.sparkSession, solved, key="y"), low=INVERSION_PRIOR_FLOOR)
    return py, inverse_from_noise(py, nm, ps)


def estimate_latent(cj: DataFrame, ps: DataFrame, method: str = "cnt",
                    converge: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(py, nm, inv)`` from the confident joint and the noisy prior, each of which is computed once."""
    cj, ps = frames.pinned(cj), frames.pinned(ps)
    nm, inv = noise_matrix(cj), inverse_noise_matrix(cj)
    py = latent_prior(ps, nm, inv, method, cj)
    nm, inv = clip_rates(nm, "y"), clip_rates(inv, "s")
    if not converge:
        return py, nm, inv
    spark = cj.sparkSession
    y, m, i = agree(vector_to_numpy(ps, "s"), vector_to_numpy(py, "y"), to_numpy(nm))
    return (clip_prior(frames.vector_frame(spark, y, key="y")), clip_rates(frames.matrix_frame(spark, m, "p"), "y"),
            clip_rates(frames.matrix_frame(spark, i, "p"), "s"))


def _clip_np(m: np.ndarray, axis: int) -> np.ndarray:
    out = np.where(np.eye(len(m), dtype=bool), m, np.clip(m, 0.0, MAX_NOISE_RATE))
    return out / out.sum(axis=axis, keepdims=True)


def agree(ps: np.ndarray, py: np.ndarray, nm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Make the three estimates consistent with each other by a fixed number of alternations on the
    class-sized arrays. All arrays are indexed [s, y]; P(y|s) rows add up to 1."""
    inv = nm
    for _ in range(OUTER_ROUNDS):
        for _ in range(INNER_ROUNDS):
            inv = _clip_np(nm * py[None, :] / ps[:, None], axis=1)
            py = np.clip(np.diag(inv) / np.diag(nm) * ps, PRIOR_FLOOR, 1.0)
            py = py / py.sum()
        nm = _clip_np(inv * ps[:, None] / py[None, :], axis=0)
    return py, nm, inv


def posterior_factors(nm: DataFrame, inv: DataFrame) -> DataFrame:
    """``s, f``: ratio of the diagonals, the per-class correction of a probability."""
    return frames.meet(diagonal(inv, "i"), diagonal(nm, "m"), "s").select("s", F.try_divide("i", "m").alias("f"))


def clean_posterior(probs: DataFrame, nm: DataFrame, inv: DataFrame, k: int) -> DataFrame:
    """Probability frame plus ``pyx``: P(y=k|x), corrected per class and rescaled to add up to 1."""
    factors = frames.by_class(posterior_factors(nm, inv), "s", "f", k)
    pyx = clip_rescale(F.zip_with("psx", "_f", lambda p, f: p * f))
    return probs.withColumn("_f", factors).withColumn("pyx", pyx).drop("_f")


def remove_noise_from_class(nm: DataFrame, clean: int) -> DataFrame:
    """P(s=clean|y) becomes 0 for every other y; diagonals take up the difference."""
    zeroed = nm.withColumn("p", F.when((F.col("s") == clean) & (F.col("y") != clean), 0.0).otherwise(F.col("p")))
    off = F.sum(F.when(F.col("s") != F.col("y"), F.col("p")).otherwise(0.0)).over(W.partitionBy("y"))
    return zeroed.withColumn("p", F.when(F.col("s") == F.col("y"), F.lit(1.0) - off).otherwise(F.col("p")))


def pu_constrain(m: DataFrame, clean: int, kind: str) -> DataFrame:
    """Two classes, one of them without errors. ``kind`` is 'nm', 'inv' or 'joint'.

    The cell (given=clean, true=other) becomes 0. In a noise matrix the other class keeps probability
    1; in an inverse matrix the clean class does; in the joint the other diagonal count becomes 1.
    """
    value = "n" if kind == "joint" else "p"
    sure = clean if kind == "inv" else 1 - clean
    one = (F.col("s") == sure) & (F.col("y") == sure)
    zero = (F.col("s") == clean) & (F.col("y") == 1 - clean)
    kept = F.col(value)
    number = "bigint" if kind == "joint" else "double"
    return m.withColumn(value, F.when(one, F.lit(1).cast(number)).when(zero, F.lit(0).cast(number)).otherwise(kept))


def unlabelled_noise_share(inv: DataFrame, clean: int) -> DataFrame:
    """Share of the unlabelled class that truly belongs to the clean class."""
    return inv.where((F.col("s") == 1 - clean) & (F.col("y") == clean)).select("p")


def learnable(nm: DataFrame, py: DataFrame) -> DataFrame:
    """One row ``is_valid``: the joint adds up to 1 and every diagonal beats independence."""
    joint = frames.meet(nm, py.select("y", F.col("p").alias("py")), "y").select("s", "y", "py", (F.col("p") * F.col("py")).alias("j"))
    joint = joint.withColumn("ps", F.sum("j").over(W.partitionBy("s")))
    holds = F.bool_and(F.when(F.col("s") == F.col("y"), F.col("ps") * F.col("py") < F.col("j")))
    return joint.agg(((F.abs(F.sum("j") - 1.0) < 1e-6) & holds).alias("is_valid"))


def matrix_report(m: DataFrame, k: int, value: str = "p", places: int = 2, rows: str = "s") -> DataFrame:
    """Readable square form: one row per ``rows`` class, one column per other class, and the trace."""
    cols = "y" if rows == "s" else "s"
    trace = m.where("s = y").agg(F.round(F.sum(value), places)).scalar()
    wide = m.groupBy(rows).pivot(cols, list(range(k))).agg(F.round(F.first(value), places))
    return wide.select(rows, *[F.col(str(c)).alias(f"{cols}_{c}") for c in range(k)], trace.alias("trace"))


def sample_weights(nm: DataFrame, k: int, default: float = 40.0) -> Column:
    """Weight per given class as an array column: 1 / P(s=k|y=k), ``default`` if undefined."""
    inverse = F.try_divide(F.lit(1.0), F.col("p"))
    w = F.when(inverse.isNull() | F.isnan(inverse), F.lit(default)).otherwise(inverse)
    return frames.by_class(nm.where("s = y").select("s", w.alias("w")), "s", "w", k)
