"""Class counts, confidence thresholds and the confident joint."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.functions.multilabel import to_onehot
from labelsift.functions.probability import argmax_class, prob_of
from labelsift.operators import frames

# Fixed value: slack below a threshold that still counts as confident.
THRESHOLD_SLACK = 1e-6


def class_counts(df: DataFrame, k: int, label: str = "s") -> DataFrame:
    """``s, n`` for every class 0..K-1, zeros included. One map-side combined aggregation."""
    zeros = frames.class_range(df.sparkSession, k).select("s", F.lit(0).cast("bigint").alias("n"))
    rows = df.select(F.col(label).cast("int").alias("s"), F.lit(1).cast("bigint").alias("n"))
    return rows.unionByName(zeros).groupBy("s").agg(F.sum("n").alias("n")).repartition(1)  # K rows


def label_list_counts(df: DataFrame, k: int, labels: str = "s") -> DataFrame:
    """Class counts over label lists: a row counts once for each of its labels."""
    return class_counts(df.select(F.explode(labels).alias("s")), k)


def prior(counts: DataFrame) -> DataFrame:
    """``s, n, p``: share of each class."""
    return counts.select("s", "n", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())).alias("p"))


def imbalance_ratio(counts: DataFrame) -> DataFrame:
    """Count of class 0 over count of class 1."""
    n0, n1 = (F.sum(F.when(F.col("s") == c, F.col("n"))) for c in (0, 1))
    return counts.agg(n0.alias("n0"), n1.alias("n1"), F.try_divide(n0, n1).alias("ratio"))


def class_thresholds(probs: DataFrame, overrides: dict[int, float] | None = None) -> DataFrame:
    """``s, t``: mean self-probability of each class, with optional fixed values per class."""
    t = probs.groupBy("s").agg(F.avg(prob_of("psx", F.col("s"))).alias("t"))
    if overrides:
        fixed = F.lit(None).cast("double")
        for c, v in overrides.items():
            fixed = F.when(F.col("s") == c, F.lit(float(v))).otherwise(fixed)
        t = t.select("s", F.coalesce(fixed, "t").alias("t"))
    return t


def multilabel_thresholds(probs: DataFrame) -> DataFrame:
    """``s, t``: mean probability of class k over the rows whose label list holds k."""
    return (probs.select("psx", F.explode(F.array_distinct("s")).alias("s"))
            .groupBy("s").agg(F.avg(prob_of("psx", F.col("s"))).alias("t")))


def threshold_array(probs: DataFrame, k: int, thresholds=None, multi_label: bool = False) -> Column:
    """Thresholds as one array column: a list of K numbers, an ``s, t`` frame, or computed."""
    if isinstance(thresholds, (list, tuple)):
        return F.array(*[F.lit(float(t)) for t in thresholds])
    if thresholds is None:
        thresholds = multilabel_thresholds(probs) if multi_label else class_thresholds(probs)
    return frames.by_class(thresholds, "s", "t", k)


def true_label_guess(psx: Column | str, thresholds: Column | str, k: int) -> Column:
    """Confident class of a row: null without any, the most probable class when several qualify."""
    confident = F.zip_with(psx, thresholds, lambda p, t: F.coalesce(p >= t - THRESHOLD_SLACK, F.lit(False)))
    # A one-element array names the flags and the array, so that the thresholds are read once per row.
    named = F.array(F.struct(confident.alias("c"), (F.col(psx) if isinstance(psx, str) else psx).alias("p")))
    n = lambda x: F.size(F.filter(x.c, lambda c: c))
    guess = F.transform(named, lambda x: F.when(n(x) == 1, (F.array_position(x.c, F.lit(True)) - 1).cast("int")).when(n(x) > 1, argmax_class(x.p)))
    return F.element_at(guess, 1)


def guesses(probs: DataFrame, k: int, thresholds=None) -> DataFrame:
    """Probability frame plus ``guess``."""
    t = threshold_array(probs, k, thresholds)
    return probs.withColumn("_t", t).withColumn("guess", true_label_guess("psx", "_t", k)).drop("_t")


def count_cells(pairs: DataFrame, k: int, blocks: int = 1) -> DataFrame:
    """``s, y, n, class_n`` over the full grid from rows ``(s, y)``, or over the grid of each block of K classes; a null ``y`` counts
    for the class but for no cell. Zero cells join the aggregation, so one shuffle of K*K partial sums
    is all there is."""
    spark = pairs.sparkSession
    zeros = frames.pair_grid(spark, k, blocks).select("s", "y", F.lit(0).cast("bigint").alias("n"))
    rows = pairs.select("s", "y", F.lit(1).cast("bigint").alias("n"))
    # K*K rows in one partition: no window or join on them needs another exchange
    cells = rows.unionByName(zeros).groupBy("s", "y").agg(F.sum("n").alias("n")).repartition(1)
    w = W.partitionBy("s")
    return cells.withColumn("class_n", F.sum("n").over(w)).where(F.col("y").isNotNull())


def confusion_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Confusion counts of any two label columns over the labels seen: true on ``s``, predicted on ``y``."""
    return df.groupBy(F.col(true).alias("s"), F.col(pred).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def confusion_report(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """Wide form, one row per true label and one column per predicted label."""
    return df.groupBy(F.col(true).alias("s")).pivot(pred, labels).count().na.fill(0)


def confident_joint(probs: DataFrame, k: int, thresholds=None, calibrate: bool = True) -> DataFrame:
    """``s, y, n, class_n``: rows of given label s that confidently look like y."""
    cells = count_cells(guesses(probs, k, thresholds).select("s", F.col("guess").alias("y")), k)
    return calibrated(cells) if calibrate else cells


def class_of_block(k: int, label: Column | str = "s") -> Column:
    """The number of a label among the classes of all blocks: block b has the classes ``k b`` to ``k b + k - 1``."""
    return (F.col("block") * k + (F.col(label) if isinstance(label, str) else label)).cast("int")


def block_joint(probs: DataFrame, k: int, blocks: int, calibrate: bool = True) -> DataFrame:
    """The confident joints of many problems of K classes in the same jobs: ``s, y, n, class_n`` with classes as in ``class_of_block``, K*K
    cells a block. ``probs`` has ``block`` (0 .. blocks - 1) as well, ``s`` and ``psx`` being those of the row's own block."""
    own = probs.select("block", "s", "psx")
    t = own.groupBy(class_of_block(k).alias("c")).agg(F.avg(prob_of("psx", F.col("s"))).alias("t"))
    of_block = own.withColumn("_t", frames.by_class(t, "c", "t", k * blocks)).withColumn("_t", F.slice("_t", F.col("block") * k + 1, k))
    guessed = of_block.withColumn("_y", true_label_guess("psx", "_t", k))
    cells = count_cells(guessed.select(class_of_block(k).alias("s"), class_of_block(k, "_y").alias("y")), k, blocks)
    return calibrated(cells) if calibrate else cells


def prior_forcing_joints(probs: DataFrame, k: int, thresholds: list[float] | None = None, rounds: int = 5, rate: float = 0.5) -> list[DataFrame]:
    """The calibrated joints of ``rounds`` countings, each under thresholds moved by ``rate`` times what the last joint's share of every
    given class is off the class's share of the rows. The last one is the result.

    K*K numbers come to the driver for each round. As calibration keeps the class counts, shares are off by rounding only, and
    all joints are equal; the loop is kept for users of the older estimate.
    """
    counts = {r["s"]: r["n"] for r in class_counts(probs, k).collect()}
    total = sum(counts.values())
    if thresholds is None:
        mean = {r["s"]: r["t"] for r in class_thresholds(probs).collect()}
        thresholds = [mean.get(c) for c in range(k)]  # None: no row, so never confident
    out = []
    for _ in range(rounds):
        joint = frames.pinned(confident_joint(probs, k, [float("inf") if t is None else t for t in thresholds]))
        out.append(joint)
        cells = joint.groupBy("s").agg(F.sum("n").alias("n")).collect()
        all_cells = sum(r["n"] for r in cells)
        share = {r["s"]: r["n"] / all_cells for r in cells} if all_cells else {}
        thresholds = [None if t is None else t + rate * (share.get(c, 0.0) - counts[c] / total) for c, t in enumerate(thresholds)]
    return out


def multilabel_joint(probs: DataFrame, k: int, thresholds=None, calibrate: bool = True) -> DataFrame:
    """Joint over label lists: every (given label, class above its threshold) pair counts."""
    t = threshold_array(probs, k, thresholds, multi_label=True)
    hits = probs.withColumn("_t", t).select(
        F.explode(F.array_distinct("s")).alias("s"),
        F.filter(F.transform(F.zip_with("psx", "_t", lambda p, t: F.coalesce(p >= t, F.lit(False))),
                             lambda hit, i: F.when(hit, i.cast("int"))), lambda i: i.isNotNull()).alias("ys"))
    cells = count_cells(hits.select("s", F.explode("ys").alias("y")), k).drop("class_n")
    counts = label_list_counts(probs, k).select("s", F.col("n").alias("class_n"))
    cells = frames.meet(cells, counts, "s")
    return calibrated(cells) if calibrate else cells


def argmax_joint(probs: DataFrame, k: int, calibrate: bool = False) -> DataFrame:
    """The joint with the plain arg max as the guess."""
    cells = count_cells(probs.select("s", argmax_class("psx").alias("y")), k)
    return calibrated(cells) if calibrate else cells


def calibrated(cells: DataFrame) -> DataFrame:
    """Scale rows to the class counts, then round keeping the row totals. A class without any
    confident row is taken as clean: its whole count goes to the diagonal."""
    w = W.partitionBy("s")
    total = F.sum("n").over(w)
    x = F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")),
                   (F.col("s") == F.col("y")).cast("double")) * F.col("class_n")
    scaled = cells.select("s", "y", x.alias("x"), "class_n")
    return round_keeping_totals(scaled, "x", row="s", col="y").select("s", "y", F.col("x").alias("n"), "class_n")


def round_keeping_totals(m: DataFrame, value: str, row: str, col: str) -> DataFrame:
    """Round a matrix column to integers so that every row keeps its (rounded) total.

    Half-even rounding first; the missing units go to the cells rounded down the most, surplus units
    come off the cells rounded up the most.
    """
    w = W.partitionBy(row)
    x = F.col(value)
    base = F.bround(x, 0)
    m = m.withColumn("_base", base).withColumn("_frac", x - base)
    m = m.withColumn("_gap", F.bround(F.sum(x).over(w), 0) - F.sum("_base").over(w))
    up = F.row_number().over(w.orderBy(F.col("_frac").desc(), F.col(col).desc())) <= F.col("_gap")
    down = F.row_number().over(w.orderBy(F.col("_frac").asc(), F.col(col).asc())) <= -F.col("_gap")
    fixed = F.col("_base") + F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0)
    return m.withColumn(value, fixed.cast("bigint")).drop("_base", "_frac", "_gap")


def joint_distribution(cj: DataFrame) -> DataFrame:
    """``s, y, p``: the joint as shares that add up to 1."""
    return cj.select("s", "y", F.try_divide(F.col("n").cast("double"),
                                            F.sum("n").over(W.partitionBy()).cast("double")).alias("p"))


def num_label_errors(cj: DataFrame, n_rows: DataFrame | int | None = None) -> DataFrame:
    """Number of label errors: the off-diagonal share of the rows, truncated.

    ``n_rows`` defaults to the class counts carried by the joint.
    """
    on = F.col("s") == F.col("y")
    p = F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy()).cast("double"))
    rows = cj.select("s", "y", p.alias("p"), (F.col("class_n") if n_rows is None else F.lit(0)).alias("class_n"))
    share = rows.agg(F.sum(F.when(on, F.col("p"))).alias("trace"), F.sum(F.when(on, F.col("class_n"))).alias("rows"))
    if n_rows is None:
        n = F.col("rows")
    elif isinstance(n_rows, int):
        n = F.lit(n_rows)
    else:
        n = n_rows.agg(F.count(F.lit(1))).scalar()
    return share.select(F.floor((F.lit(1.0) - F.col("trace")) * n).cast("bigint").alias("num_errors"))


def off_diagonal_rows(probs: DataFrame, k: int, thresholds=None) -> DataFrame:
    """Rows whose confident guess differs from the given label."""
    return guesses(probs, k, thresholds).where("guess is not null and guess <> s")


def onehot_frame(probs: DataFrame, k: int) -> DataFrame:
    return probs.withColumn("onehot", to_onehot("s", k))
