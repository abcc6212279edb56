"""From a joint to flagged rows: prune counts, exact cuts, masks, ordering, pruning and flipping.

Counts are long ``s, y, n`` frames (given label s, true label y; ``class_n`` rows of s). Cuts are class-sized and reach the
scan of the probability frame as array constants, so flagging is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.functions.probability import (agrees, argmax_class, self_confidence)
from labelsift.operators import cuts, frames, joint, multilabel, rank
from labelsift.operators.joint import round_keeping_totals
from labelsift.session import settle

# Fixed value: rows every class keeps; smaller classes are left alone.
MIN_ROWS_PER_CLASS = 5
METHODS = ("prune_by_noise_rate", "prune_by_class", "both")

# Cells of a counting pass over the margins of all blocks: what a task sends at most.
BLOCK_CELLS = 20_000


def _split(m: DataFrame) -> tuple[Column, Column]:
    return F.col("s") == F.col("y"), W.partitionBy("s")


def keep_at_least(counts: DataFrame, n: int = MIN_ROWS_PER_CLASS, frac_noise: float = 1.0) -> DataFrame:
    """Raise each diagonal count to n, taking the difference evenly from the class's other cells;
    then apply ``frac_noise``."""
    on, w = _split(counts)
    diag = F.max(F.when(on, F.col("n"))).over(w)
    nonzero = F.count_if(F.col("n") != 0).over(w)
    raised = counts.withColumn("_add", F.greatest(F.lit(n) - diag, F.lit(0))).withColumn(
        "_cells", F.greatest(nonzero - 1, F.lit(1)))
    x = F.when(on, F.col("n") + F.col("_add")).otherwise(
        F.greatest(F.col("n") - F.col("_add") / F.col("_cells"), F.lit(0.0))).cast("double")
    return reduce_counts(raised.withColumn("n", x).drop("_add", "_cells"), frac_noise)


def reduce_counts(counts: DataFrame, frac_noise: float = 1.0) -> DataFrame:
    """Scale the off-diagonal cells, give the difference to the class's diagonal, drop fractions."""
    on, w = _split(counts)
    x = F.col("n").cast("double")
    off = F.when(on, 0.0).otherwise(x)
    freed = F.sum(off - off * frac_noise).over(w)
    out = counts.withColumn("_x", F.when(on, x + freed).otherwise(x * frac_noise))
    return out.withColumn("n", F.floor("_x").cast("bigint")).drop("_x")


def removal_budget(counts: DataFrame, budget: list[float]) -> DataFrame:
    """Rescale the noise of each true class to a requested number of removals.

    Shares divide by the true-class total found at the given label's index; budgets go by true class.
    A class without noise gets no removals off the diagonal.
    """
    b = F.array(*[F.lit(float(v)) for v in budget])
    totals = counts.groupBy("y").agg(F.sum("n").cast("double").alias("_t")).select(F.col("y").alias("s"), "_t")
    size = counts.where("s = y").select("y", F.col("class_n").alias("_size"))
    m = counts.join(F.broadcast(totals), "s").join(F.broadcast(size), "y")  # K rows each
    m = m.withColumn("_q", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_t")), F.lit(0.0)))
    on = F.col("s") == F.col("y")
    m = m.withColumn("_noise", F.sum(F.when(on, 0.0).otherwise(F.col("_q"))).over(W.partitionBy("y")))
    want = F.element_at(b, F.col("y") + 1)
    x = F.when(on, F.col("_size") - want).otherwise(
        F.coalesce(F.try_divide(F.col("_q") * want, F.col("_noise")), F.lit(0.0)))
    out = round_keeping_totals(m.withColumn("_x", x.cast("double")), "_x", row="y", col="s")
    return out.withColumn("n", F.col("_x").cast("bigint")).select("s", "y", "n", "class_n")


def prune_counts(cj: DataFrame, frac_noise: float = 1.0, budget: list[float] | None = None) -> DataFrame:
    """``s, y, n, class_n``: rows to flag (off the diagonal) and to keep (on it)."""
    counts = keep_at_least(cj.select("s", "y", "n", "class_n"), MIN_ROWS_PER_CLASS, frac_noise)
    return counts if budget is None else removal_budget(counts, budget)


def _labels(multi_label: bool) -> Column:
    return F.array_distinct("s") if multi_label else F.array("s")


def wanted_cuts(counts: list, sizes: dict[int, int], method: str) -> list[dict]:
    """What ``cuts.largest`` has to find. Per (given k, other j): the margin of the n-th row to flag. Per given k: the
    (m+1)-th smallest own probability, m being the rows to flag. Classes of few rows are left alone."""
    large = {k: n for k, n in sizes.items() if n > MIN_ROWS_PER_CLASS}
    wanted = []
    if method != "prune_by_class":
        wanted += [{"s": r["s"], "y": r["y"], "m": min(r["n"], large[r["s"]])} for r in counts
                   if r["s"] != r["y"] and r["n"] > 0 and r["s"] in large]
    if method != "prune_by_noise_rate":
        kept = {r["s"]: r["n"] for r in counts if r["s"] == r["y"]}
        wanted += [{"s": k, "y": k, "m": n - kept.get(k, 0) + 1} for k, n in large.items() if 0 < n - kept.get(k, 0) < n]
    return wanted


def block_cuts(probs: DataFrame, wanted: list[dict], k: int, cells: int = BLOCK_CELLS) -> list[dict]:
    """``cuts.largest`` where every row has the probabilities of its own block of K classes only: a row has K margins however many
    blocks there are, and counting passes over narrower brackets find the cuts of all blocks together."""
    if not wanted:
        return []
    own, same = F.element_at("psx", F.col("s") + 1), {w["s"] == w["y"] for w in wanted}
    margins = [F.struct(joint.class_of_block(k, F.lit(j)).alias("y"), F.when(F.col("s") == j, -own).otherwise(F.element_at("psx", j + 1) - own).alias("v"))
               for j in range(k)]
    values = probs.select(joint.class_of_block(k).alias("s"), F.inline(F.array(*margins))).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if len(same) == 1:
        values = values.where((F.col("s") == F.col("y")) == F.lit(same.pop()))
    return rank.nth_largest(values, ["s", "y"], "v", wanted, (-1.0, 1.0), cells=cells)


def _place(label: Column, k: int, blocks: int | None) -> Column:
    """Where the cuts of a label stand in an array over all classes."""
    return (label if blocks is None else joint.class_of_block(k, label)) + 1


def flag_by_noise_rate(probs: DataFrame, found: list[dict], k: int, multi_label: bool, name: str, blocks: int | None = None) -> DataFrame:
    """Flag rows at or above any of their margin cuts, ties included."""
    if not found:
        return probs.withColumn(name, F.lit(False))
    table: list[list] = [[None] * k for _ in range(k * (blocks or 1))]
    for c in found:
        table[c["s"]][c["y"] % k] = c["cut"]
    by_pair = frames.constant_array(probs.sparkSession, table)
    over = F.exists(_labels(multi_label), lambda g: F.exists(
        F.zip_with("psx", F.element_at("_cuts", _place(g, k, blocks)),
                   lambda p, c: F.coalesce(p - F.element_at("psx", g + 1) >= c, F.lit(False))), lambda hit: hit))
    return probs.withColumn("_cuts", by_pair).withColumn(name, F.coalesce(over, F.lit(False))).drop("_cuts")


def flag_by_class(probs: DataFrame, found: list[dict], k: int, multi_label: bool, name: str, blocks: int | None = None) -> DataFrame:
    """Flag rows strictly below the cut of any of their labels."""
    if not found:
        return probs.withColumn(name, F.lit(False))
    table = [None] * (k * (blocks or 1))
    for c in found:
        table[c["s"]] = c["cut"]
    by_class = frames.constant_array(probs.sparkSession, table)
    if multi_label:
        under = F.exists(F.array_distinct("s"), lambda g: F.coalesce(
            F.element_at("psx", g + 1) < F.element_at("_cuts", g + 1), F.lit(False)))
    else:
        under = F.coalesce(F.element_at("psx", F.col("s") + 1) < F.element_at("_cuts", _place(F.col("s"), k, blocks)), F.lit(False))
    return probs.withColumn("_cuts", by_class).withColumn(name, under).drop("_cuts")


def find_label_errors(probs: DataFrame, k: int, cj: DataFrame | None = None,
                      method: str = "prune_by_noise_rate", frac_noise: float = 1.0,
                      budget: list[float] | None = None, multi_label: bool = False,
                      thresholds=None, keep: str = "persist", blocks: int | None = None) -> DataFrame:
    """Probability frame plus ``is_error``.

    ``probs`` is read several times (joint, cuts, mask); ``keep`` says how to hold on to it, see
    ``session.settle``. Rows whose most probable class equals their label are never flagged.

    With ``blocks`` these are so many problems of K classes in the same jobs: ``probs`` has ``block`` as well, and each block is judged
    on its own (see ``joint.block_joint``).
    """
    if method not in METHODS:
        raise ValueError(f"method {method} should be in {list(METHODS)}")
    if blocks is not None and (cj is not None or multi_label or thresholds is not None or budget is not None):
        raise ValueError("blocks have one label a row and a joint of their own")
    probs = settle(probs, keep)
    if blocks is not None:
        cj = joint.block_joint(probs, k, blocks)
    elif cj is None:
        build = joint.multilabel_joint if multi_label else joint.confident_joint
        cj = build(probs, k, thresholds)
    elif "class_n" not in cj.columns:
        n = (joint.label_list_counts if multi_label else joint.class_counts)(probs, k)
        cj = cj.select("s", "y", "n").join(F.broadcast(n.select("s", F.col("n").alias("class_n"))), "s")  # K rows
    counts = [r.asDict() for r in prune_counts(cj, frac_noise, budget).collect()]  # K*K rows, of each block
    sizes = {r["s"]: r["class_n"] for r in counts}
    base, flags = probs, []
    wanted = wanted_cuts(counts, sizes, method)
    found = cuts.largest(probs, wanted, k, multi_label) if blocks is None else block_cuts(probs, wanted, k)
    if method in ("prune_by_noise_rate", "both"):
        probs = flag_by_noise_rate(probs, [c for c in found if c["s"] != c["y"]], k, multi_label, "_rate", blocks)
        flags.append("_rate")
    if method in ("prune_by_class", "both"):
        own = [{"s": c["s"], "cut": -c["cut"]} for c in found if c["s"] == c["y"]]
        probs = flag_by_class(probs, own, k, multi_label, "_class", blocks)
        flags.append("_class")
    if multi_label:
        probs = probs.withColumn("_cut", multilabel.best_boundary(base, k))
        flagged = ~multilabel.predicts_exactly("psx", "s", F.col("_cut"), k)
    else:
        flagged = ~agrees("psx", "s")
    for f in flags:
        flagged = flagged & F.col(f)
    return probs.withColumn("is_error", flagged).drop("_cut", *flags)


def argmax_errors(probs: DataFrame) -> DataFrame:
    """Baseline: error when the most probable class is not the given label."""
    return probs.withColumn("is_error", argmax_class("psx") != F.col("s"))


def argmax_joint_errors(probs: DataFrame, k: int, calibrate: bool = False,
                        method: str = "prune_by_noise_rate", keep: str = "persist") -> DataFrame:
    """Baseline: the usual pruning on the joint of arg max and given label."""
    probs = settle(probs, keep)
    return find_label_errors(probs, k, joint.argmax_joint(probs, k, calibrate), method, keep="none")


def error_score(order_by: str = "normalized_margin", multi_label: bool = False) -> Column:
    own = self_confidence("psx", "s" if multi_label else F.array("s"))
    if order_by == "prob_given_label":
        return own
    if order_by == "normalized_margin":
        return own - F.array_max("psx")
    raise ValueError(f"cannot order by {order_by}")


def order_label_errors(flagged: DataFrame, order_by: str = "normalized_margin", multi_label: bool = False,
                       with_rank: bool = True, score_places: int | None = None) -> DataFrame:
    """Flagged rows, worst first, by score then id."""
    score = error_score(order_by, multi_label)
    if score_places is not None:
        score = F.round(score, score_places)
    errors = flagged.where("is_error").withColumn("score", score)
    if not with_rank:
        return errors.orderBy("score", "id")
    return rank.global_rank(errors, [F.col("score"), F.col("id")])


def prune_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(~F.col("is_error"))


def flip_labels(flagged: DataFrame, k: int) -> DataFrame:
    """Two classes: flagged rows take the other label. More classes: prune instead."""
    if k != 2:
        return prune_rows(flagged)
    return flagged.withColumn("s", F.when(F.col("is_error"), 1 - F.col("s")).otherwise(F.col("s")))
