"""Order statistics, first-m cuts, running totals and ranks that hold when one group has most rows.

A window partitioned by class would put a class into one task. The operators here never do that:

* ``nth_largest``: exact order statistics by counting passes over ever narrower value brackets. Each
  pass is a map-side combined aggregation; only one row per group and pass reaches the driver.
* ``first_rows``: the exact first m rows of each group along a pseudo-random key, as a cut on the key:
  rows are then chosen by a comparison, without a shuffle of the rows.
* ``running_totals``: exact cumulative sums along a value: totals per value first, then prefix sums in
  two levels over ranges cut at quantiles of the distinct values.
* ``global_rank``: exact rank along any unique ordering, by a distributed sort.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from labelsift.functions.ordering import KEY_SPAN
from labelsift.operators import frames
from labelsift.session import settle

# Cells (groups x bins) of one counting pass.
CELLS_PER_PASS = 200_000


def nth_largest(values: DataFrame, groups: list[str], value: str, wanted: list[dict], bounds: tuple[float, float],
                on: list[str] | None = None, ties: bool = False, cells: int = CELLS_PER_PASS) -> list[dict]:
    """Exact n-th largest value of each group, ties counted.

    ``values`` has INT group columns and a DOUBLE value; ``wanted`` is a list of ``{group.., 'm': n}``
    with n no larger than the group. Returns ``{group.., 'cut': value}``. ``bounds`` only shapes the
    first bins, values outside them are counted in the end bins. ``on`` names the group columns found
    in ``values`` when one of its groups is asked for several n.

    The bracket of every group shrinks to the smallest and largest value of one bin per round and
    ends at a single value, so a heavily repeated value costs no more than others. With ``ties`` the
    result also holds ``need``: how many of the rows equal to the cut belong to the first n, or None
    for all of them.
    """
    spark = values.sparkSession
    pending = [dict(w, lo=bounds[0], hi=bounds[1]) for w in wanted]
    done: list[dict] = []
    v, first = F.col(value), True
    while pending:
        bins = max(2, min(4096, cells // len(pending)))
        limits = frames.local_frame(spark, {
            **{g: (pa.int32(), [w[g] for w in pending]) for g in groups},
            "_lo": (pa.float64(), [w["lo"] for w in pending]), "_hi": (pa.float64(), [w["hi"] for w in pending]),
            "_m": (pa.int64(), [w["m"] for w in pending])})
        near = values.join(F.broadcast(limits), on or groups)  # one row per group
        if not first:
            near = near.where(v.between(F.col("_lo"), F.col("_hi")))
        slot = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
        slot = F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)).cast("int")
        hist = near.groupBy(*groups, slot.alias("_slot")).agg(
            F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"))
        seen = F.sum("n").over(W.partitionBy(*groups).orderBy(F.col("_slot").desc()))
        rows = (hist.withColumn("_seen", seen)
                .where((F.col("_seen") >= F.col("_m")) & (F.col("_seen") - F.col("n") < F.col("_m")))
                .select(*groups, "lo", "hi", "n", (F.col("_m") - (F.col("_seen") - F.col("n"))).alias("m")).collect())
        pending = []
        for r in (r.asDict() for r in rows):
            found = {g: r[g] for g in groups}
            if r["m"] == r["n"]:
                done.append({**found, "cut": r["lo"], "need": None})
            elif r["lo"] == r["hi"]:
                done.append({**found, "cut": r["lo"], "need": r["m"]})
            elif r["m"] == 1 and not ties:
                done.append({**found, "cut": r["hi"], "need": None})
            else:
                pending.append(r)
        first = False
    return done


def order_parts(df: DataFrame, key: Column, id_col: str) -> list[Column]:
    """What rows are ordered by, in numbers that a double holds exactly: the key, then the halves of the id. An id that is
    no integer is ordered by its 64-bit hash."""
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    number = F.col(id_col).cast("bigint") if whole else F.xxhash64(id_col)
    return [key, F.shiftright(number, 32), number.bitwiseAND(F.lit((1 << 32) - 1))]


def first_rows(df: DataFrame, group: str, key: Column, wanted: list[dict], id_col: str = "id") -> list[dict]:
    """Cuts ``{group, band, key, high, low}`` for the first m rows of a group along ``(key, id)``.

    ``wanted`` is a list of ``{'g': class, 'band': int, 'm': n}`` with 0 < n <= class size; a class may
    ask for several bands. ``key`` is an integer in [0, 2**32), see ``functions.ordering``. Only the
    class, the key and the id are read; the rows themselves stay where they are. Where rows share the
    key at a cut, the id decides, exact over its 64 bits.
    """
    names, spans = ["key", "high", "low"], [(-float(KEY_SPAN), 0.0), (-float(1 << 31), float(1 << 31)), (-float(1 << 32), 0.0)]
    values = df.select(F.col(group).cast("int").alias("g"), *[(-p).cast("double").alias(n) for p, n in zip(order_parts(df, key, id_col), names)])
    found = {(w["g"], w["band"]): {"g": w["g"], "band": w["band"], **dict.fromkeys(names, float("inf"))} for w in wanted}
    for level, name in enumerate(names):
        cuts = nth_largest(values, ["g", "band"], name, wanted, spans[level], on=["g"] if not level else None, ties=level < 2)
        for c in cuts:
            found[c["g"], c["band"]][name] = -c["cut"]
        shared = [c for c in cuts if c.get("need") is not None]
        if not shared:
            break
        at = frames.local_frame(df.sparkSession, {
            "g": (pa.int32(), [c["g"] for c in shared]), "band": (pa.int32(), [c["band"] for c in shared]),
            name: (pa.float64(), [c["cut"] for c in shared])})
        on = ["g", name] if not level else ["g", "band", name]
        values = values.join(F.broadcast(at), on)  # one row per group and band
        wanted = [{"g": c["g"], "band": c["band"], "m": c["need"]} for c in shared]
    return list(found.values())


def within(df: DataFrame, cuts: list[dict], group: str, key: Column, k: int, bands: int,
           id_col: str = "id") -> tuple[DataFrame, list[Column]]:
    """Frame with the cuts attached, and for each band a condition "row is among the first m". Drop
    the column ``_cuts`` afterwards."""
    table = [[None] * (3 * bands) for _ in range(k)]
    for c in cuts:
        table[c["g"]][3 * c["band"]:3 * c["band"] + 3] = [float(c[n]) for n in ("key", "high", "low")]
    mine = F.element_at(frames.constant_array(df.sparkSession, table), F.col(group).cast("int") + 1)
    key, high, low = order_parts(df, key, id_col)
    conditions = []
    for b in range(bands):
        a, h, w = (F.element_at("_cuts", 3 * b + i) for i in (1, 2, 3))
        conditions.append(F.coalesce((key < a) | ((key == a) & ((high < h) | ((high == h) & (low <= w)))), F.lit(False)))
    return df.withColumn("_cuts", mine), conditions


def running_totals(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = True,
                   ranges: int | None = None, keep: str = "persist") -> DataFrame:
    """One row per distinct ``order`` value with, for each name, its total ``name`` and the total of
    all values before it ``name_before``.

    Rows are summed per value before any ordering, so a value shared by most rows is one row here.
    Ranges are cut at quantiles of the distinct values and are therefore even; as many as there are shuffle
    partitions unless given.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per_value = df.groupBy(order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    per_value = settle(per_value, keep)
    cuts = per_value.approxQuantile(order, [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(per_value)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    across = W.partitionBy().orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    range_sums = cut.groupBy("_range").agg(*[F.sum(n).alias(n) for n in sums])
    offsets = range_sums.select("_range", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = W.partitionBy("_range").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, -1)
    return (cut.join(F.broadcast(offsets), "_range")  # at most ``ranges`` rows
            .select(order, *sums, *[(F.col(f"_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
                                    for n in sums]))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank 1.. along a unique ordering of the whole frame, by one distributed sort.

    The sorted rows are checkpointed, so that the positions and the partition sizes derived from them
    cannot come from two different sorts.
    """
    placed = settle(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), "checkpoint")
    part = F.shiftright("_pos", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_pos").bitwiseAND((1 << 33) - 1)
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(name, F.col("_before") + within + 1).drop("_pos", "_part", "_before"))
