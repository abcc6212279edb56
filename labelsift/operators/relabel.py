"""Label correction from side tables.

Labels: ``file, release, vulnerable, ..``. Exact side table: ``file, release``. Interval side table:
``file, first_appear, last_appear``, both ends inclusive. Corrections are existence tests: side
tables become distinct ``(file, release)`` keys first, so duplicate keys and overlapping intervals
never multiply label rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["file", "release"]


def exact_keys(silent: DataFrame) -> DataFrame:
    return silent.select(*KEY).distinct()


def disjoint_intervals(latent: DataFrame) -> DataFrame:
    """``file, first_appear, last_appear``: the releases that the intervals of a file cover, as runs that neither overlap nor touch.

    Of the intervals that begin with the same release only the longest counts, which partial aggregation settles before any
    shuffle. So a file keeps one row for each release at most, however many intervals it has, and the window over them is
    bounded. Empty intervals and those without an end are left out.
    """
    longest = (latent.where("first_appear <= last_appear").groupBy("file", "first_appear").agg(F.max("last_appear").alias("last_appear")))
    by_file = W.partitionBy("file").orderBy("first_appear")
    reached = F.max("last_appear").over(by_file.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("first_appear") > reached + 1), 1).otherwise(0)
    runs = longest.withColumn("_new", opens).withColumn("_run", F.sum("_new").over(by_file))
    return runs.groupBy("file", "_run").agg(F.min("first_appear").alias("first_appear"), F.max("last_appear").alias("last_appear")).drop("_run")


def interval_keys(latent: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct ``(file, release)`` of the labels that an interval covers. The runs of a file are a condition of an existence
    join on the file, so long intervals make no rows and overlapping ones are tested once."""
    spans = disjoint_intervals(latent).select(F.col("file").alias("_f"), "first_appear", "last_appear")
    covered = (F.col("file") == F.col("_f")) & F.col("release").between(F.col("first_appear"), F.col("last_appear"))
    return labels.select(*KEY).distinct().join(spans, covered, "left_semi")


def silent_for_release(silent: DataFrame, release: int | None) -> DataFrame:
    if release is None:
        raise ValueError("set a release first")
    return silent.where(F.col("release") == release)


def latent_for_release(latent: DataFrame, release: int | None) -> DataFrame:
    if release is None:
        raise ValueError("set a release first")
    return latent.where(F.lit(release).between(F.col("first_appear"), F.col("last_appear")))


def relabel(labels: DataFrame, silent: DataFrame | None = None, latent: DataFrame | None = None,
            value: int = 1) -> DataFrame:
    """Overwrite ``vulnerable`` with ``value`` wherever a side table names the row, whatever it was
    before. ``label_source`` says what decided: given, silent or latent (the later step wins)."""
    parts = []
    if silent is not None:
        parts.append(exact_keys(silent).select(*KEY, F.lit(1).alias("_silent"), F.lit(0).alias("_latent")))
    if latent is not None:
        parts.append(interval_keys(latent, labels).select(*KEY, F.lit(0).alias("_silent"), F.lit(1).alias("_latent")))
    if not parts:
        return labels.withColumn("label_source", F.lit("given"))
    keys = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if len(parts) == 2:
        keys = keys.groupBy(*KEY).agg(F.max("_silent").alias("_silent"), F.max("_latent").alias("_latent"))
    hit = F.col("_silent").isNotNull()
    source = F.when(F.col("_latent") == 1, "latent").when(F.col("_silent") == 1, "silent").otherwise("given")
    return (labels.join(keys, KEY, "left")
            .withColumn("vulnerable", F.when(hit, F.lit(value)).otherwise(F.col("vulnerable")).cast("int"))
            .withColumn("label_source", source).drop("_silent", "_latent"))


def hidden_positives(labels: DataFrame, silent: DataFrame, latent: DataFrame) -> DataFrame:
    """Labels as they are plus ``hidden_positive``: named by a side table. The label column stays."""
    marked = relabel(labels.withColumn("_given", F.col("vulnerable")), silent, latent, value=2)
    return (marked.withColumn("hidden_positive", F.col("vulnerable") == 2)
            .withColumn("vulnerable", F.col("_given")).drop("_given"))


# Releases whose validation or test release is not simply the next ones.
TEST_SHIFT = {78: (79, 81), 79: (81, 82)}
NO_RUN = (80,)


def split_releases(release: int) -> tuple[int, int, int] | None:
    """(train, validation, test) releases, or None where no run exists."""
    if release in NO_RUN:
        return None
    val, test = TEST_SHIFT.get(release, (release + 1, release + 2))
    return release, val, test


def split_map(releases: DataFrame) -> DataFrame:
    """``train, val, test`` for a frame of releases, as expressions."""
    r = F.col("release")
    val, test = r + 1, r + 2
    for train, (v, t) in TEST_SHIFT.items():
        val, test = F.when(r == train, v).otherwise(val), F.when(r == train, t).otherwise(test)
    return (releases.select("release").distinct().where(~r.isin(*NO_RUN))
            .select(r.alias("train"), val.cast("int").alias("val"), test.cast("int").alias("test")))
