"""Line de-duplication by overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, h1, h2``: 128 bits of hash for every run of three lines; runs of blank lines only are left out."""
    lines = docs.select(F.col(id_col).alias("id"), F.split(F.col(text_col), "\n", -1).alias("lines")).where(F.size("lines") >= WINDOW)

    def hashed(i):
        a, b, c = (F.get("lines", i + k) for k in range(WINDOW))
        return F.struct(i.alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit(7), c, b, a).alias("h2"),
                        (F.length(F.trim(F.concat(a, b, c))) > 0).alias("text"))

    at = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    return lines.select("id", F.inline(F.transform(at, hashed))).where("text").drop("text")


def repeated_positions(found: DataFrame) -> DataFrame:
    """``id, starts``: where windows begin that occurred before, by ascending (id, position)."""
    first = (found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
             .where("n > 1").drop("n"))
    later = found.join(first, ["h1", "h2"]).where(F.struct("id", "pos") > F.col("first"))
    return later.groupBy("id").agg(F.collect_set("pos").alias("starts"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text_col`` rid of later occurrences, and ``n_lines`` and ``n_removed`` (or what ``counts`` calls them),
    which replace columns of those names.

    A window of three lines that occurs anywhere before (smaller id, or the same id and a smaller position) covers its
    lines; covered lines go, overlapping windows merge. Of every line removed an equal one stays earlier. Lines end at
    a line feed. Texts of fewer than three lines and null texts stay as they are (null: 0 lines). Rows that share an
    id are one document: positions found in one of them apply to all, and repeated rows do not remove each other. A
    null id sorts first. A window with very many occurrences is counted map-side and joined on its hash, where
    adaptive execution splits it.
    """
    starts = repeated_positions(windows(docs, id_col, text_col)).select(F.col("id").alias("own"), "starts")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.join(starts, F.col("id").eqNullSafe(F.col("own")), "left").withColumn("lines", F.split("text", "\n", -1))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("bigint")
    covered = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = out.withColumn("kept", F.when(F.col("starts").isNotNull() & F.col("text").isNotNull(), kept))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    gone = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("bigint")
    columns = [text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns if c not in counts]
    return out.select(*columns, n_lines.alias(counts[0]), gone.alias(counts[1]))
