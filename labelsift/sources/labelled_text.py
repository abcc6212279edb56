"""Text files of labelled records ``__label__X text``; a record may span lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the format.
LABEL_PREFIX = "__label__"
NEWLINE_MARK = " __newline__ "


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of a file scan with their number from 0 in the order of file and line, whatever splits they were read in.

    Rows are counted for each split (file and block start) in a first pass; prefix sums over the splits, of which there are
    no more than tasks, say where each begins, and a row's number is that plus its place in its split. No row moves.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_place"))
    splits = placed.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file", "_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("_file", "_split", (before - F.col("_first")).alias("_shift"))
    out = placed.join(F.broadcast(starts), ["_file", "_split"])  # a row for each split
    return out.withColumn(name, F.col("_place") + F.col("_shift")).drop("_file", "_split", "_place", "_shift")


def read_labelled_text(spark: SparkSession, path: str, prefix: str = LABEL_PREFIX, index: str | None = None) -> DataFrame:
    """``label, text`` per record, line breaks inside a record kept as a mark; with ``index`` also a column of that
    name, the record's number in the source, by which ``select_records`` takes subsets.

    Records are split on the prefix at the start of a line, so a large file is still read by many
    tasks. The label keeps its prefix.
    """
    raw = spark.read.option("lineSep", "\n" + prefix).text(path)
    raw = raw if index is None else numbered(raw, index)
    body = F.regexp_replace("value", "^" + prefix, "")
    record = F.concat(F.lit(prefix), F.regexp_replace(body, r"^\s+|\s+$", ""))
    marked = F.regexp_replace(record, "\n", NEWLINE_MARK)
    parts = F.split(marked, " ", 2)
    return raw.select(*([index] if index else []), parts[0].alias("label"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def select_records(records: DataFrame, ids: DataFrame, key: str = "id", keep: bool = True) -> DataFrame:
    """The records named by ``ids`` (or all others)."""
    return records.join(ids.select(key), key, "left_semi" if keep else "left_anti")


def write_labelled_text(df: DataFrame, path: str, label: str, text: str, prefix: str = LABEL_PREFIX) -> None:
    """One record per row."""
    df.select(F.concat(F.lit(prefix), F.col(label).cast("string"), F.lit(" "), F.col(text)).alias("value")).write.text(path)
