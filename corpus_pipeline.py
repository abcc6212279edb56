"""Training-corpus pipeline: quality, repeated lines, near-duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm import line_dedup, mixing, packing, quality, scratch, simhash
from labelsift.llm.queries import table, tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is trained on the rated documents of the input."""
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.rate(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model).where("kept").select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document with no words left goes too."""
    lines, removed = scratch.unused(docs, "n_lines"), scratch.unused(docs, "n_removed")
    out = line_dedup.remove_repeated_lines(docs, counts=(lines, removed)).where((F.col(removed) == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Groups are those of the SimHash operator: shingles of 3
    words, fingerprints that differ in 2 bits at most."""
    return simhash.without_near_duplicates(docs, words=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 in turn, none above three epochs."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 ids, one row per piece."""
    added = packing.added_tokens(tokenizer_file("byte_bpe_50k.json"))
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), added=added)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Model fitting, XXH64 and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
