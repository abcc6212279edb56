"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm import fingerprint, hard_negatives, line_dedup, merkle, mixing, multiprobe, packing, pii, pivots, quality, simhash, substrings, token_counts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in sequences of 1,024 ids of ``byte_bpe_50k.json``, the vocabulary of which is the ranks file."""
    added = packing.added_tokens(tokenizer_file("byte_bpe_50k.json"))
    pieces = packing.pack_documents(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), added=added)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeated(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
                        written("spans").alias("spans"))


def op5_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return counted.withColumnRenamed("id", "doc_id")


def op7_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(table(spark, folder, "embeddings"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades(table(spark, folder, "labels")))
    return quality.rate(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.documents_manifest(table(spark, folder, "documents"))
    found = found.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                         merkle.folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return found.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_multiprobe(spark: SparkSession, folder: str) -> DataFrame:
    return multiprobe.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_substrings, op3_mixing, op4_pii, op5_fingerprint, op6_token_counts, op7_pivots, op8_line_dedup, op9_quality, op10_simhash, op11_merkle, op12_multiprobe, op13_hard_negatives, pipeline)
}
