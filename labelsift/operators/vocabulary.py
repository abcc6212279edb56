"""Token counts, vocabulary and L2-normalised term frequencies in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: vocabulary size.
VOCABULARY_SIZE = 4000


def token_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``id, token, n``.

    ``explode_outer`` on purpose: for a plain ``explode`` the optimizer adds a filter on the array's
    size and works the tokenising expression out again for it.
    """
    words = docs.select("id", F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull())
    return words.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """``token, total`` of the most frequent tokens; on equal counts the smaller token first. A top-k
    per task, then a merge: no full sort."""
    totals = counts.groupBy("token").agg(F.sum("n").alias("total"))
    return totals.orderBy(F.col("total").desc(), F.col("token").asc()).limit(size)


def l2_weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``id, token, w``: counts over the vocabulary, scaled to length 1 per document. A document has
    at most vocabulary-size rows here."""
    kept = counts.join(F.broadcast(vocab.select("token")), "token", "left_semi")  # at most VOCABULARY_SIZE rows
    norm = F.sqrt(F.sum(F.col("n").cast("double") * F.col("n")).over(W.partitionBy("id")))
    return kept.select("id", "token", (F.col("n") / norm).alias("w"))
