"""Feature jobs: metric roll-ups, bag of words, embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer, SQLTransformer
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.functions import text
from labelsift.operators import relabel, rollup, vocabulary
from labelsift.session import ship_package


def metric_features(labels: DataFrame, raw: DataFrame, order: str = "row_order") -> DataFrame:
    """The 53 metric columns per labelled file, for all releases in one job."""
    return rollup.roll_up(labels, raw, order)


def prepare_code(code: DataFrame, column: str = "code", passes: int = 1) -> DataFrame:
    """Frame plus ``tokens`` of the cleaned text."""
    cleaned = text.replace_tokens(text.clean_code(column, passes))
    return code.withColumn("tokens", text.tokens(cleaned))


def bag_of_words(prepared: DataFrame, size: int = vocabulary.VOCABULARY_SIZE) -> PipelineModel:
    """Term frequencies over the most frequent tokens of ``prepared``, scaled to length 1. Where several tokens are equally
    frequent at the cut, the smaller ones are in, as in ``vocabulary.vocabulary``; ``size`` tokens reach the driver."""
    words = prepared.select(F.explode("tokens").alias("token"), F.lit(1).alias("n"))
    known = [r["token"] for r in vocabulary.vocabulary(words, size).collect()]
    if not known:
        raise ValueError("no tokens to make a vocabulary of")
    return PipelineModel(stages=[
        CountVectorizerModel.from_vocabulary(known, inputCol="tokens", outputCol="counts"),
        Normalizer(inputCol="counts", outputCol="features", p=2.0),
        SQLTransformer(statement="SELECT file, release, features FROM __THIS__"),
    ])


def bow_features(code: DataFrame, release: int, size: int = vocabulary.VOCABULARY_SIZE) -> dict[str, DataFrame]:
    """Train, validation and test features of a release, all with the training vocabulary."""
    split = relabel.split_releases(release)
    if split is None:
        raise ValueError(f"release {release} has no run")
    prepared = prepare_code(code.where(F.col("release").isin(*split)))
    model = bag_of_words(prepared.where(F.col("release") == split[0]), size)
    return {part: model.transform(prepared.where(F.col("release") == r)) for part, r in zip(("", "_val", "_test"), split)}


def embed(code: DataFrame, make_predict_fn: Callable, column: str = "code", batch_size: int = 32) -> DataFrame:
    """Frame plus ``features``: pooled encoder output of the cleaned text.

    ``make_predict_fn`` loads the encoder once per Python worker and returns a function from a batch of
    strings to a float matrix.
    """
    encode = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return code.withColumn("features", encode(text.clean_code(column)))


def embed_tokens(df: DataFrame, make_encoder: Callable, ids: str = "token_ids", max_length: int = 512, batch_size: int = 32,
                 sep_id: int = 1, pad_id: int = 0) -> DataFrame:
    """``df`` plus ``features ARRAY<DOUBLE>``: pooled encoder output of token ids.

    A sequence is the separator and the row's ids, cut at ``max_length`` in all. Sequences of similar length are encoded
    together: those of an Arrow batch are sorted by length and cut into batches, and each batch is padded to its own longest
    one, so that short texts next to a long one cost no padding. ``make_encoder`` loads the encoder once per task and returns a function of
    two matrices, ids and mask (1 for a token, 0 for padding), to one row of numbers for each sequence. An encoder that respects the
    mask gives the same features whatever shares its batch. Null ids are an empty text: the separator alone.
    """
    ship_package(df.sparkSession)
    name, columns = "features", df.columns

    def run(batches):
        encode = None
        for batch in batches:
            encode = encode or make_encoder()
            tokens = [[sep_id, *(t or ())][:max_length] for t in batch.column(columns.index(ids)).to_pylist()]
            lengths = np.array(list(map(len, tokens)), dtype=np.int64)
            order, out = np.argsort(lengths, kind="stable"), [None] * len(tokens)
            for lo in range(0, len(order), batch_size):
                rows = order[lo:lo + batch_size]
                padded = np.full((len(rows), lengths[rows].max()), pad_id, dtype=np.int64)
                mask = np.arange(padded.shape[1])[None] < lengths[rows][:, None]
                padded[mask] = np.concatenate([tokens[r] for r in rows])
                for r, v in zip(rows, encode(padded, mask.astype(np.int64))):
                    out[r] = np.asarray(v, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*columns, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)
