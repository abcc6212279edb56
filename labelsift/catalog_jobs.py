"""Registered queries of sources, sinks and jobs over all releases: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.catalog import PL_K, REGISTRY, feature_rows, label_rows, latent_rows, month_index, page_tokens, pe, pl, query, r6, silent_rows, table  # noqa: F401
from labelsift.functions.ordering import arithmetic_key
from labelsift.functions.probability import argmax_class
from labelsift.operators import evaluate, joint, relabel, rollup, validate
from labelsift.plans import crossval, experiment, feature_jobs, models, noisy_labels, pu_models, transductive
from labelsift.session import ensure_checkpoint_dir, settle
from labelsift.sources import features, labelled_text, results, tables

METRICS = [*rollup.FILE_FIRST, *rollup.CLASS_SUM, *rollup.CLASS_MEAN, *rollup.FUNCTION_SPREAD]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # unique in lineitem


def new_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- all releases at once

def release_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each part and month: ``file, release, s`` (any item returned) and three sums as ``x``."""
    li = table(spark, folder, "lineitem")
    sums = [F.sum(F.col("l_quantity").cast("double")), F.count(F.lit(1)).cast("double") * 10, F.sum(F.round(F.col("l_tax") * 100).cast("double"))]
    rows = li.groupBy(F.col("l_partkey").alias("file"), month_index("l_shipdate").alias("release")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("s"), F.array(*sums).alias("x"))
    return settle(rows)


def _tables(spark: SparkSession, folder: str, rows: DataFrame) -> experiment.Tables:
    labels = rows.select("file", "release", F.col("s").alias("vulnerable"))
    return experiment.Tables(labels, silent_rows(spark, folder), latent_rows(spark, folder), {})


@query
def transductive_report(spark, folder):
    """Confident learning and one-stage PU learning in every release, held against the corrected labels."""
    rows = release_rows(spark, folder)
    masks = {"pruning": transductive.pruning_mask(rows, F.col("file") % 4, 4), "propagation1": transductive.propagation_mask(rows, "euclidean")}
    out = experiment.transductive_report(_tables(spark, folder, rows), "sm", masks, places=6)
    return out.select("release", "technique", "precision", "recall", "gmean_pu")


@query
def transductive_oneclass(spark, folder):
    """The density of each release's positives, held against the corrected labels; random features have no SQL form."""
    rows = release_rows(spark, folder)
    scaled = rows.withColumn("x", F.transform("x", lambda v: v / 50.0))
    out = experiment.transductive_report(_tables(spark, folder, rows), "sm", {"oneclass": transductive.one_class_mask(scaled, 0.2)}, places=6)
    return out.select("release", "technique", "precision", "recall", "gmean_pu")


@query
def overall_recall_runs(spark, folder):
    """Two runs of every release: predictions and results are stored, then a new version of the results gets the recall
    against corrected labels."""
    rows = release_rows(spark, folder)
    scored = transductive.centroid_probabilities(rows, F.col("file") % 4, 4).where(F.col("release") > 2)
    scored = settle(scored.select("file", "release", "s", "p"))  # read for predictions and metrics of both techniques
    path = new_folder(spark, "runs")
    for technique, cut in (("baseline", 0.5), ("regularize", 0.4)):
        key = {"classifier": F.lit("centroid"), "feature_type": F.lit("sm"), "technique": F.lit(technique)}
        predicted = scored.select((F.col("release") - 2).alias("release"), *[c.alias(n) for n, c in key.items()], "file", F.col("release").alias("test_release"),
                                  F.col("s").alias("vulnerable"), (F.col("p") >= cut).cast("int").alias("predicted"))
        results.write_predictions(predicted, f"{path}/predictions-{technique}")
        metrics = evaluate.binary_metrics(predicted, "vulnerable", "predicted", by=["release"], places=6)
        fixed = {**key, "parameters": F.lit(f"cut={cut}"), **{c: F.lit(0.0) for c in ("val_auc", "auc", "recall_u", "val_time", "train_time", "pred_time")}}
        results.append_results(metrics.withColumns(fixed), f"{path}/results")
    stored = spark.read.parquet(f"{path}/predictions-baseline").unionByName(spark.read.parquet(f"{path}/predictions-regularize"))
    results.write_predictions(stored, f"{path}/predictions")
    t = _tables(spark, folder, rows)
    out = results.write_overall_recall(spark, f"{path}/results", f"{path}/predictions", t.labels, t.silent, t.latent, f"{path}/results-2")
    return out.select("release", "technique", "precision", "recall", "mcc", r6("recall_o").alias("recall_o"))


# ---------------------------------------------------------------- sources

def _file_of(order: str, slash: str) -> Column:
    """Two orders have files of one stem."""
    half = F.expr(f"{order} div 2")
    ending = F.when(F.col(order) % 2 == 0, ".cpp").otherwise(".h")
    return F.concat(F.lit(f"src{slash}"), (half % 10).cast("string"), F.lit(f"{slash}f"), half.cast("string"), ending)


def _raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every item as a line of a raw metric table, in the order of ``KEY``: in turn a file, a function and a class; several of each a
    file. Items are sorted before they become lines, and the metrics are whole numbers, written as such."""
    li = table(spark, folder, "lineitem").select(*KEY, "l_quantity").orderBy(*KEY)
    kind = F.element_at(F.array(F.lit("File"), F.lit("Public Function"), F.lit("Private Class")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    path = _file_of("l_orderkey", "\\")
    value = F.col("l_partkey") + F.col("l_quantity").cast("bigint")
    metrics = [((value * (i + 3)) % 101).alias(m) for i, m in enumerate(METRICS)]
    return li.select(kind.alias("Kind"), path.alias("File"), *metrics)


@query
def raw_metric_features(spark, folder):
    """A raw metric table as CSV, read back in the order of its lines, and the 53 features of every order's file: several rows
    of kind File compete for the first place."""
    path = new_folder(spark, "raw-metrics")
    # Packed files are read whole, each by one task, so they are kept short.
    _raw_lines(spark, folder).write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", 100_000).csv(path)
    raw = tables.read_raw_metrics(spark, path, 63)
    o = table(spark, folder, "orders")
    labels = o.select(_file_of("o_orderkey", "/").alias("file"), F.lit(63).alias("release"), (F.col("o_orderstatus") == "F").cast("int").alias("vulnerable"))
    out = feature_jobs.metric_features(labels, raw)
    return out.select("file", "vulnerable", *[r6(c).alias(c.lower()) for c in rollup.metric_columns()])


@query
def label_sources(spark, folder):
    """Labels as Parquet, side tables as CSV; read back, corrected, and counted by release and source of the label."""
    path = new_folder(spark, "labels")
    flag = F.col("vulnerable") == 1
    name = F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".cpp"))
    label_rows(spark, folder).select(name.alias("file"), "release", flag.alias("vulnerable")).write.partitionBy("release").parquet(f"{path}/labels")
    silent_rows(spark, folder).select(name.alias("file"), "release", F.lit(True).alias("vulnerable")).write.option("header", True).csv(f"{path}/silent")
    latent_rows(spark, folder).select(F.lit("b1").alias("bug_report"), name.alias("file"), "first_appear", "last_appear", F.lit(None).cast("string").alias("reason")).write.option(
        "header", True).csv(f"{path}/latent")
    out = relabel.relabel(tables.read_labels(spark, f"{path}/labels"), tables.read_silent(spark, f"{path}/silent"), tables.read_latent(spark, f"{path}/latent"))
    return out.groupBy("release", "label_source").agg(F.count(F.lit(1)).alias("n"), F.sum("vulnerable").alias("positives"))


@query
def side_tables_by_release(spark, folder):
    """For every release, how many silent labels and how many latent intervals hold in it."""
    path = new_folder(spark, "sides")
    silent_rows(spark, folder).select(F.col("file").cast("string").alias("file"), "release", F.lit(True).alias("vulnerable")).write.option("header", True).csv(f"{path}/silent")
    silent = relabel.exact_keys(tables.read_silent(spark, f"{path}/silent")).groupBy("release").agg(F.count(F.lit(1)).alias("silent"))
    runs = relabel.disjoint_intervals(latent_rows(spark, folder))
    covered = runs.select(F.explode(F.sequence("first_appear", "last_appear")).alias("release")).groupBy("release").agg(F.count(F.lit(1)).alias("latent"))
    out = silent.join(covered, "release", "full")
    return out.select("release", F.coalesce("silent", F.lit(0).cast("bigint")).alias("silent"), F.coalesce("latent", F.lit(0).cast("bigint")).alias("latent"))


@query
def feature_sources(spark, folder):
    """Feature sets of all releases written; those of a run's three releases read back, filled, assembled, stacked and aligned."""
    path = new_folder(spark, "features")
    rows = release_rows(spark, folder)
    wide = rows.select("file", "release", *[F.get("x", i).alias(n) for i, n in enumerate(("quantity", "items", "tax"))])
    wide = wide.withColumn("tax", F.when(F.col("tax") > 0, F.col("tax")))  # what is missing reads as 0
    features.write_features(wide, path, "sm")
    of_run = relabel.split_releases(63)
    stacked = features.stack([features.read_features(spark, path, "sm", r) for r in of_run])
    aligned = tables.align(stacked, rows.where(F.col("release").isin(*of_run)).select("file", "release", F.col("s").alias("vulnerable")))
    v = vector_to_array("features")
    return aligned.select("file", "release", "vulnerable", *[F.get(v, i).alias(n) for i, n in enumerate(("quantity", "items", "tax"))])


@query
def labelled_text_index(spark, folder):
    """Documents as labelled text, records numbered in the order of the files; every third is one subset, the others its complement."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    path = new_folder(spark, "labelled-text")
    plain = F.regexp_replace("text", "__label__", "label")
    labelled_text.write_labelled_text(docs.orderBy("doc_id").withColumn("text", plain), path, "toxic", "text")
    records = labelled_text.read_labelled_text(spark, path, index="record")
    ids = records.where("record % 3 = 0").select("record")
    sizes = lambda keep: labelled_text.select_records(records, ids, "record", keep=keep).select(
        "record", "label", F.length(F.trim("text")).cast("bigint").alias("n_chars"), F.lit(keep).alias("chosen"))
    return sizes(True).unionByName(sizes(False))


@query
def checked_accuracy(spark, folder):
    """Checked probabilities (admissible or an error), the accuracy of their arg max, plain and weighted."""
    probs = pe(spark, folder)
    validate.check_probs(probs, 10)
    labelled = argmax_class("psx").cast("int")
    rows = probs.select("s", labelled.alias("prediction"), (F.col("id") % 3 + 1).cast("double").alias("w"))
    plain = evaluate.weighted_accuracy(rows, "s", "prediction", None).select(r6("accuracy").alias("accuracy"))
    weighted = evaluate.weighted_accuracy(rows, "s", "prediction", "w").select(r6("accuracy").alias("weighted"))
    return plain.select("accuracy", weighted.scalar().alias("weighted"))


# ---------------------------------------------------------------- encoders and the older joint

def make_matrix_encoder():
    """A small deterministic encoder: whole-number token vectors, averaged over the tokens that the mask shows."""
    import numpy as np

    vectors = (np.arange(997)[:, None] * (2 * np.arange(8) + 1)[None]) % 17 - 8

    def encode(ids, mask):
        return (vectors[ids % 997] * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]

    return encode


@query
def embedded_pages(spark, folder):
    """Pages as code tokens, encoded in batches of similar length: separator, at most 512 tokens, padded and masked."""
    tokens = page_tokens(spark, folder)
    ids = F.transform("tokens", lambda t: (F.length(t) * 31 + F.ascii(t)).cast("bigint"))
    out = feature_jobs.embed_tokens(tokens.select("id", ids.alias("token_ids")), make_matrix_encoder)
    return out.select("id", F.posexplode("features").alias("i", "v")).select("id", "i", r6("v").alias("v"))


@query
def prior_forcing_joint(spark, folder):
    return joint.prior_forcing_joints(pl(spark, folder), PL_K)[-1].select("s", "y", "n")


# ---------------------------------------------------------------- fits with a closed form, which SQL can follow

def _gaussian() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", labelCol="s")


def _out_of_sample(spark: SparkSession, folder: str) -> DataFrame:
    return crossval.cross_val_probabilities(feature_rows(spark, folder), _gaussian(), 3, key=arithmetic_key("id", 42))


@query
def gaussian_cv_probabilities(spark, folder):
    return _out_of_sample(spark, folder).select("id", "s", "fold", r6(F.element_at("psx", 2)).alias("p"))


@query
def gaussian_noisy_label_fit(spark, folder):
    """Out-of-sample probabilities, noise, errors, pruning, weights and the last fit, scored on all rows."""
    rows = _out_of_sample(spark, folder)
    p = F.round(F.element_at("psx", 2), 6)
    model = noisy_labels.NoisyLabelClassifier(_gaussian(), labelCol="s", psxCol="psx").fit(rows.withColumn("psx", F.array(1.0 - p, p)))
    errors = model.errors.select("id", "is_error")
    return models.positive_score(model.transform(rows.drop("psx", "fold"))).join(errors, "id").select("id", "s", "is_error", r6("p").alias("p"))


@query
def gaussian_elkan_noto(spark, folder):
    rows = feature_rows(spark, folder)
    return pu_models.ElkanNoto(_gaussian(), key=arithmetic_key("id", 5)).fit(rows).transform(rows).select("id", "s", r6("p").alias("p"))


@query
def gaussian_bagging_pu(spark, folder):
    rows = feature_rows(spark, folder)
    model = pu_models.BaggingPU(_gaussian(), parallelism=4, key=arithmetic_key("id", 9)).fit(rows)
    return model.transform(rows).select("id", "s", r6("p").alias("p"))


@query
def gaussian_two_stage_pu(spark, folder):
    """The weight of the positive distance with the best validation AUC, and the fit on what it leaves."""
    rows = feature_rows(spark, folder)
    model = pu_models.TwoStagePU(_gaussian()).fit(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"))
    return model.transform(rows).select("id", "s", F.lit(float(model.alpha)).alias("alpha"), r6("p").alias("p"))


@query
def gaussian_label_propagation(spark, folder):
    rows = feature_rows(spark, folder)
    model = pu_models.LabelPropagation(_gaussian()).fit(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"))
    return model.transform(rows).select("id", "s", r6("p").alias("p"))

