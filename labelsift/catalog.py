"""The registered queries: each takes (spark, folder of the test tables) and returns a DataFrame.

No test table holds probabilities, so two deterministic sources stand in for a scored model:
``pe`` (embeddings, 10 classes, cross-validated centroid probabilities) and ``pl`` (orders, 3 classes,
integer arithmetic). ``pb`` is the two-class form of ``pl``. Probabilities are rounded to 6 places
before anything is compared or ranked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.functions import multilabel as ml
from labelsift.functions import text
from labelsift.functions.ordering import arithmetic_key
from labelsift.functions.probability import clip_rescale, self_confidence
from labelsift.operators import (evaluate, frames, joint, latent, multilabel, prune, pu, relabel, rollup,
                                 sampling, vocabulary)
from labelsift.plans import balanced, confident_tuning, crossval, feature_jobs, models, noisy_labels, pu_models, smote
from labelsift.session import ensure_checkpoint_dir, settle, ship_package
from labelsift.sources import labelled_text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
PE_K, PL_K, EV_K = 10, 3, 5
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- inputs

def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("s"), F.col("embedding").alias("x"))


def pe(spark: SparkSession, folder: str) -> DataFrame:
    df = crossval.centroid_cv_probabilities(vectors(spark, folder), PE_K, 4, F.col("id") % 4)
    return settle(df.select("id", "s", "psx"))


def _weighted(id_col: Column, s: Column, k: int) -> Column:
    parts = [((id_col * 7919 + c * 104729) % 9973 + 1 + F.when(s == c, 3000).otherwise(0)) for c in range(k)]
    total = sum(parts[1:], parts[0])
    return F.array(*[F.floor(w * 1000000 / total) / F.lit(1e6) for w in parts])


def _order_probs(spark: SparkSession, folder: str, s: Column, k: int) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    return settle(o.select(key.alias("id"), s.cast("int").alias("s"), _weighted(key, s, k).alias("psx")))


def pl(spark: SparkSession, folder: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return _order_probs(spark, folder, s, PL_K)


def pb(spark: SparkSession, folder: str) -> DataFrame:
    return _order_probs(spark, folder, F.when(F.col("o_orderstatus") == "P", 1).otherwise(0), 2)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Binary test predictions: ``id, label, p, predicted`` at 0.5, plus hidden positives."""
    df = pb(spark, folder)
    p = F.element_at("psx", 2)
    return df.select("id", F.col("s").alias("label"), p.alias("p"), (p >= 0.5).cast("int").alias("predicted"),
                     ((F.col("s") == 0) & (F.col("id") % 11 == 0)).alias("hidden_positive"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a length-based score: two classes, few positives."""
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    lab = table(spark, folder, "labels").select("doc_id", "toxic")
    p = F.round(((F.col("doc_id") * 7919 + F.col("n_chars")) % 9973 + 1 + F.col("toxic") * 4000) / F.lit(14000.0), 6)
    return settle(d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("s"),
                                               F.array(F.round(F.lit(1.0) - p, 6), p).alias("psx")))


def event_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Several labels per row: the event types of a user on a day."""
    e = table(spark, folder, "events")
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    seen = (e.select("user_id", day.alias("day"), kind.cast("int").alias("k"))
            .groupBy("user_id", "day").agg(F.array_sort(F.collect_set("k")).alias("s")))  # at most 5 entries
    ps = [F.round(((F.col("user_id") * 17 + F.col("day") * 5 + c * 31) % 83 + 1
                   + F.when(F.array_contains("s", c), 40).otherwise(0)) / F.lit(125.0), 6) for c in range(EV_K)]
    return settle(seen.select((F.col("user_id") * 1000 + F.col("day")).alias("id"), "s", F.array(*ps).alias("psx")))


def month_index(col: str) -> Column:
    return ((F.year(col) - 1995) * 12 + F.month(col)).cast("int")


def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(F.col("l_partkey").alias("file"), month_index("l_shipdate").alias("release"),
                     (F.col("l_returnflag") == "R").cast("int").alias("vulnerable"))


def silent_rows(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").where("l_quantity >= 48 and l_tax <= 0.02")
    return li.select(F.col("l_partkey").alias("file"), month_index("l_shipdate").alias("release"))


def latent_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    first = p.select(F.col("p_partkey").alias("file"), F.col("p_size").alias("first_appear"),
                     (F.col("p_size") + 6).alias("last_appear"))
    second = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("file"), (F.col("p_size") + 4).alias("first_appear"),
                                                 (F.col("p_size") + 12).alias("last_appear"))
    return first.unionByName(second)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("page_id").alias("id"), "html")


def page_tokens(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = text.replace_tokens(text.clean_code("html"))
    return pages(spark, folder).select("id", text.tokens(cleaned).alias("tokens"))


def cj_of(probs: DataFrame, k: int) -> DataFrame:
    return frames.pinned(joint.confident_joint(probs, k))


def prior_of(probs: DataFrame, k: int) -> DataFrame:
    return frames.pinned(joint.prior(joint.class_counts(probs, k)))


# ---------------------------------------------------------------- counts, joint, latent

@query
def class_counts(spark, folder):
    li = table(spark, folder, "lineitem")
    s = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return joint.class_counts(li.select(s.alias("s")), 3)


@query
def noisy_prior(spark, folder):
    return prior_of(vectors(spark, folder), PE_K).select("s", "n", r6("p").alias("p"))


@query
def imbalance_ratio(spark, folder):
    return joint.imbalance_ratio(joint.class_counts(pb(spark, folder), 2)).select("n0", "n1", r6("ratio").alias("ratio"))


@query
def class_thresholds(spark, folder):
    return joint.class_thresholds(pl(spark, folder)).select("s", r6("t").alias("t"))


@query
def class_thresholds_pe(spark, folder):
    return joint.class_thresholds(pe(spark, folder)).select("s", r6("t").alias("t"))


@query
def confident_joint(spark, folder):
    return joint.confident_joint(pe(spark, folder), PE_K, calibrate=False).select("s", "y", "n")


@query
def confident_joint_pl(spark, folder):
    return joint.confident_joint(pl(spark, folder), PL_K, calibrate=False).select("s", "y", "n")


@query
def calibrated_joint(spark, folder):
    return cj_of(pl(spark, folder), PL_K).select("s", "y", "n")


@query
def calibrated_joint_pe(spark, folder):
    return cj_of(pe(spark, folder), PE_K).select("s", "y", "n")


@query
def joint_distribution(spark, folder):
    return joint.joint_distribution(cj_of(pl(spark, folder), PL_K)).select("s", "y", r6("p").alias("p"))


@query
def joint_report(spark, folder):
    return latent.matrix_report(joint.joint_distribution(cj_of(pl(spark, folder), PL_K)), PL_K, places=4)


@query
def num_label_errors(spark, folder):
    return joint.num_label_errors(cj_of(pe(spark, folder), PE_K))


@query
def noise_matrix(spark, folder):
    return latent.noise_matrix(cj_of(pl(spark, folder), PL_K)).select("s", "y", r6("p").alias("p"))


@query
def inverse_noise_matrix(spark, folder):
    return latent.inverse_noise_matrix(cj_of(pl(spark, folder), PL_K)).select("s", "y", r6("p").alias("p"))


@query
def clipped_noise_matrix(spark, folder):
    return latent.clip_rates(latent.noise_matrix(cj_of(pe(spark, folder), PE_K)), "y").select("s", "y", r6("p").alias("p"))


def _latent_prior(method: str) -> Query:
    def run(spark, folder):
        probs = pl(spark, folder)
        cj = cj_of(probs, PL_K)
        py = latent.latent_prior(prior_of(probs, PL_K), latent.noise_matrix(cj), latent.inverse_noise_matrix(cj), method, cj)
        return py.select("y", r6("p").alias("p"))
    return run


for _m in latent.PRIOR_METHODS:
    REGISTRY[f"latent_prior_{_m}"] = _latent_prior(_m)


@query
def latent_converged(spark, folder):
    probs = pl(spark, folder)
    _, nm, _ = latent.estimate_latent(cj_of(probs, PL_K), prior_of(probs, PL_K), converge=True)
    return nm.select("s", "y", r6("p").alias("p"))


@query
def bayes_inverse(spark, folder):
    probs = pl(spark, folder)
    cj = cj_of(probs, PL_K)
    ps, nm = prior_of(probs, PL_K), latent.noise_matrix(cj)
    py = latent.latent_prior(ps, nm, latent.inverse_noise_matrix(cj), "cnt")
    return latent.inverse_from_noise(py, nm, ps).select("s", "y", r6("p").alias("p"))


@query
def bayes_noise(spark, folder):
    probs = pl(spark, folder)
    cj = cj_of(probs, PL_K)
    return latent.noise_from_inverse(prior_of(probs, PL_K), latent.inverse_noise_matrix(cj)).select("s", "y", r6("p").alias("p"))


@query
def noise_free_class(spark, folder):
    nm = latent.noise_matrix(cj_of(pl(spark, folder), PL_K))
    return latent.remove_noise_from_class(nm, 2).select("s", "y", r6("p").alias("p"))


@query
def clean_posterior(spark, folder):
    probs = pl(spark, folder)
    cj = cj_of(probs, PL_K)
    out = latent.clean_posterior(probs, latent.noise_matrix(cj), latent.inverse_noise_matrix(cj), PL_K)
    return out.select("id", *[r6(F.element_at("pyx", c + 1)).alias(f"p{c}") for c in range(PL_K)])


@query
def learnability_check(spark, folder):
    probs = pl(spark, folder)
    cj = cj_of(probs, PL_K)
    nm = latent.noise_matrix(cj)
    py = latent.latent_prior(prior_of(probs, PL_K), nm, latent.inverse_noise_matrix(cj), "marginal", cj)
    return latent.learnable(nm, py)


@query
def pu_thresholds_joint(spark, folder):
    """Clean positive class: its threshold is 1, which a part of the scores reaches, the joint is constrained, and the
    share of hidden positives among the unlabelled rows is read off the inverse matrix."""
    p = F.least(F.lit(1.0), F.round(F.element_at("psx", 2) * 1.4, 6))
    probs = toxic(spark, folder).select("id", "s", F.array(F.round(F.lit(1.0) - p, 6), p).alias("psx"))
    t = joint.class_thresholds(probs, overrides={1: 1.0})
    raw = joint.confident_joint(probs, 2, t, calibrate=False)
    share = latent.unlabelled_noise_share(latent.inverse_noise_matrix(raw), 1).scalar()
    cj = latent.pu_constrain(raw, 1, "joint")
    return cj.select("s", "y", "n", r6(share).alias("unlabelled_share"))


@query
def clip_values(spark, folder):
    return pl(spark, folder).select("id", *[
        r6(F.element_at(clip_rescale("psx", 0.1, 0.6), c + 1)).alias(f"p{c}") for c in range(PL_K)])


# ---------------------------------------------------------------- label errors

@query
def argmax_errors(spark, folder):
    return prune.argmax_errors(pe(spark, folder)).select("id", "s", "is_error")


@query
def argmax_joint_errors(spark, folder):
    return prune.argmax_joint_errors(pl(spark, folder), PL_K).select("id", "s", "is_error")


@query
def argmax_calibrated_joint_errors(spark, folder):
    return prune.argmax_joint_errors(pl(spark, folder), PL_K, calibrate=True, method="prune_by_class").select("id", "s", "is_error")


@query
def argmax_confusion(spark, folder):
    df = pe(spark, folder)
    return joint.confusion_counts(df.withColumn("y", F.expr("cast(array_position(psx, array_max(psx)) - 1 as int)")), "s", "y")


@query
def offdiag_errors(spark, folder):
    return joint.off_diagonal_rows(pl(spark, folder), PL_K).select("id", "s", F.col("guess").alias("y"))


@query
def prune_counts(spark, folder):
    return prune.prune_counts(cj_of(pe(spark, folder), PE_K)).select("s", "y", "n")


@query
def errors_by_noise_rate(spark, folder):
    return prune.find_label_errors(pl(spark, folder), PL_K).select("id", "s", "is_error")


@query
def errors_by_class(spark, folder):
    return prune.find_label_errors(pl(spark, folder), PL_K, method="prune_by_class").select("id", "s", "is_error")


@query
def errors_both(spark, folder):
    return prune.find_label_errors(pl(spark, folder), PL_K, method="both").select("id", "s", "is_error")


@query
def errors_by_noise_rate_pe(spark, folder):
    return prune.find_label_errors(pe(spark, folder), PE_K).select("id", "s", "is_error")


@query
def errors_budget(spark, folder):
    return prune.find_label_errors(pl(spark, folder), PL_K, budget=[200, 100, 50]).select("id", "s", "is_error")


@query
def errors_frac_noise(spark, folder):
    return prune.find_label_errors(pl(spark, folder), PL_K, frac_noise=0.5).select("id", "s", "is_error")


def _ordered(order_by: str) -> Query:
    def run(spark, folder):
        flagged = prune.find_label_errors(pe(spark, folder), PE_K)
        return prune.order_label_errors(flagged, order_by, score_places=6).select("id", "s", "score", "rank")
    return run


REGISTRY["ordered_errors_margin"] = _ordered("normalized_margin")
REGISTRY["ordered_errors_prob"] = _ordered("prob_given_label")


@query
def prune_rows(spark, folder):
    return prune.prune_rows(prune.find_label_errors(pb(spark, folder), 2)).select("id", "s")


@query
def flip_labels(spark, folder):
    return prune.flip_labels(prune.find_label_errors(pb(spark, folder), 2), 2).select("id", "s")


@query
def sample_weights(spark, folder):
    probs = pb(spark, folder)
    nm = latent.clip_rates(latent.noise_matrix(cj_of(probs, 2)), "y")
    return probs.withColumn("_w", latent.sample_weights(nm, 2)).select(
        "id", "s", r6(F.element_at("_w", F.col("s") + 1)).alias("weight"))


@query
def self_confidence_scores(spark, folder):
    return event_labels(spark, folder).select("id", r6(self_confidence("psx", "s")).alias("score"))


# ---------------------------------------------------------------- several labels per row

@query
def multilabel_joint(spark, folder):
    return joint.multilabel_joint(event_labels(spark, folder), EV_K, calibrate=False).select("s", "y", "n")


@query
def multilabel_joint_calibrated(spark, folder):
    return joint.multilabel_joint(event_labels(spark, folder), EV_K).select("s", "y", "n")


@query
def multilabel_f1(spark, folder):
    curve = multilabel.micro_f1_curve(event_labels(spark, folder), EV_K)
    return curve.select(F.round("boundary", 2).alias("boundary"), "tp", "fp", "fn", r6("f1").alias("f1"))


@query
def multilabel_predict(spark, folder):
    out = multilabel.predict(event_labels(spark, folder), EV_K)
    return out.select("id", F.round("boundary", 2).alias("boundary"),
                      F.array_join(ml.from_onehot("predicted"), ",").alias("predicted"))


@query
def multilabel_errors(spark, folder):
    return prune.find_label_errors(event_labels(spark, folder), EV_K, multi_label=True).select("id", "is_error")


# ---------------------------------------------------------------- label correction

def _relabelled(use_silent: bool, use_latent: bool) -> Query:
    def run(spark, folder):
        out = relabel.relabel(label_rows(spark, folder), silent_rows(spark, folder) if use_silent else None,
                              latent_rows(spark, folder) if use_latent else None)
        return out.select("file", "release", "vulnerable", "label_source")
    return run


REGISTRY["silent_relabel"] = _relabelled(True, False)
REGISTRY["latent_relabel"] = _relabelled(False, True)
REGISTRY["composite_relabel"] = _relabelled(True, True)


@query
def hidden_positives(spark, folder):
    out = relabel.hidden_positives(label_rows(spark, folder), silent_rows(spark, folder), latent_rows(spark, folder))
    return out.groupBy("release", "vulnerable", "hidden_positive").agg(F.count(F.lit(1)).alias("n"))


@query
def release_splits(spark, folder):
    return relabel.split_map(label_rows(spark, folder))


@query
def file_stem(spark, folder):
    p = table(spark, folder, "pages")
    return p.select(F.col("page_id").alias("id"), text.file_path("url").alias("file"), text.file_stem(text.file_path("url")).alias("stem"))


@query
def metric_rollup(spark, folder):
    """Orders as files (stem = customer), their items as functions, and a customer's items as classes."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    items = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("double")
    files = o.select(F.lit("File").alias("Kind"), F.col("o_orderkey").alias("file"), F.lit(None).cast("bigint").alias("stem"),
                     F.col("o_totalprice").alias("price"), none.alias("quantity"), none.alias("discount"), none.alias("tax"))
    functions = li.select(F.lit("Public Function").alias("Kind"), F.col("l_orderkey").alias("file"), F.lit(None).cast("bigint").alias("stem"),
                          none.alias("price"), none.alias("quantity"), none.alias("discount"), F.col("l_tax").alias("tax"))
    classes = items.select(F.lit("Public Class").alias("Kind"), F.lit(None).cast("bigint").alias("file"), F.col("o_custkey").alias("stem"),
                           none.alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), none.alias("tax"))
    raw = files.unionByName(functions).unionByName(classes).withColumn("row_order", F.coalesce("file", "stem"))
    labels = o.select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("cust"))
    out = rollup.roll_up(labels, raw, "row_order", ["price"], ["quantity"], ["discount"], ["tax"], by=(), label_stem="cust")
    return out.select("file", *[r6(c).alias(c.lower()) for c in ["price", "quantity", "discount", "tax_Min", "tax_Mean", "tax_Max"]])


# ---------------------------------------------------------------- text

@query
def clean_code(spark, folder):
    return pages(spark, folder).select("id", text.clean_code("html").alias("code"))


@query
def replace_tokens(spark, folder):
    return pages(spark, folder).select("id", text.replace_tokens(text.clean_code("html")).alias("code"))


@query
def token_counts(spark, folder):
    return vocabulary.token_counts(page_tokens(spark, folder))


@query
def vocab_topk(spark, folder):
    return vocabulary.vocabulary(vocabulary.token_counts(page_tokens(spark, folder)))


@query
def bow_l2(spark, folder):
    counts = settle(vocabulary.token_counts(page_tokens(spark, folder)))
    return vocabulary.l2_weights(counts, vocabulary.vocabulary(counts)).select("id", "token", r6("w").alias("w"))


# ---------------------------------------------------------------- evaluation

@query
def binary_metrics(spark, folder):
    return evaluate.binary_metrics(scored(spark, folder), places=6)


@query
def pu_scores(spark, folder):
    m = evaluate.binary_metrics(scored(spark, folder), places=6)
    return m.select("recall", "gmean_pu", "recall_score")


@query
def hidden_recall(spark, folder):
    return evaluate.recall_on(scored(spark, folder), "hidden_positive").select(r6("recall_u").alias("recall_u"))


@query
def overall_recall(spark, folder):
    df = scored(spark, folder).withColumn("truth", (F.col("label") == 1) | F.col("hidden_positive"))
    return evaluate.recall_on(df, "truth", name="recall_o").select(r6("recall_o").alias("recall_o"))


@query
def pu_f1(spark, folder):
    return evaluate.pu_f1_estimate(scored(spark, folder), "label", "p").select(r6("pu_f1").alias("pu_f1"))


@query
def transductive_scores(spark, folder):
    """All releases at once; a row counts as reliable unless its part size is a multiple of 3."""
    rows = relabel.relabel(label_rows(spark, folder), silent_rows(spark, folder), latent_rows(spark, folder), value=2)
    rows = rows.withColumn("reliable", (F.col("file") + F.col("release")) % 3 != 0)
    return evaluate.transductive_scores(rows, ["release"], places=6)


@query
def roc_points(spark, folder):
    roc = evaluate.roc_points(scored(spark, folder))
    return roc.select("score", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query
def youden_threshold(spark, folder):
    roc = evaluate.roc_points(scored(spark, folder))
    return evaluate.youden_threshold(roc, places=9).select("threshold", r6("j").alias("j"))


@query
def exact_auc(spark, folder):
    return evaluate.exact_auc(scored(spark, folder)).select(r6("auc").alias("auc"))


@query
def best_trial(spark, folder):
    """Best probability cut by the tuning score, among ten tried on all rows in one pass."""
    df = scored(spark, folder)
    tried = df.select("label", "p", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("trial"))
    tried = tried.withColumn("predicted", (F.col("p") >= F.col("trial") / 10.0).cast("int"))
    m = evaluate.binary_metrics(tried, by=["trial"], places=6).withColumn("score", F.col("mcc"))
    return evaluate.best_trial(m).select("trial", "score")


@query
def precision_at_k(spark, folder):
    return evaluate.precision_at_k(pe(spark, folder), 3).select(r6("precision").alias("precision"))


# ---------------------------------------------------------------- positive-unlabelled

def pu_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).withColumn("s", (F.col("s") == 0).cast("int"))


@query
def centroids(spark, folder):
    c = pu.centroids(vectors(spark, folder))
    return c.select("s", "n", F.posexplode("c").alias("i", "v")).select("s", "n", "i", r6("v").alias("v"))


def _distances(metric: str) -> Query:
    def run(spark, folder):
        d = pu.with_centroid_distances(pu_vectors(spark, folder), metric)
        return d.select("id", "s", *[r6(F.element_at("d", c + 1)).alias(f"d{c}") for c in (0, 1)])
    return run


REGISTRY["centroid_distances"] = _distances("cosine")
REGISTRY["centroid_distances_euclidean"] = _distances("euclidean")


@query
def reliable_negatives(spark, folder):
    return pu.reliable_rows(pu.with_centroid_distances(pu_vectors(spark, folder)), 1.0).select("id", "s")


@query
def alpha_sweep(spark, folder):
    return pu.alpha_sweep(pu.with_centroid_distances(pu_vectors(spark, folder)))


# ---------------------------------------------------------------- sampling

@query
def stratified_folds(spark, folder):
    df = pl(spark, folder).select("id", "s")
    return sampling.stratified_folds(df, 5, key=arithmetic_key("id", 42)).select("id", "s", "fold")


@query
def noise_injection(spark, folder):
    nm = frames.matrix_frame(spark, [[0.8, 0.1, 0.0], [0.15, 0.85, 0.3], [0.05, 0.05, 0.7]], "p")
    df = pl(spark, folder).select("id", F.col("s").alias("y"))
    return sampling.inject_noise(df, nm, PL_K, key=arithmetic_key("id", 7)).select("id", "y", "s")


@query
def oversample(spark, folder):
    df = pb(spark, folder).select("id", "s")
    return sampling.oversample(df, 2, key=arithmetic_key("id", 3)).select("id", "s", "copy")


@query
def hold_out(spark, folder):
    df = pb(spark, folder).select("id", "s")
    return sampling.hold_out_positives(df, key=arithmetic_key("id", 5)).select("id", "s", "held_out")


@query
def bags(spark, folder):
    df = pb(spark, folder).select("id", "s")
    b = sampling.bag_of_row(15, key=arithmetic_key("id", 9))
    return df.where("s = 0").groupBy(b.alias("bag")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query
def class_weights(spark, folder):
    """Weights by class as a fit computes them, balanced and as a ratio."""
    df = pb(spark, folder).select("id", "s")
    return df.groupBy("s").agg(F.count(F.lit(1)).alias("n"), *[
        r6(F.max(balanced.class_weight(df, "s", how))).alias(how) for how in ("balanced", "ratio")])


@query
def balanced_bags(spark, folder):
    """Rows of every bag of a balanced forest; all bags together hold each row of the larger class once."""
    df = settle(pb(spark, folder).select("id", "s"))
    small, n_bags = balanced.BalancedForest(RandomForestClassifier(numTrees=50)).plan(df)
    own = [balanced.bag_of("s", small, b, n_bags, arithmetic_key("id", 11)) for b in range(n_bags)]
    sums = df.agg(*[F.struct(F.lit(b).alias("bag"), F.count_if(c & (F.col("s") == small)).alias("small"), F.count_if(c).alias("n"),
                             F.sum(F.when(c, F.col("id"))).alias("id_sum")).alias(f"b{b}") for b, c in enumerate(own)])
    return sums.select(F.inline(F.array(*sums.columns)))


# ---------------------------------------------------------------- learning (no SQL counterpart)

def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as ``id, s, features``: label 0 is positive, half of the positives are unlabelled."""
    v = pu_vectors(spark, folder)
    s = F.when((F.col("s") == 1) & (F.col("id") % 2 == 0), 1).otherwise(0)
    return settle(v.select("id", s.cast("int").alias("s"), array_to_vector(F.col("x").cast("array<double>")).alias("features")))


@query
def cv_probabilities(spark, folder):
    rows = feature_rows(spark, folder)
    out = crossval.cross_val_probabilities(rows, LogisticRegression(labelCol="s", maxIter=10), 3)
    return out.select("id", "s", "fold", r6(F.element_at("psx", 2)).alias("p"))


@query
def noisy_label_fit(spark, folder):
    rows = feature_rows(spark, folder)
    clf = noisy_labels.NoisyLabelClassifier(LogisticRegression(maxIter=10), labelCol="s", cleanClass=1, numFolds=3)
    model = clf.fit(rows)
    return models.positive_score(model.transform(rows)).select("id", "s", r6("p").alias("p"))


@query
def elkan_noto(spark, folder):
    rows = feature_rows(spark, folder)
    return pu_models.ElkanNoto(LogisticRegression(labelCol="s", maxIter=10)).fit(rows).transform(rows).select("id", "s", r6("p").alias("p"))


@query
def bagging_pu(spark, folder):
    rows = feature_rows(spark, folder)
    model = pu_models.BaggingPU(LogisticRegression(labelCol="s", maxIter=5), parallelism=4).fit(rows)
    return model.transform(rows).select("id", "s", r6("p").alias("p"))


@query
def two_stage_pu(spark, folder):
    rows = feature_rows(spark, folder)
    model = pu_models.TwoStagePU(LogisticRegression(labelCol="s", maxIter=5)).fit(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"))
    return model.transform(rows).select("id", "s", r6("p").alias("p"))


@query
def label_propagation(spark, folder):
    rows = feature_rows(spark, folder)
    model = pu_models.LabelPropagation(LogisticRegression(labelCol="s", maxIter=5)).fit(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"))
    return model.transform(rows).select("id", "s", r6("p").alias("p"))


@query
def one_class(spark, folder):
    rows = feature_rows(spark, folder)
    model, _ = pu_models.tune_one_class(rows.where("s = 1"), rows, [0.05, 0.1, 0.2, 0.4])
    return model.transform(rows).select("id", "s", r6("density").alias("density"), "predicted")


@query
def tune_grid(spark, folder):
    rows = feature_rows(spark, folder)
    grid = [{"max_depth": d, "n_estimators": 5, "max_features": 0.3} for d in (2, 4)]
    return models.search("rf", rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), grid).trials


@query
def tune_confident_thresholds(spark, folder):
    rows = feature_rows(spark, folder)
    tuned = confident_tuning.tune(LogisticRegression(maxIter=5), rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), fit_folds=2)
    return tuned.model.errors


@query
def smote_rows(spark, folder):
    rows = pu_vectors(spark, folder).withColumn("x", F.col("x").cast("array<double>"))
    pick = lambda i: arithmetic_key(F.col("id") * 4096 + F.col("copy"), 20 + i)
    made = smote.smote(rows, key=arithmetic_key("id", 20), pick_key=pick)
    return made.select("id", "copy", "s", F.posexplode("x").alias("i", "v")).select("id", "copy", "s", "i", r6("v").alias("v"))


@query
def bow_vectors(spark, folder):
    """The bag-of-words pipeline on pages: sparse vectors of length 1."""
    docs = page_tokens(spark, folder).select(F.col("id").alias("file"), F.lit(63).alias("release"), "tokens")
    docs = settle(docs)
    out = feature_jobs.bag_of_words(docs).transform(docs)
    return out.select("file", F.size(F.filter(vector_to_array("features"), lambda v: v > 0)).alias("n_tokens"))


def make_hashing_encoder():
    """A stand-in for a pre-trained encoder: hashed character counts of the whole text."""
    import numpy as np

    def encode(texts):
        out = np.zeros((len(texts), 32), dtype=np.float32)
        for i, t in enumerate(texts):
            codes = np.frombuffer(str(t).encode("utf-8"), dtype=np.uint8)
            out[i] = np.bincount(codes % 32, minlength=32)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1.0)

    return encode


@query
def embed_text(spark, folder):
    ship_package(spark)
    return feature_jobs.embed(pages(spark, folder), make_hashing_encoder, "html").select("id", "features")


@query
def labelled_text_scan(spark, folder):
    """Documents written as labelled text to the shared folder and read back."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/labelled-text-{uuid.uuid4().hex}"
    labelled_text.write_labelled_text(docs, path, "toxic", "text")
    return labelled_text.read_labelled_text(spark, path)
