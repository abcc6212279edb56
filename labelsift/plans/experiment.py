"""One experiment run: splits, label correction, tuning, technique, threshold, evaluation, sinks."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.operators import evaluate, frames, relabel
from labelsift.plans import confident_tuning, models, pu_models
from labelsift.plans.transductive import propagation_mask  # noqa: F401
from labelsift.session import in_parallel, released, settle
from labelsift.sources import model_store, results, tables


@dataclass
class Spec:
    release: int
    model: str
    feature: str
    technique: str


@dataclass
class Tables:
    """``features``: feature kind -> frame ``file, release, features``; for 'bow' a function of
    (release, part). The other frames are the label table and its side tables."""

    labels: DataFrame
    silent: DataFrame
    latent: DataFrame
    features: dict


def split(data: Tables, spec: Spec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows ``id, file, release, s, features``, aligned by key."""
    releases = relabel.split_releases(spec.release)
    if releases is None:
        raise ValueError(f"release {spec.release} has no run")
    out = []
    for r, part in zip(releases, ("", "_val", "_test")):
        labels = tables.at_release(data.labels, r)
        if part == "" and spec.technique == "manual_cleaning":
            labels = relabel.relabel(labels, data.silent, data.latent, value=1).drop("label_source")
        source = data.features[spec.feature]
        features = source(spec.release, part) if callable(source) else tables.at_release(source, r)
        rows = tables.align(features, labels).withColumn("id", F.xxhash64("file", "release"))
        out.append(settle(rows.withColumnRenamed("vulnerable", "s")))
    return tuple(out)


def run(data: Tables, spec: Spec, grid: list[dict], seed: int = 42, results_path: str | None = None,
        predictions_path: str | None = None, model_path: str | None = None, nus: list[float] | None = None,
        parallelism: int = 2) -> DataFrame:
    """Run one specification and return its result row (also appended to the sinks given). What the run settles is given up at its end."""
    if spec.technique not in results.TECHNIQUES:
        raise ValueError(f"unknown technique {spec.technique}")
    with released():
        return _run(data, spec, grid, seed, results_path, predictions_path, model_path, nus, parallelism)


def _run(data: Tables, spec: Spec, grid: list[dict], seed: int, results_path: str | None, predictions_path: str | None,
         model_path: str | None, nus: list[float] | None, parallelism: int) -> DataFrame:
    train, val, test = split(data, spec)
    metric = "euclidean" if spec.feature == "sm" else "cosine"
    if spec.technique == "oneclass":
        t0 = time.time()
        model, val_score = pu_models.tune_one_class(train.where("s = 1"), val, nus or [0.001, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5])
        val_time, train_time, params = time.time() - t0, 0.0, {"nu": model.nu}
        t0 = time.time()
        scored = model.transform(test).withColumn("p", F.lit(None).cast("double"))
    else:
        t0 = time.time()
        objective = "recall" if spec.technique == "regularize" else "auc"
        tuned = models.search(spec.model, train, val, grid, objective, seed, parallelism)
        val_time, val_score, params = time.time() - t0, tuned.score, dict(tuned.params)
        t0 = time.time()
        classifier = models.make_classifier(spec.model, tuned.params, seed, n_rows=train.count())
        model, extra = fit_technique(spec.technique, classifier, train, val, metric, seed, parallelism)
        params.update(extra)
        train_time = time.time() - t0
        scored_val = score(model, val).select(F.col("s").alias("label"), "p")
        cut = evaluate.youden_threshold(evaluate.roc_points(scored_val)).first()["threshold"]
        t0 = time.time()
        scored = score(model, test).withColumn("predicted", (F.col("p") >= cut).cast("int"))
    scored = settle(scored.select("file", "release", "s", "p", "predicted"))
    pred_time = (scored.count(), time.time() - t0)[1]
    row = frames.pinned(evaluate_run(scored, data, spec, params, val_score, (val_time, train_time, pred_time)))  # one row
    if predictions_path:
        keyed = scored.withColumn("test_release", F.col("release")).drop("release", "p").withColumnRenamed("s", "vulnerable")
        results.write_predictions(_with_key(keyed, spec), predictions_path)
    if model_path:
        model_store.save(model, f"{model_path}/r{spec.release}_{spec.model}_{spec.feature}_{spec.technique}")
    if results_path:  # last, so that a row stands for a run that has ended
        results.append_results(row, results_path)
    return row


def score(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out if "p" in out.columns else models.positive_score(out)


def fit_technique(technique: str, classifier, train: DataFrame, val: DataFrame, metric: str, seed: int,
                  parallelism: int) -> tuple[object, dict]:
    """The fitted model of a technique and what it adds to the parameters."""
    if technique in ("baseline", "manual_cleaning", "regularize"):
        return classifier.fit(train), {}
    if technique in ("pruning", "flipping"):
        tuned = confident_tuning.tune(classifier, train, val, flip=technique == "flipping", seed=seed, parallelism=parallelism)
        return tuned.model, tuned.params
    if technique == "adaptation":
        return pu_models.ElkanNoto(classifier, seed=seed).fit(train), {}
    if technique == "biased":
        return pu_models.BaggingPU(classifier, seed=seed, parallelism=parallelism).fit(train), {}
    if technique == "propagation1":
        two = pu_models.TwoStagePU(classifier, metric, parallelism=parallelism).fit(train, val)
        return two, {"alpha": two.alpha}
    plain = models.positive_score(classifier.fit(train).transform(val)).select(F.col("s").alias("label"), "p")
    cut = evaluate.youden_threshold(evaluate.roc_points(plain)).first()["threshold"]
    spread = pu_models.LabelPropagation(classifier, metric, cut, parallelism=parallelism).fit(train, val)
    return spread, {"alpha": spread.first.alpha}


def _with_key(df: DataFrame, spec: Spec) -> DataFrame:
    return (df.withColumn("release", F.lit(spec.release)).withColumn("classifier", F.lit(classifier_name(spec)))
            .withColumn("feature_type", F.lit(spec.feature)).withColumn("technique", F.lit(spec.technique)))


def evaluate_run(scored: DataFrame, data: Tables, spec: Spec, params: dict, val_score: float,
                 times: tuple[float, float, float]) -> DataFrame:
    """The result row of a run from its scored test rows ``file, release, s, p, predicted``."""
    release = scored.select("release").first()["release"]
    marked = relabel.hidden_positives(tables.at_release(data.labels, release), data.silent, data.latent)
    rows = scored.join(marked.select("file", "release", "hidden_positive"), ["file", "release"])
    metrics = evaluate.binary_metrics(rows, "s", "predicted")
    recall_u = evaluate.recall_on(rows, "hidden_positive").first()["recall_u"]
    auc = 0.0 if spec.technique == "oneclass" else float(
        evaluate.exact_auc(scored.select(F.col("s").alias("label"), "p")).first()["auc"])
    val_time, train_time, pred_time = times
    fixed = {"parameters": str(params), "val_auc": val_score, "auc": auc, "recall_u": recall_u, "val_time": val_time,
             "train_time": train_time, "pred_time": pred_time}
    for name, value in fixed.items():
        metrics = metrics.withColumn(name, F.lit(value if isinstance(value, str) else round(float(value), 3)))
    return _with_key(metrics, spec).select(*results.RESULT_COLUMNS)


def classifier_name(spec: Spec) -> str:
    return "ocsvm" if spec.technique == "oneclass" else spec.model


def run_grid(data: Tables, specs: list[Spec], grid: list[dict], results_path: str | None = None, runs_at_once: int = 2, **kwargs) -> DataFrame | None:
    """One result row for every run that exists; None where none does.

    ``runs_at_once`` runs go on at a time, each in a scheduler pool of its own (which share the executors under
    ``spark.scheduler.mode=FAIR``). A run appends its row when it has ended, so after an interruption the same call does the runs
    that ``results_path`` has no row of, and returns the stored rows of the others. A specification named twice is run once.
    """
    spark = data.labels.sparkSession
    wanted = {(s.release, classifier_name(s), s.feature, s.technique): s for s in specs if relabel.split_releases(s.release) is not None}
    stored = results.stored(spark, results_path) if results_path else None
    rows = []
    if stored is not None:
        stored = frames.pinned(stored.dropDuplicates(results.RUN_KEY))  # a row for each run
        done = {tuple(r) for r in stored.select(*results.RUN_KEY).collect()} & set(wanted)
        rows = [stored.where(F.struct(*results.RUN_KEY).isin([F.struct(*map(F.lit, k)) for k in done]))] if done else []
        wanted = {k: s for k, s in wanted.items() if k not in done}
    rows += in_parallel(spark, lambda s: run(data, s, grid, results_path=results_path, **kwargs), wanted.values(), runs_at_once, pool="run")
    out = None
    for r in rows:
        out = r if out is None else out.unionByName(r)
    return out


def transductive_report(data: Tables, feature: str, masks: dict[str, DataFrame], places: int | None = 3) -> DataFrame:
    """Precision, recall and PU score inside the training sets, all releases and techniques in one job.

    ``masks``: technique -> frame ``file, release, reliable``; see ``plans.transductive``.
    """
    truth = relabel.relabel(data.labels, data.silent, data.latent, value=2).drop("label_source")
    parts = None
    for technique, mask in masks.items():
        p = truth.join(mask.select("file", "release", "reliable"), ["file", "release"]).withColumn("technique", F.lit(technique))
        parts = p if parts is None else parts.unionByName(p)
    parts = parts.withColumn("feature_type", F.lit(feature)).where(~F.col("release").isin(*relabel.NO_RUN))
    return evaluate.transductive_scores(parts, ["release", "feature_type", "technique"], places)
