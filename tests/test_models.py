import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labelsift.operators import evaluate, frames, latent
from labelsift.plans import confident_tuning, crossval, experiment, models, noisy_labels, pu_models
from labelsift.session import ship_package
from labelsift.sources import results


def frame(spark, x, s, y):
    df = spark.createDataFrame([(i, int(a), int(b), [float(v) for v in row]) for i, (a, b, row) in enumerate(zip(s, y, x))],
                               "id bigint, s int, y int, x array<double>")
    return df.select("id", "s", "y", array_to_vector("x").alias("features")).persist()


@pytest.fixture(scope="module")
def gaussians(spark):
    """Three Gaussian classes with a quarter of the labels wrong."""
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1, 2], [200, 100, 100])
    x = np.array([(3, 2), (7, 7), (0, 8)])[y] + rng.normal(size=(400, 2))
    wrong = rng.random(400) < 0.25
    s = np.where(wrong, (y + rng.integers(1, 3, 400)) % 3, y)
    return frame(spark, x, s, y)


@pytest.fixture(scope="module")
def positives(spark):
    """Two classes; half of the positives are unlabelled."""
    rng = np.random.default_rng(2)
    y = (rng.random(500) < 0.3).astype(int)
    x = np.where(y[:, None] == 1, 2.0, 0.0) + rng.normal(size=(500, 4))
    s = np.where((y == 1) & (rng.random(500) < 0.5), 1, 0)
    return frame(spark, x, s, y)


def auc_on_truth(df):
    return evaluate.exact_auc(df.select(F.col("y").alias("label"), "p")).first()["auc"]


def test_out_of_sample_probabilities(gaussians):
    out = crossval.cross_val_probabilities(gaussians, LogisticRegression(labelCol="s"), 3)
    assert out.count() == 400 and out.select("id").distinct().count() == 400
    assert out.where(F.abs(F.aggregate("psx", F.lit(0.0), lambda a, p: a + p) - 1) > 1e-9).count() == 0


@pytest.fixture(scope="module")
def fitted(gaussians):
    return noisy_labels.NoisyLabelClassifier(LogisticRegression(), labelCol="s", numFolds=3).fit(gaussians)


def test_noisy_label_classifier(gaussians, fitted):
    truth = gaussians.withColumnRenamed("s", "given").withColumnRenamed("y", "s")
    assert fitted.score(truth) > 0.95
    assert fitted.score(truth, weight="w") if "w" in truth.columns else True
    hits = fitted.errors.join(gaussians.select("id", "y"), "id").where("is_error = (s <> y)").count()
    assert hits / 400 > 0.85
    assert latent.to_numpy(fitted.noise_matrix).sum(axis=0) == pytest.approx([1, 1, 1])
    assert latent.to_numpy(fitted.joint, "n").sum() == 400


def test_save_parts(spark, fitted, tmp_path):
    fitted.save(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "errors")).count() == 400


def test_classifier_without_probabilities_is_refused():
    with pytest.raises(TypeError):
        noisy_labels.NoisyLabelClassifier(LinearSVC())
    with pytest.raises(TypeError):
        noisy_labels.NoisyLabelClassifier(object())


def test_given_matrices(spark, gaussians):
    for kind, bad in (("noise_matrix", [[0, 1, 0], [1, 0, 0], [0, 0, 1]]), ("inverse_noise_matrix", [[.1, .9, 0], [.9, .1, 0], [0, 0, .5]])):
        with pytest.raises(ValueError, match="must exceed 1"):
            noisy_labels.NoisyLabelClassifier(labelCol="s", numFolds=2, **{kind: frames.matrix_frame(spark, bad, "p")}).fit(gaussians)
    good = frames.matrix_frame(spark, [[.8, .1, .1], [.1, .8, .1], [.1, .1, .8]], "p")
    model = noisy_labels.NoisyLabelClassifier(labelCol="s", numFolds=2, noise_matrix=good).fit(gaussians)
    assert model.score(gaussians.drop("s").withColumnRenamed("y", "s")) > 0.95


def test_given_probabilities_and_flipping(positives):
    psx = crossval.cross_val_probabilities(positives, LogisticRegression(labelCol="s"), 3).drop("fold")
    for flip in (False, True):
        clf = noisy_labels.NoisyLabelClassifier(labelCol="s", psxCol="psx", cleanClass=1, flipLabels=flip)
        model = clf.fit(psx)
        assert model.errors.where("is_error and s = 1").count() == 0  # the clean class is never flagged
        assert latent.to_numpy(model.joint, "n")[1, 0] == 0
        assert auc_on_truth(models.positive_score(model.transform(positives))) > 0.85


def test_elkan_noto(positives):
    model = pu_models.ElkanNoto(LogisticRegression(labelCol="s")).fit(positives)
    assert 0 < model.c < 1 and auc_on_truth(model.transform(positives)) > 0.85


def test_bagging(positives):
    model = pu_models.BaggingPU(LogisticRegression(labelCol="s", maxIter=5), n_bags=4, parallelism=4).fit(positives)
    out = model.transform(positives)
    assert set(out.columns) == {*positives.columns, "p"} and auc_on_truth(out) > 0.85


def test_two_stage_and_propagation(positives):
    train, val = positives.where("id % 4 <> 0"), positives.where("id % 4 = 0")
    two = pu_models.TwoStagePU(LogisticRegression(labelCol="s"), "euclidean", alphas=[0.9, 1.1]).fit(train, val)
    assert two.alpha in (0.9, 1.1) and auc_on_truth(two.transform(positives)) > 0.85
    spread = pu_models.LabelPropagation(LogisticRegression(labelCol="s"), "euclidean", alphas=[1.0]).fit(train, val)
    assert auc_on_truth(spread.transform(positives)) > 0.85


def test_one_class(positives):
    model, score = pu_models.tune_one_class(positives.where("s = 1"), positives, [0.05, 0.2, 0.4])
    assert model.nu in (0.05, 0.2, 0.4) and score > 0
    out = model.transform(positives)
    recall = out.where("s = 1").agg(F.avg("predicted")).first()[0]
    assert recall == pytest.approx(1 - model.nu, abs=0.05)


def test_search_and_weights(positives):
    assert models.random_grid(3) == models.random_grid(3)
    grid = [{"max_depth": 2, "n_estimators": 3, "max_leaf_nodes": 50, "max_features": 0.5}, {"max_depth": 3, "n_estimators": 3}]
    for kind, objective in (("rf", "auc"), ("brf", "recall"), ("xgb", "auc")):
        tuned = models.search(kind, positives, positives, grid, objective)
        assert tuned.trials.count() == 2 and tuned.score == max(r["score"] for r in tuned.trials.collect())
    w = models.with_class_weights(positives).groupBy("s").agg(F.sum("weight").alias("w")).collect()
    assert w[0]["w"] == pytest.approx(w[1]["w"])
    with pytest.raises(ValueError):
        models.make_classifier("svm", {})


def test_confident_tuning(positives):
    tuned = confident_tuning.tune(LogisticRegression(maxIter=5), positives, positives, fit_folds=2)
    assert len(tuned.scores) == 5 and max(s for _, s in tuned.scores) == dict((str(c), s) for c, s in tuned.scores)[str(tuned.params)]


def test_package_is_shipped_once_by_many_threads():
    """Candidates are fitted in threads; Spark refuses a second file of the same name."""
    shipped = []
    context = SimpleNamespace(addPyFile=lambda path: time.sleep(0.3) or shipped.append(path))
    with ThreadPoolExecutor(4) as threads:
        list(threads.map(ship_package, [SimpleNamespace(sparkContext=context)] * 4))
    assert len(shipped) == 1 and context._labelsift_shipped


@pytest.fixture(scope="module")
def small_release_tables(spark):
    rng = np.random.default_rng(3)
    rows, feats = [], []
    for r in (63, 64, 65):
        for i in range(80):
            y = int(rng.random() < 0.3)
            rows.append((f"f{i}", r, y if rng.random() < 0.7 else 0))
            feats.append((f"f{i}", r, [float(v) for v in rng.normal(size=3) + 2 * y]))
    labels = spark.createDataFrame(rows, "file string, release int, vulnerable int").persist()
    features = spark.createDataFrame(feats, "file string, release int, x array<double>").select("file", "release", array_to_vector("x").alias("features")).persist()
    silent = spark.createDataFrame([("f1", 65), ("f2", 63)], "file string, release int")
    late = spark.createDataFrame([("f3", 60, 66)], "file string, first_appear int, last_appear int")
    return experiment.Tables(labels, silent, late, {"bert": features})


@pytest.mark.parametrize("technique", ["manual_cleaning", "pruning", "adaptation", "propagation1", "oneclass"])
def test_experiment_run(spark, small_release_tables, tmp_path, technique):
    grid = [{"max_depth": 2, "n_estimators": 3, "max_features": 0.5}]
    spec = experiment.Spec(63, "rf", "bert", technique)
    row = experiment.run(small_release_tables, spec, grid, results_path=str(tmp_path / "r"), predictions_path=str(tmp_path / "p"),
                         nus=[0.1, 0.3]).first()
    assert 0 <= row["accuracy"] <= 1 and row["technique"] == technique and row["recall_u"] >= 0
    assert results.read_results(spark, str(tmp_path / "r")).count() == 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 80


def test_no_run_release(small_release_tables):
    with pytest.raises(ValueError):
        experiment.split(small_release_tables, experiment.Spec(80, "rf", "bert", "baseline"))


def test_transductive_report(small_release_tables):
    rows = small_release_tables.features["bert"].join(small_release_tables.labels, ["file", "release"]).where("release = 63")
    mask = experiment.propagation_mask(rows.select("file", "release", F.col("vulnerable").alias("s"), vector_to_array("features").alias("x")))
    out = experiment.transductive_report(small_release_tables, "bert", {"propagation1": mask, "again": mask}).collect()
    assert len(out) == 2 and out[0]["recall"] == out[1]["recall"]


def test_grid_resumes_after_an_interruption(spark, small_release_tables, tmp_path, monkeypatch):
    grid = [{"max_depth": 2, "n_estimators": 2, "max_features": 0.5}]
    specs = [experiment.Spec(63, "rf", "bert", t) for t in ("baseline", "oneclass", "adaptation", "manual_cleaning", "regularize", "propagation1")]
    specs += [specs[0], experiment.Spec(80, "rf", "bert", "baseline")]  # named twice; no such run
    path, calls, real = str(tmp_path / "results"), [], experiment._run
    before = spark.sparkContext._jsc.getPersistentRDDs().size()

    def interrupted(data, spec, *args):
        calls.append(spec.technique)
        if len(calls) == 4:
            raise RuntimeError("stopped")
        return real(data, spec, *args)

    monkeypatch.setattr(experiment, "_run", interrupted)
    with pytest.raises(RuntimeError):
        experiment.run_grid(small_release_tables, specs, grid, path, runs_at_once=1, nus=[0.1, 0.3])
    assert results.read_results(spark, path).count() == 3
    out = experiment.run_grid(small_release_tables, specs, grid, path, runs_at_once=3, nus=[0.1, 0.3])
    assert sorted(r["technique"] for r in out.collect()) == sorted({s.technique for s in specs[:6]})
    assert sorted(calls) == sorted([s.technique for s in specs[:6]] + [calls[3]])
    stored = results.read_results(spark, path)
    assert stored.count() == 6 == stored.select(*results.RUN_KEY).distinct().count()
    again = experiment.run_grid(small_release_tables, specs, grid, path)
    assert again.count() == 6 and len(calls) == 7
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_embeddings_do_not_depend_on_what_shares_a_batch(spark):
    from labelsift.plans import feature_jobs

    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(2, 90, n).tolist()) for i, n in enumerate([0, 1, 700, 3, 40, 41, 5, 511, 512, 2] * 5)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, token_ids array<int>").repartition(3)
    table = rng.integers(-5, 6, (90, 4)).astype(float)

    def make(shapes=None):
        def encode(ids, mask):
            assert ids.shape == mask.shape and (mask.sum(axis=1) >= 1).all() and mask.sum(axis=1).max() == ids.shape[1]
            return (table[ids] * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]
        return encode

    for size in (1, 7, 64):
        got = {r["id"]: r["features"] for r in feature_jobs.embed_tokens(df, make, batch_size=size).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            cut = [1, *(t or [])][:512]
            assert got[i] == pytest.approx(table[cut].mean(axis=0).tolist())


def test_prior_forcing_changes_nothing(spark, noisy):
    from labelsift.operators import joint

    df, _, _ = noisy
    want = sorted(tuple(r) for r in joint.confident_joint(df, 3).select("s", "y", "n").collect())
    for j in joint.prior_forcing_joints(df, 3, rounds=3):
        assert sorted(tuple(r) for r in j.select("s", "y", "n").collect()) == want
    fixed = joint.prior_forcing_joints(df, 3, [0.2, 0.3, 0.4], rounds=2)
    assert sorted(tuple(r) for r in fixed[1].select("s", "y", "n").collect()) == sorted(
        tuple(r) for r in joint.confident_joint(df, 3, [0.2, 0.3, 0.4]).select("s", "y", "n").collect())


class Counted(LogisticRegression):
    """Counts its fits, copies included."""

    fits: list = []

    def _fit(self, df):
        Counted.fits.append(1)
        return super()._fit(df)


def test_nested_probabilities_share_the_models_of_fold_pairs(positives):
    Counted.fits.clear()
    clf = Counted(maxIter=5)
    got = confident_tuning.nested_probabilities(clf, positives, 3, seed=4)
    got = {r["id"]: (r["fold"], r["psx"]) for r in got.select("id", "fold", "psx").collect()}
    assert len(got) == positives.count() and len(Counted.fits) == 3 + 3
    for out in range(3):  # each learner by itself, with the same folds
        folded = crossval.sampling.stratified_folds(positives.select("id", "s", "features"), 3, seed=4)
        base, inside = LogisticRegression(maxIter=5, labelCol="s"), None
        for j in range(3):
            if j != out:
                part = base.fit(folded.where(~F.col("fold").isin(out, j))).transform(folded.where(F.col("fold") == j)).select(
                    "id", "s", "features", vector_to_array("probability").alias("psx"))
                inside = part if inside is None else inside.unionByName(part)
        model = noisy_labels.NoisyLabelClassifier(LogisticRegression(maxIter=5), labelCol="s", psxCol="psx", cleanClass=1, seed=4).fit(inside)
        for r in model.transform(folded.where(F.col("fold") == out)).select("id", vector_to_array("probability").alias("p")).collect():
            assert got[r["id"]][0] == out and got[r["id"]][1] == pytest.approx(list(r["p"]), abs=1e-6)
    Counted.fits.clear()
    tuned = confident_tuning.tune(clf, positives, positives, fit_folds=3, nested=True)
    assert len(tuned.scores) == 5 and len(Counted.fits) == 3 + 6 + 5
