import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.functions.distance import cosine_distance, euclidean_distance
from labelsift.functions.multilabel import from_onehot, to_onehot
from labelsift.functions.probability import at_least, clip_rescale
from labelsift.operators import evaluate, joint, pu


def test_binary_metrics_golden(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    m = evaluate.binary_metrics(spark.createDataFrame(rows, "label int, predicted int"), places=None).first()
    p, r = 3 / 5, 3 / 4
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (3, 2, 1, 4)
    assert m["f1"] == pytest.approx(2 * p * r / (p + r)) and m["gmean"] == pytest.approx(math.sqrt(p * r))
    assert m["mcc"] == pytest.approx((3 * 4 - 2 * 1) / math.sqrt(5 * 4 * 6 * 5))
    assert m["gmean_pu"] == pytest.approx(10 * r * r / 5) and m["recall_score"] == pytest.approx(10 * r * r / 4)


def test_metrics_without_positives(spark):
    m = evaluate.binary_metrics(spark.createDataFrame([(0, 0)], "label int, predicted int")).first()
    assert (m["precision"], m["recall"], m["f1"], m["mcc"], m["gmean_pu"]) == (0, 0, 0, 0, None)


def test_pu_f1(spark):
    df = spark.createDataFrame([(1, 1.0)] * 3 + [(0, 0.0)] * 3, "s int, p double")
    assert evaluate.pu_f1_estimate(df).first()[0] == 1.0
    none = spark.createDataFrame([(1, 0.1)], "s int, p double")
    assert math.isnan(evaluate.pu_f1_estimate(none).first()[0])


def test_transductive(spark):
    df = spark.createDataFrame([(63, 1, False), (63, 2, False), (63, 2, True), (63, 0, False), (63, 0, True), (64, 2, True)],
                               "release int, vulnerable int, reliable boolean")
    got = {r["release"]: tuple(r)[1:] for r in evaluate.transductive_scores(df, ["release"]).collect()}
    assert got[63] == (0.5, 0.5, 0.5) and got[64] == (0.0, 0.0, 0.0)


def test_best_trial_first_on_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.7), (2, 0.7)], "trial int, score double")
    assert evaluate.best_trial(df).first()["trial"] == 1


def test_precision_at_k_monotone(noisy):
    v = [evaluate.precision_at_k(noisy[0], k).first()[0] for k in (1, 2, 3)]
    assert v[0] <= v[1] <= v[2] == 1.0
    assert v[0] == pytest.approx((noisy[1].argmax(axis=1) == noisy[2]).mean())


def test_weighted_accuracy(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (0, 1.0, 1.0)], "label int, prediction double, w double")
    assert evaluate.weighted_accuracy(df).first()[0] == 0.5 and evaluate.weighted_accuracy(df, weight="w").first()[0] == 0.75


def test_expressions(spark):
    df = spark.createDataFrame([([0, 2], [0.2, 0.9, -0.1], 0.5)], "s array<int>, v array<double>, p double")
    row = df.select(to_onehot("s", 3).alias("o"), from_onehot(to_onehot("s", 3)).alias("b"), clip_rescale("v").alias("c"),
                    clip_rescale("v", total=None).alias("keep"), at_least("p", 0.5).alias("hit")).first()
    assert list(row["o"]) == [1, 0, 1] and row["b"] == [0, 2] and row["hit"] == 1
    assert row["c"] == pytest.approx([0.2 / 1.1, 0.9 / 1.1, 0.0]) and sum(row["keep"]) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 5)), rng.normal(1, 1, (50, 5))])
    s = np.array([0] * 200 + [1] * 50)
    return spark.createDataFrame([(i, int(a), [float(v) for v in row]) for i, (a, row) in enumerate(zip(s, x))], "id bigint, s int, x array<double>").persist(), x, s


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_distances_and_reliable_rows(points, metric):
    df, x, s = points
    c = np.stack([x[s == k].mean(axis=0) for k in (0, 1)])
    if metric == "cosine":
        want = 1 - (x @ c.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1)
    else:
        want = np.linalg.norm(x[:, None] - c[None], axis=2)
    near = pu.with_centroid_distances(df, metric)
    got = np.array([r["d"] for r in near.orderBy("id").collect()])
    assert got == pytest.approx(want)
    for alpha in (0.8, 1.0):
        keep = {r["id"] for r in pu.reliable_rows(near, alpha).collect()}
        assert keep == set(np.where((want[:, 0] < alpha * want[:, 1]) | (s == 1))[0])
    sweep = {r["alpha"]: r["kept"] for r in pu.alpha_sweep(near).collect()}
    assert sweep[1.0] == len(keep) and list(sweep) == pu.ALPHAS
    pair = {"cosine": cosine_distance, "euclidean": euclidean_distance}[metric]
    one = df.where("id = 0").select(pair("x", F.array(*[F.lit(float(v)) for v in c[0]])).alias("d")).first()["d"]
    assert one == pytest.approx(want[0, 0])


def test_imbalance(points):
    assert joint.imbalance_ratio(joint.class_counts(points[0], 2)).first()["ratio"] == 4.0
