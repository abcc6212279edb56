import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelsift.operators import prune, pu
from labelsift.plans import pu_models, transductive

COLUMNS = "file bigint, release int, s int, x array<double>"


@pytest.fixture(scope="module")
def releases(spark):
    """Releases of different sizes: one without positives, one of positives only, one row alone."""
    rng = np.random.default_rng(6)
    rows = []
    for r, n, share in ((61, 150, 0.3), (62, 90, 0.0), (63, 40, 1.0), (64, 1, 0.0), (65, 200, 0.4)):
        y = (rng.random(n) < share) if share < 1 else np.ones(n, bool)
        x = rng.normal(size=(n, 3)) + 1 + 1.5 * y[:, None]
        s = np.where(rng.random(n) < 0.25, ~y if 0 < share < 1 else y, y).astype(int)
        rows += [(i, r, int(a), [float(v) for v in row]) for i, (a, row) in enumerate(zip(s, x))]
    return spark.createDataFrame(rows, COLUMNS).repartition(4).persist()


def one(releases, r):
    return releases.where(F.col("release") == r)


def masked(df):
    return {(r["file"], r["release"]): r["reliable"] for r in df.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_propagation_of_all_releases_is_that_of_each(releases, metric):
    got = masked(transductive.propagation_mask(releases, metric, 0.9))
    assert len(got) == releases.count()
    for r in (61, 65):
        alone = pu.with_centroid_distances(one(releases, r), metric).select("file", "release", pu.is_reliable(0.9).alias("reliable"))
        assert all(got[k] == v for k, v in masked(alone).items())
    assert all(v for (_, r), v in got.items() if r in (62, 63, 64))
    assert not all(got.values())


def test_pruning_of_all_releases_is_that_of_each(releases):
    fold = F.col("file") % 3
    got = masked(transductive.pruning_mask(releases, fold, 3, method="both"))
    assert len(got) == releases.count()
    for r in (61, 65):
        p = transductive.centroid_probabilities(one(releases, r), fold, 3)
        probs = p.select(F.col("file").alias("id"), "file", "release", "s", F.array(1 - F.col("p"), "p").alias("psx"))
        alone = prune.find_label_errors(probs, 2, method="both").select("file", "release", (~F.col("is_error")).alias("reliable"))
        assert all(got[k] == v for k, v in masked(alone).items())
    assert all(v for (_, r), v in got.items() if r in (62, 63, 64)) and not all(got.values())


@pytest.mark.parametrize("method", prune.METHODS)
def test_rows_hold_their_own_release_only(spark, method):
    """What a row holds does not grow with the number of releases, and each is pruned as if it were alone."""
    rng = np.random.default_rng(8)
    rows = [(i, 100 + i % 30, int(rng.random() < 0.4), float(p)) for i, p in enumerate(rng.random(1_500).round(2))]
    scored = spark.createDataFrame(rows, "file bigint, release int, s int, p double").persist()
    probs, blocks = transductive.as_one_problem(scored, list(range(100, 130)))
    assert blocks == 30 and probs.select(F.max(F.size("psx"))).first()[0] == 2
    got = masked(prune.find_label_errors(probs, 2, method=method, blocks=blocks).withColumn("reliable", ~F.col("is_error")))
    for r in (100, 117):
        alone = one(scored, r).select(F.col("file").alias("id"), "file", "release", "s", F.array(1.0 - F.col("p"), "p").alias("psx"))
        want = masked(prune.find_label_errors(alone, 2, method=method).withColumn("reliable", ~F.col("is_error")))
        assert want == {k: v for k, v in got.items() if k[1] == r}
    assert not all(got.values())


def test_one_class_of_all_releases_is_that_of_each(releases):
    got = masked(transductive.one_class_mask(releases, nu=0.2, width=64, gamma=0.1, seed=5))
    for r in (61, 63, 65):
        rows = one(releases, r).withColumn("features", array_to_vector("x"))
        model = pu_models.OneClass(0.2, 64, 0.1, 5).fit_map(rows.where("s = 1"))
        scored = model.score(rows).withColumn("density", F.round("density", 9))
        model.set_cut(scored.where("s = 1"))
        alone = scored.select("file", "release", (F.col("density") < model.cut).alias("reliable"))
        assert all(got[k] == v for k, v in masked(alone).items())
    assert all(v for (_, r), v in got.items() if r in (62, 64)) and not all(got.values())


def test_no_rows(spark, releases):
    none = releases.limit(0)
    assert transductive.propagation_mask(none).count() == 0
    assert transductive.pruning_mask(none, F.lit(0), 2).count() == 0
    assert transductive.one_class_mask(none).count() == 0
