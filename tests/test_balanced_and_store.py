import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelsift.functions.ordering import hash_key
from labelsift.operators import evaluate
from labelsift.plans import balanced, models, noisy_labels, pu_models
from labelsift.session import released, settle
from labelsift.sources import model_store


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows, one in eight positive, two features; a fifth of the positives unlabelled."""
    rng = np.random.default_rng(9)
    y = (np.arange(600) % 8 == 0).astype(int)
    x = rng.normal(size=(600, 2)) + y[:, None] * 2.5
    s = np.where((y == 1) & (np.arange(600) % 5 == 0), 0, y)
    data = [(i, int(a), int(b), v.tolist()) for i, (a, b, v) in enumerate(zip(s, y, x))]
    return spark.createDataFrame(data, "id bigint, s int, y int, x array<double>").withColumn("features", array_to_vector("x")).drop("x").cache()


def test_bags_use_every_row(rows):
    forest = balanced.BalancedForest(RandomForestClassifier(numTrees=20, maxDepth=3))
    small, n_bags = forest.plan(rows)
    n1 = rows.where("s = 1").count()
    assert small == 1 and n_bags == round((600 - n1) / n1)
    seen = []
    for b in range(n_bags):
        bag = [(r["id"], r["s"]) for r in rows.where(balanced.bag_of("s", small, b, n_bags, hash_key(42, "id"))).collect()]
        assert sum(s for _, s in bag) == n1
        seen += [i for i, s in bag if s == 0]
    assert sorted(seen) == sorted(r["id"] for r in rows.where("s = 0").collect())
    model = forest.fit(rows)
    assert len(model.models) == n_bags and sum(m.getNumTrees for m in model.models) >= 20
    scored = models.positive_score(model.transform(rows))
    assert evaluate.exact_auc(scored.select(F.col("y").alias("label"), "p")).first()["auc"] > 0.9


def test_weights_belong_to_the_fit(rows):
    seen = []

    class Spy(LogisticRegression):
        def _fit(self, df):
            seen.append({r["s"]: r["w"] for r in df.groupBy("s").agg(F.max(self.getWeightCol()).alias("w")).collect()})
            return super()._fit(df)

    weighted = balanced.ClassWeighted(Spy(maxIter=2))
    weighted.fit(rows)
    n1 = rows.where("s = 1").count()
    assert seen[-1] == pytest.approx({0: 600 / (2 * (600 - n1)), 1: 600 / (2 * n1)})
    weighted.fit(rows.where("id < 100"))
    k = rows.where("id < 100 AND s = 1").count()
    assert seen[-1] == pytest.approx({0: 100 / (2 * (100 - k)), 1: 100 / (2 * k)})
    weighted.copy({weighted.weightCol: "noise"}).fit(rows.withColumn("noise", F.lit(2.0)))
    assert seen[-1] == pytest.approx({0: 600 / (600 - n1), 1: 600 / n1})


@pytest.mark.parametrize("given", [False, True])
@pytest.mark.parametrize("kind", ["lr", "brf"])
def test_noisy_label_classifier_takes_weighted_ones(rows, kind, given):
    classifier = models.make_classifier(kind, {"max_depth": 3, "n_estimators": 6})
    df = rows.withColumn("psx", F.expr("array(0.8d - 0.6d * y, 0.2d + 0.6d * y)")) if given else rows
    model = noisy_labels.NoisyLabelClassifier(classifier, labelCol="s", psxCol="psx" if given else "").fit(df)
    scored = models.positive_score(model.transform(rows))
    assert evaluate.exact_auc(scored.select(F.col("y").alias("label"), "p")).first()["auc"] > 0.9


def test_given_weight_column_is_carried(rows):
    df = rows.withColumns({"w": F.when(F.col("s") == 1, 5.0).otherwise(1.0), "psx": F.expr("array(0.8d - 0.6d * y, 0.2d + 0.6d * y)")})
    fit = lambda c: noisy_labels.NoisyLabelClassifier(c, labelCol="s", psxCol="psx").fit(df).model.intercept
    assert fit(LogisticRegression(weightCol="w")) > fit(LogisticRegression()) + 0.5


def test_save_and_load_score_alike(rows, spark, tmp_path):
    lr = models.make_classifier("lr", {})
    train, val = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    fitted = {
        "spark": lr.fit(train),
        "forest": models.make_classifier("brf", {"max_depth": 3, "n_estimators": 6}).fit(train),
        "noisy": noisy_labels.NoisyLabelClassifier(lr, labelCol="s").fit(train),
        "elkan": pu_models.ElkanNoto(lr).fit(train),
        "bagging": pu_models.BaggingPU(lr, n_bags=3).fit(train),
        "two": pu_models.TwoStagePU(lr, "euclidean", alphas=[1.0]).fit(train, val),
        "spread": pu_models.LabelPropagation(lr, "euclidean", alphas=[1.0]).fit(train, val),
        "one": pu_models.OneClass(nu=0.1, width=32).fit(train.where("s = 1")),
    }
    def score(model):
        out = model.transform(val)
        kept = [c for c in ("p", "density", "prediction", "predicted") if c in out.columns]
        return [float(v) for r in out.select("id", *kept).orderBy("id").collect() for v in r]

    for name, model in fitted.items():
        model_store.save(model, f"{tmp_path}/{name}")
        model_store.save(model, f"{tmp_path}/{name}")
        assert score(model_store.load(spark, f"{tmp_path}/{name}")) == pytest.approx(score(model)), name
    with pytest.raises(TypeError):
        model_store.save(object(), f"{tmp_path}/none")


def test_exact_quantiles(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("density"))
    assert pu_models.lower_quantiles(df, "density", [0.001, 0.0002, 0.5, 1.0]) == [4.0, 0.0, 2499.0, 4999.0]


def test_default_scale_counts_spread_between_features(spark):
    x = np.array([[0.0, 10.0], [1.0, 12.0], [2.0, 8.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(array_to_vector("x").alias("features"))
    model = pu_models.OneClass(width=20_000).fit_map(df)
    assert model.directions.std() == pytest.approx(np.sqrt(2.0 / (2 * x.var())), rel=0.02)


def test_scores_without_positives_or_rows(spark):
    df = spark.createDataFrame([(0, 0.7), (0, 0.1)], "s int, p double")
    assert evaluate.pu_f1_estimate(df).first()["pu_f1"] == 0.0
    assert np.isnan(evaluate.pu_f1_estimate(df.limit(0)).first()["pu_f1"])


def test_settled_frames_are_released(spark):
    with released():
        df = settle(spark.range(10))
        assert df.is_cached and df.count() == 10
    assert not df.is_cached
