import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.functions.ordering import arithmetic_key, hash_key
from labelsift.operators import evaluate, frames, joint, rank, sampling
from labelsift.plans import neighbours, smote


@pytest.fixture(scope="module")
def skewed(spark):
    """70 % of the rows in one class."""
    return spark.range(20000).select("id", F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).otherwise(2).cast("int").alias("s")).persist()


def test_nth_largest_exact(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.random(4000), np.full(2000, 0.5), rng.random(2000) * 1e-9])
    g = rng.integers(0, 2, len(v))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "s int, v double").persist()
    for m in (1, 7, 1000, 2500):
        for cells in (8, 200_000):
            got = rank.nth_largest(df, ["s"], "v", [{"s": 0, "m": m}, {"s": 1, "m": m}], (-1.0, 1.0), cells=cells)
            assert {r["s"]: r["cut"] for r in got} == {k: np.sort(v[g == k])[::-1][m - 1] for k in (0, 1)}


@pytest.mark.parametrize("shared", [False, True])
def test_first_rows_equal_a_window(skewed, shared):
    """Also when thousands of rows share a key: then the id decides."""
    key = F.pmod("id", F.lit(5)) * 1000 if shared else arithmetic_key("id", 3)
    wanted = [{"g": 0, "band": 0, "m": 4321}, {"g": 0, "band": 1, "m": 9000}, {"g": 1, "band": 0, "m": 1}, {"g": 2, "band": 0, "m": 2000}]
    df, inside = rank.within(skewed, rank.first_rows(skewed, "s", key, wanted), "s", key, 3, 2)
    got = df.select("id", "s", inside[0].alias("a"), inside[1].alias("b"))
    rn = F.row_number().over(W.partitionBy("s").orderBy(key, "id"))
    m = F.when(F.col("s") == 0, 4321).when(F.col("s") == 1, 1).otherwise(2000)
    want = skewed.withColumn("rn", rn).select("id", (F.col("rn") <= m).alias("wa"), ((F.col("s") == 0) & (F.col("rn") <= 9000)).alias("wb"))
    assert got.join(want, "id").where("a <> wa or b <> wb").count() == 0


def test_folds_do_not_move_rows(skewed):
    plan = sampling.stratified_folds(skewed, 5, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Window" not in plan


def test_repeat_blocks(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 2500)], "id bigint, n int")
    out = sampling.repeat(df, F.col("n"))
    got = {r["id"]: (r["c"], r["lo"], r["hi"]) for r in out.groupBy("id").agg(
        F.countDistinct("copy").alias("c"), F.min("copy").alias("lo"), F.max("copy").alias("hi")).collect()}
    assert got == {1: (5, 1, 5), 3: (2500, 1, 2500)} and out.count() == 2505


def test_running_totals_with_hot_value(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 9000.0).alias("p"), (F.col("id") % 2).alias("label"))
    got = sorted((r["p"], r["n_before"]) for r in rank.running_totals(df, "p", {"n": F.lit(1)}, descending=True, ranges=16).collect())
    values = np.array([r["p"] for r in df.collect()])
    assert all(b == (values > p).sum() for p, b in got[::97])


def test_global_rank(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    got = rank.global_rank(df, [F.col("v"), F.col("id")])
    want = df.withColumn("want", F.row_number().over(W.partitionBy().orderBy("v", "id")))
    assert got.join(want, "id").where("rank <> want").count() == 0


def test_auc_and_youden_against_direct(spark):
    rng = np.random.default_rng(1)
    p = rng.random(1500).round(2)
    y = (rng.random(1500) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, p double")
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.exact_auc(df, ranges=8).first()["auc"] == pytest.approx(auc)
    j = {t: (pos >= t).mean() - (neg >= t).mean() for t in np.unique(p)}
    best = max(j.values())
    row = evaluate.youden_threshold(evaluate.roc_points(df, ranges=8)).first()
    assert row["j"] == pytest.approx(best) and row["threshold"] == max(t for t, v in j.items() if v > best - 1e-12)


def test_youden_without_signal(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.9)], "label int, p double")
    assert evaluate.youden_threshold(evaluate.roc_points(df)).first()["threshold"] == pytest.approx(1.9)
    one = spark.createDataFrame([(1, 0.1), (1, 0.9)], "label int, p double")
    assert evaluate.exact_auc(one).first()["auc"] == 0.0


def test_stratified_folds_even(skewed):
    sizes = sampling.stratified_folds(skewed, 5).groupBy("s", "fold").count().groupBy("s").agg(
        (F.max("count") - F.min("count")).alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["d"] <= 1 and r["n"] == 5 for r in sizes)


def test_noise_injection_counts(spark, skewed):
    nm = [[0.8, 0.3, 0.0], [0.2, 0.6, 0.5], [0.0, 0.1, 0.5]]
    rows = skewed.withColumnRenamed("s", "y")
    out = sampling.inject_noise(rows, frames.matrix_frame(spark, nm, "p"), 3)
    got = {(r["s"], r["y"]): r["count"] for r in out.groupBy("s", "y").count().collect()}
    n = {0: 14000, 1: 4000, 2: 2000}
    for s in range(3):
        for y in range(3):
            if s != y:
                assert abs(got.get((s, y), 0) - nm[s][y] * n[y]) <= 1
    assert out.count() == 20000


def test_oversample_balances(skewed):
    out = sampling.oversample(skewed, 3).groupBy("s").count().collect()
    assert {r["count"] for r in out} == {14000}


def test_hold_out_and_bags(skewed):
    pu = skewed.withColumn("s", (F.col("s") == 1).cast("int"))
    held = sampling.hold_out_positives(pu, 0.2)
    assert held.count() == 20000 and held.where("held_out").count() == 800 and held.where("held_out and s = 0").count() == 0
    sizes = [sampling.bag(pu, b, 15).groupBy("s").count().collect() for b in (0, 14)]
    for rows in sizes:
        n = {r["s"]: r["count"] for r in rows}
        assert n[1] == 4000 and abs(n[0] - 16000 / 15) < 200


def test_hash_key_range(spark):
    row = spark.range(5000).select(hash_key(1, "id").alias("k")).agg(F.min("k"), F.max("k")).first()
    assert row[0] >= 0 and row[1] < 1 << 32


def test_smote_exact_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    minority = [(100 + i, 1, [float(v) for v in 5 + rng.normal(size=3)]) for i in range(20)]
    minority += [(200 + i, 1, [9.0, 9.0, 9.0]) for i in range(5)]
    df = spark.createDataFrame(rows + minority, "id bigint, s int, x array<double>")
    made = smote.smote(df).collect()
    assert len(made) == 60 - 25 and {r["s"] for r in made} == {1}
    base = {i: np.array(x) for i, _, x in minority}
    points = {i: x for i, x in base.items()}
    for r in made:
        x = np.array(r["x"])
        others = sorted((np.linalg.norm(base[r["id"]] - p), i) for i, p in points.items() if i != r["id"])[:2]
        on_line = []
        for _, i in others:
            d, e = base[i] - base[r["id"]], x - base[r["id"]]
            u = 0.0 if not d.any() else float(e @ d / (d @ d))
            on_line.append(np.allclose(e, u * d) and -1e-9 <= u <= 1)
        assert any(on_line)


@pytest.mark.parametrize("chunk", [1024, 50])
def test_neighbours_are_exact(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    pts = np.concatenate([c + rng.normal(size=(100, 3)) for c in rng.normal(size=(5, 3)) * 20])
    pts[10] = pts[11]  # a tie at distance 0
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "vid bigint, x array<double>")
    got = {r["vid"]: r["near"] for r in neighbours.nearest(df, 3).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {i: sorted(range(500), key=lambda j: (d[i, j], j))[:3] for i in range(500)}


def test_few_vectors_have_few_neighbours(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0]), (9, [1.0, 3.0])], "vid bigint, x array<double>")
    assert {r["vid"]: r["near"] for r in neighbours.nearest(df, 3).collect()} == {7: [9], 9: [7]}
    assert neighbours.nearest(df.limit(0), 3).count() == 0


def test_class_counts_include_empty(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "s int")
    assert {r["s"]: r["n"] for r in joint.class_counts(df, 4).collect()} == {0: 2, 1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("ids", ["large", "text"])
def test_first_rows_with_any_id_at_a_shared_key(spark, ids):
    big = [(1 << 62) + i for i in range(40)] + [-(1 << 62) - i for i in range(40)]
    rows = [(i if ids == "large" else f"file{i}.c", 0) for i in big]
    df = spark.createDataFrame(rows, f"id {'bigint' if ids == 'large' else 'string'}, s int")
    key = F.lit(5).cast("bigint")
    out, inside = rank.within(df, rank.first_rows(df, "s", key, [{"g": 0, "band": 0, "m": 17}]), "s", key, 1, 1)
    picked = [r["id"] for r in out.where(inside[0]).collect()]
    assert len(picked) == 17
    if ids == "large":
        assert sorted(picked) == sorted(big)[:17]
