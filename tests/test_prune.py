import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.operators import frames, joint, latent, multilabel, prune


def ids(df):
    return {r["id"] for r in df.where("is_error").select("id").collect()}


def brute(psx, s, counts, method, labels=None):
    """Direct masks from the prune counts (rows = given label)."""
    n, k = psx.shape
    size = np.bincount(s, minlength=k)
    rate, cls = np.zeros(n, bool), np.zeros(n, bool)
    for g in range(k):
        mine = s == g
        if size[g] <= 5:
            continue
        for j in range(k):
            if j != g and counts[g][j] > 0:
                margin = psx[:, j] - psx[:, g]
                rate |= mine & (margin >= np.sort(margin[mine])[::-1][counts[g][j] - 1])
        drop = size[g] - counts[g][g]
        if drop < size[g]:
            cls |= mine & (psx[:, g] < np.sort(psx[mine, g])[drop])
    mask = {"prune_by_noise_rate": rate, "prune_by_class": cls, "both": rate & cls}[method]
    return set(np.where(mask & (psx.argmax(axis=1) != s))[0])


@pytest.mark.parametrize("method", prune.METHODS)
def test_masks_equal_direct_masks(noisy, method):
    df, psx, s = noisy
    counts = latent.to_numpy(prune.prune_counts(joint.confident_joint(df, 3)), "n").astype(int)
    assert ids(prune.find_label_errors(df, 3, method=method)) == brute(psx, s, counts, method)


def test_both_is_the_conjunction(noisy):
    df = noisy[0]
    a, b, c = (ids(prune.find_label_errors(df, 3, method=m)) for m in prune.METHODS)
    assert c == a & b


def test_ten_row_masks(ten_rows):
    assert ids(prune.argmax_errors(ten_rows)) == {2}
    assert ids(prune.argmax_joint_errors(ten_rows, 3)) == {2}
    assert ids(prune.argmax_joint_errors(ten_rows, 3, calibrate=True)) == {2}


def test_five_row_argmax(make_probs):
    df = make_probs([(.9, .1, 0), (.6, .2, .2), (.3, .3, 4), (.1, .1, .8), (.4, .5, .1)], [0, 0, 1, 1, 2])
    assert ids(prune.argmax_errors(df)) == {2, 3, 4}


def test_small_classes_stay(make_probs):
    rng = np.random.default_rng(1)
    df = make_probs(rng.dirichlet([1, 1, 1], 12), [0, 1, 2] * 4)
    for m in prune.METHODS:
        assert ids(prune.find_label_errors(df, 3, method=m)) == set()


def test_prune_count_identities(spark):
    cj = frames.matrix_frame(spark, [[325, 16, 22], [47, 178, 10], [36, 8, 159]]).withColumn("class_n", F.lit(0).cast("bigint"))
    assert latent.to_numpy(prune.reduce_counts(cj, 1.0), "n").tolist() == [[325, 16, 22], [47, 178, 10], [36, 8, 159]]
    assert latent.to_numpy(prune.keep_at_least(cj, 5), "n").tolist() == [[325, 16, 22], [47, 178, 10], [36, 8, 159]]
    half = latent.to_numpy(prune.reduce_counts(cj, 0.5), "n")
    assert half.sum(axis=1) == pytest.approx([363, 235, 203], abs=2) and half[0, 1] == 8


def test_budget_removes_exactly_that_many(make_probs):
    """Distinct margins, two classes: the budget is the number of flagged rows before the veto."""
    rng = np.random.default_rng(2)
    p1 = rng.permutation(np.linspace(0.02, 0.98, 400))
    s = (rng.random(400) < p1).astype(int)
    df = make_probs(np.stack([1 - p1, p1], axis=1), s)
    counts = latent.to_numpy(prune.prune_counts(joint.confident_joint(df, 2), budget=[5, 5]), "n")
    assert counts[1, 0] == 5 and counts[0, 1] == 5
    assert len(ids(prune.find_label_errors(df, 2, budget=[5, 5]))) == 10


def test_heavily_repeated_probability(make_probs):
    """A third of all rows share one probability and one label."""
    rng = np.random.default_rng(3)
    psx = np.concatenate([np.tile([[0.3, 0.7]], (600, 1)), np.stack([1 - (u := rng.random(1200)), u], axis=1)])
    s = np.concatenate([np.zeros(600, int), (rng.random(1200) < psx[600:, 1]).astype(int)])
    df = make_probs(psx, s)
    counts = latent.to_numpy(prune.prune_counts(joint.confident_joint(df, 2)), "n").astype(int)
    for m in prune.METHODS:
        assert ids(prune.find_label_errors(df, 2, method=m)) == brute(psx, s, counts, m)


def test_orderings_cover_the_same_rows(noisy):
    flagged = prune.find_label_errors(noisy[0], 3)
    a = prune.order_label_errors(flagged).collect()
    b = prune.order_label_errors(flagged, "prob_given_label").collect()
    assert {r["id"] for r in a} == {r["id"] for r in b}
    for rows in (a, b):
        rows = sorted(rows, key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r["score"], r["id"]) for r in rows] == sorted((r["score"], r["id"]) for r in rows)


def test_prune_and_flip(make_probs):
    df = make_probs([(.5, .5)] * 4, [0, 1, 0, 1]).withColumn("is_error", F.col("id") < 2)
    assert [r["id"] for r in prune.prune_rows(df).orderBy("id").collect()] == [2, 3]
    assert [r["s"] for r in prune.flip_labels(df, 2).orderBy("id").collect()] == [1, 0, 0, 1]


def test_detection_quality(make_probs):
    """Well separated classes with 20 % wrong labels: most wrong labels are found."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 1500)
    psx = np.full((1500, 3), 0.05) + 0.85 * np.eye(3)[y] + rng.uniform(0, 0.02, (1500, 3))
    psx /= psx.sum(axis=1, keepdims=True)
    wrong = rng.random(1500) < 0.2
    s = np.where(wrong, (y + 1) % 3, y)
    found = ids(prune.find_label_errors(make_probs(psx, s), 3))
    mask = np.isin(np.arange(1500), list(found))
    assert (mask == wrong).mean() > 0.85


def test_multilabel_masks(make_probs):
    rng = np.random.default_rng(5)
    n, k = 800, 3
    psx = rng.random((n, k)).round(3)
    s = [sorted({int(c) for c in range(k) if rng.random() < psx[i, c]} or {int(psx[i].argmax())}) for i in range(n)]
    df = make_probs(psx, s)
    cj = joint.multilabel_joint(df, k)
    given = np.array([[c in r for c in range(k)] for r in s])
    t = np.array([psx[given[:, c], c].mean() for c in range(k)])
    raw = np.array([(psx[given[:, c]] >= t).sum(axis=0) for c in range(k)])
    assert latent.to_numpy(joint.multilabel_joint(df, k, calibrate=False), "n").tolist() == raw.tolist()
    assert latent.to_numpy(cj, "n").sum(axis=1).tolist() == given.sum(axis=0).tolist()
    counts = latent.to_numpy(prune.prune_counts(cj), "n").astype(int)
    f1 = []
    for b in multilabel.BOUNDARIES:
        p = psx > b
        f1.append(2 * (p & given).sum() / (p.sum() + given.sum()))
    best = multilabel.BOUNDARIES[int(np.argmax(f1))]
    assert multilabel.predict(df, k).first()["boundary"] == best
    want = np.zeros(n, bool)
    for g in range(k):
        mine = given[:, g]
        for j in range(k):
            if j != g and counts[g][j] > 0:
                margin = psx[:, j] - psx[:, g]
                want |= mine & (margin >= np.sort(margin[mine])[::-1][min(counts[g][j], mine.sum()) - 1])
    want &= ~((psx > best) == given).all(axis=1)
    assert ids(prune.find_label_errors(df, k, multi_label=True)) == set(np.where(want)[0])


def test_flagging_shuffles_no_rows(noisy):
    """Past the class-sized work, flags are a projection: no exchange, no cross product."""
    plan = prune.find_label_errors(noisy[0], 3)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("+- InMemoryTableScan")[0]
    assert "Exchange" not in main and "CartesianProduct" not in plan and "NestedLoop" not in plan
