import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.operators import frames, joint, latent, validate


def matrix(df, value="n"):
    return latent.to_numpy(df, value)


def test_ten_row_golden_values(ten_rows):
    t = {r["s"]: r["t"] for r in joint.class_thresholds(ten_rows).collect()}
    assert t == pytest.approx({0: 0.75, 1: 0.6857142857, 2: 0.8})
    assert matrix(joint.confident_joint(ten_rows, 3, calibrate=False)).tolist() == [[1, 0, 0], [0, 6, 1], [0, 0, 1]]
    cj = joint.confident_joint(ten_rows, 3)
    assert matrix(cj).tolist() == [[2, 0, 0], [0, 6, 1], [0, 0, 1]]
    # 1 - trace is just under 0.1 in floating point, so the count truncates to 0.
    assert joint.num_label_errors(cj).first()[0] == 0


def test_calibrated_rows_match_class_counts(noisy):
    df, _, s = noisy
    cj = matrix(joint.confident_joint(df, 3))
    assert cj.sum(axis=1).tolist() == np.bincount(s).tolist()
    assert matrix(joint.joint_distribution(joint.confident_joint(df, 3)), "p").sum() == pytest.approx(1.0)


def test_confident_joint_equals_direct_count(noisy):
    df, psx, s = noisy
    t = np.array([psx[s == k, k].mean() for k in range(3)])
    conf = psx >= t - 1e-6
    want = np.zeros((3, 3))
    for c, row, label in zip(conf, psx, s):
        if c.any():
            want[label, c.argmax() if c.sum() == 1 else row.argmax()] += 1
    got = matrix(joint.confident_joint(df, 3, calibrate=False))
    assert got.tolist() == want.tolist()
    off = joint.off_diagonal_rows(df, 3).count()
    assert off == want.sum() - np.trace(want)


def test_guess_with_a_hundred_classes(spark, make_probs):
    rng = np.random.default_rng(4)
    psx = rng.dirichlet([0.05] * 100, 2000).round(3)
    s = np.array([rng.choice(100, p=p / p.sum()) for p in psx])
    t = np.array([psx[s == c, c].mean() if (s == c).any() else np.nan for c in range(100)])
    want = np.zeros((100, 100), int)
    for row, label in zip(psx, s):
        c = row >= t - 1e-6
        if c.any():
            want[label, c.argmax() if c.sum() == 1 else row.argmax()] += 1
    assert matrix(joint.confident_joint(make_probs(psx, s), 100, calibrate=False)).tolist() == want.tolist()


def test_rounding_keeps_row_totals(spark):
    m = frames.matrix_frame(spark, [[1.7, 1.8, 1.5], [1.1, 1.4, 1.5], [1.3, 1.3, 1.4]], "p")
    got = matrix(joint.round_keeping_totals(m, "p", "s", "y"), "p")
    assert got.sum(axis=1).tolist() == [5, 4, 4]
    ten = frames.matrix_frame(spark, [[1.1] * 10], "p")
    assert joint.round_keeping_totals(ten, "p", "s", "y").agg(F.sum("p")).first()[0] == 11


def test_class_without_confident_rows_is_clean(make_probs):
    df = make_probs([(.9, .1, 0), (.8, .2, 0), (.2, .8, 0), (.3, .7, 0)], [0, 0, 1, 1])
    cj = matrix(joint.confident_joint(df, 3))
    assert cj.shape == (3, 3) and cj[2].sum() == 0


def latent_fixture(spark):
    ps = frames.vector_frame(spark, [10 / 30, 5 / 30, 15 / 30])
    nm = frames.matrix_frame(spark, [[1.0, 0.0, 0.2], [0.0, 0.7, 0.2], [0.0, 0.3, 0.6]], "p")
    return ps, nm


def test_prior_inversion_golden(spark):
    ps, nm = latent_fixture(spark)
    py, inv = latent.prior_and_inverse(ps, nm)
    v = latent.vector_to_numpy(py, "y")
    assert v == pytest.approx([0.1665, 0.000999, 0.832501], abs=1e-5)
    i, p = latent.to_numpy(inv), latent.vector_to_numpy(ps, "s")
    assert i.T @ p == pytest.approx(v, abs=1e-3)
    assert latent.to_numpy(nm) @ v == pytest.approx(p, abs=1e-3)
    back = latent.to_numpy(latent.noise_from_inverse(ps, inv, py))
    assert back == pytest.approx(latent.to_numpy(nm), abs=1e-2)


@pytest.mark.parametrize("method", latent.PRIOR_METHODS)
def test_prior_methods_add_up(noisy, method):
    df = noisy[0]
    cj, ps = joint.confident_joint(df, 3), joint.prior(joint.class_counts(df, 3))
    py, nm, inv = latent.estimate_latent(cj, ps, method)
    assert latent.vector_to_numpy(py, "y").sum() == pytest.approx(1.0)
    assert latent.to_numpy(nm).sum(axis=0) == pytest.approx([1, 1, 1])
    assert latent.to_numpy(inv).sum(axis=1) == pytest.approx([1, 1, 1])


def test_unknown_prior_method(noisy):
    cj = joint.confident_joint(noisy[0], 3)
    with pytest.raises(ValueError):
        latent.latent_prior(joint.prior(joint.class_counts(noisy[0], 3)), cj, cj, "nope")
    with pytest.raises(ValueError):
        latent.latent_prior(joint.prior(joint.class_counts(noisy[0], 3)), cj, cj, "marginal")


def test_convergence_close_but_different(noisy):
    df = noisy[0]
    cj, ps = joint.confident_joint(df, 3), joint.prior(joint.class_counts(df, 3))
    a = latent.to_numpy(latent.estimate_latent(cj, ps)[1])
    b = latent.to_numpy(latent.estimate_latent(cj, ps, converge=True)[1])
    assert np.abs(a - b).max() < 0.1


def test_clean_posterior_rows_add_up(noisy):
    df = noisy[0]
    cj = joint.confident_joint(df, 3)
    nm, inv = latent.noise_matrix(cj), latent.inverse_noise_matrix(cj)
    out = {r["id"]: r["pyx"] for r in latent.clean_posterior(df, nm, inv, 3).collect()}
    assert all(abs(sum(v) - 1) < 1e-9 for v in out.values())
    f = {r["s"]: r["f"] for r in latent.posterior_factors(nm, inv).collect()}
    for r in df.limit(50).collect():
        terms = np.clip([p * f[c] for c, p in enumerate(r["psx"])], 0, 1)
        assert out[r["id"]] == pytest.approx((terms / terms.sum()).tolist())


def test_noise_free_class(spark):
    nm = frames.matrix_frame(spark, [[.9, 0, 0], [0, .7, .4], [.1, .3, .6]], "p")
    assert np.abs(latent.to_numpy(latent.remove_noise_from_class(nm, 0)) - latent.to_numpy(nm)).max() < 1e-4


def test_pu_constraint_and_budget(spark):
    from labelsift.operators import prune

    cj = frames.matrix_frame(spark, [[70, 30], [20, 80]]).withColumn("class_n", F.lit(100).cast("bigint"))
    fixed = latent.pu_constrain(cj, 1, "joint")
    assert matrix(fixed).tolist() == [[1, 30], [0, 80]]
    assert matrix(prune.prune_counts(fixed))[0, 1] == 26
    inv = latent.pu_constrain(latent.inverse_noise_matrix(cj), 1, "inv")
    assert matrix(inv, "p")[1].tolist() == [0, 1]
    nm = latent.pu_constrain(latent.noise_matrix(cj), 1, "nm")
    assert matrix(nm, "p")[:, 0].tolist() == [1, 0]


@pytest.mark.parametrize("nm,py,ok", [
    ([[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5], True),
    ([[0.5, 0.5], [0.5, 0.5]], [0.5, 0.5], False),
    ([[0.9, 0.1], [0.1, 0.9]], [0.5, 0.9], False),
])
def test_learnable(spark, nm, py, ok):
    got = latent.learnable(frames.matrix_frame(spark, nm, "p"), frames.vector_frame(spark, py, key="y"))
    assert got.first()["is_valid"] is ok


def test_input_checks(make_probs, spark):
    good = make_probs([(.5, .5), (.4, .6)], [0, 1])
    validate.check_probs(good, 2)
    for psx, s in ([(.5, 1.5), (.4, .6)], [0, 1]), ([(.5, .5), (.4, .6)], [0, 2]), ([(.5, .5), (float("nan"), .6)], [0, 1]):
        with pytest.raises(ValueError):
            validate.check_probs(make_probs(psx, s), 2)
    with pytest.raises(ValueError):
        validate.check_trace(frames.matrix_frame(spark, [[0.0, 1.0], [1.0, 0.0]], "p"), "nm")


def test_confusion_of_any_labels(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1), (2, 1), (2, 2)], "t int, p int")
    assert matrix(joint.confusion_counts(df, "t", "p")).tolist() == [[1, 0, 0], [1, 1, 0], [0, 2, 1]]
    signed = spark.createDataFrame([(-1, -1), (-1, 1), (-1, 1), (1, 1)], "t int, p int")
    rows = {r["s"]: (r["-1"], r["1"]) for r in joint.confusion_report(signed, "t", "p", [-1, 1]).collect()}
    assert rows == {-1: (1, 2), 1: (0, 1)}


def test_matrix_report(spark):
    m = frames.matrix_frame(spark, [[0.75, 0.25], [0.1, 0.9]], "p")
    rows = {r["s"]: r.asDict() for r in latent.matrix_report(m, 2).collect()}
    assert rows[0]["y_1"] == 0.25 and rows[1]["trace"] == 1.65
