import numpy as np
import pytest

from labelsift.operators import cuts, prune


def by_sorting(p, s, wanted):
    out = {}
    for w in wanted:
        rows = p[[w["s"] in np.atleast_1d(x) for x in s]]
        v = -rows[:, w["s"]] if w["s"] == w["y"] else rows[:, w["y"]] - rows[:, w["s"]]
        out[w["s"], w["y"]] = np.sort(v[~np.isnan(v)])[::-1][w["m"] - 1]
    return out


def frame(spark, p, s):
    lists = [[None if np.isnan(v) else float(v) for v in row] for row in p]
    kind = "array<int>" if isinstance(s[0], list) else "int"
    return spark.createDataFrame(list(zip(range(len(p)), s, lists)), f"id bigint, s {kind}, psx array<double>").repartition(5)


@pytest.mark.parametrize("sliver", [0, 200_000])
@pytest.mark.parametrize("values", ["smooth", "ties", "one value", "tiny steps", "outside"])
def test_cuts_of_many_columns(spark, monkeypatch, sliver, values):
    monkeypatch.setattr(cuts, "SLIVER", sliver)
    monkeypatch.setattr(cuts, "CELLS", 64)
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1] * 4, 900)
    p = {"smooth": p, "ties": p.round(1), "one value": np.where(rng.random((900, 1)) < 0.8, p[:1], p), "tiny steps": 0.25 + 1e-13 * p, "outside": 9 * p - 3}[values]
    s = rng.integers(0, 4, 900).tolist()
    size = np.bincount(s)
    wanted = [{"s": a, "y": b, "m": int(m)} for a in range(4) for b, m in zip(range(4), rng.integers(1, size[a] + 1, 4))]
    wanted[0]["m"], wanted[1]["m"] = 1, int(size[0])
    got = {(c["s"], c["y"]): c["cut"] for c in cuts.largest(frame(spark, p, s), wanted, 4)}
    assert got == by_sorting(p, s, wanted)


def test_cuts_leave_nulls_out_and_take_label_lists(spark):
    rng = np.random.default_rng(4)
    p = rng.random((300, 3)).round(3)
    p[rng.random(p.shape) < 0.1] = np.nan
    s = [sorted(set(rng.integers(0, 3, 2).tolist())) for _ in range(300)]
    wanted = [{"s": a, "y": b, "m": 20 + a + 5 * b} for a in range(3) for b in range(3)]
    got = {(c["s"], c["y"]): c["cut"] for c in cuts.largest(frame(spark, p, s), wanted, 3, multi_label=True)}
    assert got == by_sorting(p, s, wanted)
    assert cuts.largest(frame(spark, p, s), [], 3, multi_label=True) == []


def flagged_by_hand(p, s, k):
    """Rows over the cut of any other class, and under the one of their own, from a joint counted with plain loops."""
    t = np.array([p[s == c, c].mean() for c in range(k)])
    confident = p >= t - 1e-6
    guess = np.where(confident.sum(1) == 1, confident.argmax(1), np.where(confident.any(1), p.argmax(1), -1))
    joint = np.zeros((k, k))
    np.add.at(joint, (s[guess >= 0], guess[guess >= 0]), 1)
    return joint


def test_hundred_classes(spark):
    k, n = 100, 20_000
    rng = np.random.default_rng(5)
    s = rng.integers(0, k, n)
    true = np.where(rng.random(n) < 0.15, rng.integers(0, k, n), s)
    p = rng.random((n, k)) ** 4
    p[np.arange(n), true] += rng.random(n) * 12
    p = (p / p.sum(1, keepdims=True)).round(6)
    probs = frame(spark, p, s.tolist()).persist()
    got = {r["id"]: r["is_error"] for r in prune.find_label_errors(probs, k, method="both").select("id", "is_error").collect()}
    counts = [r.asDict() for r in prune.prune_counts(prune.joint.confident_joint(probs, k)).collect()]
    raw = flagged_by_hand(p, s, k)
    cells = {(r["s"], r["y"]): r["n"] for r in prune.joint.confident_joint(probs, k, calibrate=False).collect()}
    assert all(cells[a, b] == raw[a, b] for a in range(k) for b in range(k))
    size = np.bincount(s, minlength=k)
    rate, own = np.zeros(n, bool), np.zeros(n, bool)
    for r in counts:
        rows, m = np.flatnonzero(s == r["s"]), r["n"]
        if r["s"] != r["y"] and m > 0:
            v = p[rows, r["y"]] - p[rows, r["s"]]
            rate[rows[v >= np.sort(v)[::-1][m - 1]]] = True
        elif r["s"] == r["y"] and 0 < size[r["s"]] - m < size[r["s"]]:
            v = p[rows, r["s"]]
            own[rows[v < np.sort(v)[size[r["s"]] - m]]] = True
    want = rate & own & (p.argmax(1) != s)
    assert want.sum() > 1_000 and all(got[i] == want[i] for i in range(n))
    probs.unpersist()
