import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.plans import neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid bigint, x array<double>").repartition(8).persist()


def by_hand(x, rows, k):
    out = {}
    for i in rows:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        out[i] = np.lexsort((np.arange(len(x)), d))[: min(k, len(x) - 1)].tolist()
    return out


def falling(rng, n, dim=64):
    """Rows whose variance falls along an unknown basis, in groups of very different sizes."""
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    widths = 4.0 * 0.6 ** np.arange(dim)
    centres = rng.normal(size=(30, dim)) * widths
    of = np.minimum(rng.geometric(0.2, n) - 1, 29)
    return (centres[of] + 0.3 * rng.normal(size=(n, dim)) * widths) @ turn


@pytest.mark.parametrize("case", ["falling", "noise", "copies", "line", "few", "one"])
def test_neighbours_are_exact(spark, monkeypatch, case):
    monkeypatch.setattr(neighbours, "LEAF", 40)
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    rng = np.random.default_rng(1)
    x = {"falling": falling(rng, 1_500, 24), "noise": rng.normal(size=(600, 24)), "copies": np.repeat(rng.normal(size=(20, 5)), 40, axis=0),
         "line": np.stack([np.arange(700.0) // 2, np.zeros(700)], axis=1) * 1e6, "few": rng.normal(size=(3, 4)), "one": rng.normal(size=(1, 4))}[case]
    got = {r["vid"]: r["near"] for r in neighbours.nearest(frame(spark, x), 4).collect()}
    assert got == by_hand(x, range(len(x)), 4)


def test_compared_rows_grow_slower_than_the_table(spark):
    rng = np.random.default_rng(2)
    everything, compared = falling(rng, 100_000), {}
    for n in (2_000, 20_000, 100_000):
        x = everything[:n]
        out = neighbours.searched(frame(spark, x), 2).select("vid", F.transform("near", lambda e: e.o).alias("near"), "compared").toPandas().set_index("vid")
        compared[n] = out["compared"].mean()
        rows = rng.choice(n, 100, replace=False)
        want = by_hand(x, rows, 2)
        assert len(out) == n and all(list(out["near"][i]) == want[i] for i in rows)
    assert compared[20_000] < 3 * compared[2_000] and compared[100_000] < 2 * compared[20_000] and compared[100_000] < 5_000, compared
