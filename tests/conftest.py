import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labelsift.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                      spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_probs(spark):
    def make(psx, s):
        rows = [(i, int(a) if not isinstance(a, (list, tuple)) else list(a), [float(p) for p in row])
                for i, (a, row) in enumerate(zip(s, psx))]
        kind = "array<int>" if isinstance(s[0], (list, tuple)) else "int"
        return spark.createDataFrame(rows, f"id bigint, s {kind}, psx array<double>")
    return make


@pytest.fixture(scope="session")
def ten_rows(make_probs):
    psx = [(.9, .1, 0), (.6, .2, .2), (.1, 0, .9)] + [(.1, .8, .1)] * 6 + [(.1, .1, .8)]
    return make_probs(psx, [0, 0, 1, 1, 1, 1, 1, 1, 1, 2])


@pytest.fixture(scope="session")
def noisy(make_probs):
    """3000 rows, 3 classes, coarse probabilities (many ties), labels drawn from them."""
    rng = np.random.default_rng(0)
    psx = rng.dirichlet([1, 1, 1], 3000).round(2)
    s = np.array([rng.choice(3, p=p / p.sum()) for p in psx])
    return make_probs(psx, s).persist(), psx, s
