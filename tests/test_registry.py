import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "s", "score", "rank"] and df.count() > 0


def test_sql_names_are_registered():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["confident_joint", "errors_both", "composite_relabel", "metric_rollup", "exact_auc", "noise_injection", "bow_l2"])
def test_results_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "orders", "lineitem", "part", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cur = con.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert sorted(df.columns) == sorted(cols) and got == want
