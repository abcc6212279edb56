import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.functions import text
from labelsift.operators import relabel, rollup
from labelsift.plans import feature_jobs
from labelsift.sources import tables


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([("a.cpp", 63, 0), ("a.cpp", 64, 0), ("b.cpp", 63, 1), ("c.cpp", 63, 0), ("d.cpp", 63, 0),
                                    ("d.cpp", 64, 0), ("d.cpp", 65, 0), ("e.cpp", 65, 0)], "file string, release int, vulnerable int")
    # A duplicate key, and a file already labelled 1.
    silent = spark.createDataFrame([("a.cpp", 63, 1), ("a.cpp", 63, 1), ("b.cpp", 63, 1)], "file string, release int, vulnerable int")
    # Overlapping intervals, ends touching a release, a file in both tables, an interval outside all releases.
    latent = spark.createDataFrame([("1", "d.cpp", 60, 63, None), ("2", "d.cpp", 63, 64, "x"), ("3", "a.cpp", 63, 63, None),
                                    ("4", "c.cpp", 70, 90, None), ("5", "e.cpp", 1, 99999999, None)], tables.LATENT)
    return labels, silent, latent


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_exact_relabel(side):
    labels, silent, _ = side
    out = relabel.relabel(labels, silent, value=2)
    assert out.count() == labels.count()
    assert {r["file"] for r in out.where("vulnerable = 2").collect()} == {"a.cpp", "b.cpp"}
    assert out.where("vulnerable = 2").count() == 2


def test_interval_relabel_inclusive_without_duplicates(side):
    labels, _, latent = side
    out = relabel.relabel(labels, latent=latent)
    assert out.count() == labels.count()
    assert rows(out.where("label_source = 'latent'"), "file", "release") == [("a.cpp", 63), ("d.cpp", 63), ("d.cpp", 64), ("e.cpp", 65)]


def test_composite_relabel_and_hidden(side):
    out = relabel.relabel(*side, value=1)
    assert rows(out.where("vulnerable = 1"), "file", "release") == [
        ("a.cpp", 63), ("b.cpp", 63), ("d.cpp", 63), ("d.cpp", 64), ("e.cpp", 65)]
    assert {r["file"]: r["label_source"] for r in out.where("release = 63").collect()} == {
        "a.cpp": "latent", "b.cpp": "silent", "c.cpp": "given", "d.cpp": "latent"}
    hidden = relabel.hidden_positives(*side)
    assert hidden.where("hidden_positive and vulnerable = 1").count() == 1  # the label itself is kept


def test_release_filters(side):
    labels, silent, latent = side
    assert relabel.latent_for_release(latent, 63).count() == 4
    assert relabel.silent_for_release(silent, 64).count() == 0
    for fn, t in ((relabel.silent_for_release, silent), (relabel.latent_for_release, latent)):
        with pytest.raises(ValueError):
            fn(t, None)


def test_splits(spark):
    assert relabel.split_releases(63) == (63, 64, 65)
    assert relabel.split_releases(78) == (78, 79, 81)
    assert relabel.split_releases(79) == (79, 81, 82)
    assert relabel.split_releases(80) is None
    got = {r["train"]: (r["val"], r["test"]) for r in relabel.split_map(spark.range(77, 82).select(F.col("id").cast("int").alias("release"))).collect()}
    assert got == {77: (78, 79), 78: (79, 81), 79: (81, 82), 81: (82, 83)}


def test_align(spark):
    f = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], "file string, release int, m double")
    labels = spark.createDataFrame([("a", 1, 0)], "file string, release int, vulnerable int")
    assert tables.align(f, labels).count() == 1
    with pytest.raises(ValueError):
        tables.align(f, labels.unionByName(spark.createDataFrame([("z", 1, 0)], labels.schema)))


def raw_rows(spark):
    metrics = [*rollup.FILE_FIRST, *rollup.CLASS_SUM, *rollup.CLASS_MEAN, *rollup.FUNCTION_SPREAD]

    def row(kind, file, base, order):
        return {"Kind": kind, "File": file, "release": 63, "row_order": order, **{m: float(base) for m in metrics}}

    data = [row("File", r"src\a.cpp", 1, 0), row("File", "src/a.cpp", 9, 1), row("Public Class", "src/a.h", 3, 2),
            row("Class", "src/a.cpp", 5, 3), row("Private Function", "src/a.cpp", 2, 4), row("Function", "src/a.cpp", 6, 5),
            row("Function", "src/a.h", 50, 6)]
    schema = "Kind string, File string, release int, row_order bigint, " + ", ".join(f"{m} double" for m in metrics)
    return rollup.normalise_raw(spark.createDataFrame([tuple(d.values()) for d in data], schema))


def test_metric_rollup(spark):
    labels = spark.createDataFrame([("src/a.cpp", 63, 0), ("src/none.cpp", 63, 1)], "file string, release int, vulnerable int")
    out = {r["file"]: r.asDict() for r in feature_jobs.metric_features(labels, raw_rows(spark)).collect()}
    a, none = out["src/a.cpp"], out["src/none.cpp"]
    assert len([c for c in a if c not in ("file", "release", "vulnerable")]) == 53
    assert a["CountLine"] == 1.0                       # first file row in source order
    assert a["CountClassBase"] == 8.0                  # header and source share the stem
    assert a["MaxInheritanceTree"] == 4.0
    assert (a["CountInput_Min"], a["CountInput_Mean"], a["CountInput_Max"]) == (2.0, 4.0, 6.0)
    assert all(none[c] == 0.0 for c in rollup.metric_columns())


def test_rollup_keeps_one_place_and_deals_out_the_narrow_table(spark):
    """A file's first row and its place are one aggregate, not one for each of 28 metrics; its metrics are not dealt out again by stem."""
    labels = spark.createDataFrame([("src/a.cpp", 63, 0)], "file string, release int, vulnerable int")
    raw = raw_rows(spark)
    raw = raw.union(raw.where("row_order = 0").withColumn("row_order", F.lit(-1).cast("bigint")).withColumn("CountLine", F.lit(None).cast("double")))
    out = feature_jobs.metric_features(labels, raw)
    row = out.first()
    assert row["CountLine"] == 0.0 and row["CountStmt"] == 1.0  # what the first row lacks is not taken from a later one
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") == 1
    assert plan.index("sum(CountClassBase") < plan.index("min_by(")  # classes are joined first


def test_clean_code_and_tokens(spark):
    code = '/* head\n more */\nint x = 10; // ten\n\n  /* in */ char *s = "a // b";\n\tif (x >= 0x1F) y += \'c\';\n'
    df = spark.createDataFrame([(code,), (None,)], "code string")
    out = [r[0] for r in df.select(text.clean_code("code")).collect()]
    assert out[0] == '\nint x = 10;\n char *s = "a\n\tif (x >= 0x1F) y += \'c\';\n'.lstrip("\n")
    assert out[1] == ""
    plain = spark.createDataFrame([('f("a b", \'c\') + 12 - 3.5 * E <= b1 != 07x',)], "c string")
    replaced = plain.select(text.replace_tokens("c")).first()[0]
    assert replaced == "f(TSTRING, TCHAR) + TNUM - TNUM * TNUM <= b1 != TNUM"
    assert plain.select(text.tokens(text.replace_tokens("c"))).first()[0] == [
        "f", "TSTRING", "TCHAR", "+", "TNUM", "-", "TNUM", "*", "TNUM", "<=", "b1", "!=", "TNUM"]


def test_paths(spark):
    df = spark.createDataFrame([("a\\b.c\\d.cpp",), ("noext",), ("x.tar.gz",)], "f string")
    assert [r[0] for r in df.select(text.file_stem(text.file_path("f"))).collect()] == ["a/b.c/d", "noext", "x.tar"]


def test_bow_job(spark):
    code = spark.createDataFrame([("a", 63, "x = x + 1;"), ("b", 63, "y = 2;"), ("a", 64, "z x"), ("a", 65, None)],
                                 "file string, release int, code string")
    out = feature_jobs.bow_features(code, 63, size=50)
    train = {r["file"]: r["features"] for r in out[""].collect()}
    assert train["a"].norm(2) == pytest.approx(1.0) and train["a"].size == out["_val"].first()["features"].size
    assert out["_val"].first()["features"].numNonzeros() == 1   # z is not in the training vocabulary
    assert out["_test"].first()["features"].numNonzeros() == 0
    with pytest.raises(ValueError):
        feature_jobs.bow_features(code, 80)


def test_intervals_become_disjoint_runs(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", int(a), int(a + rng.integers(0, 4))) for a in rng.integers(0, 400, 100_000)]
    rows += [("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("a", 2, 2), ("b", 5, 4), ("c", None, 9), ("c", 3, None), (None, 1, 2)]
    got = [tuple(r) for r in relabel.disjoint_intervals(spark.createDataFrame(rows, "file string, first_appear int, last_appear int")).collect()]
    covered = {(f, r) for f, a, b in rows if a is not None and b is not None for r in range(a, b + 1)}
    assert [(f, r) for f, a, b in got for r in range(a, b + 1)].__len__() == len(covered)
    assert {(f, r) for f, a, b in got for r in range(a, b + 1)} == covered
    runs = sorted(g[1:] for g in got if g[0] == "hot")
    assert all(b + 1 < a for (_, b), (a, _) in zip(runs, runs[1:])) and sorted(g[1:] for g in got if g[0] == "a") == [(1, 6), (8, 9)]


def test_many_intervals_of_one_file_label_each_row_once(spark):
    spans = spark.range(100_000).select(F.lit("hot").alias("file"), (F.col("id") % 50).cast("int").alias("first_appear"), (F.col("id") % 50 + 2).cast("int").alias("last_appear"))
    labels = spark.createDataFrame([("hot", r, 0) for r in (0, 30, 51, 52)] + [("cold", 30, 0)], "file string, release int, vulnerable int")
    got = {(r["file"], r["release"]): r["vulnerable"] for r in relabel.relabel(labels, None, spans).collect()}
    assert got == {("hot", 0): 1, ("hot", 30): 1, ("hot", 51): 1, ("hot", 52): 0, ("cold", 30): 0}


def test_alignment_scans_each_side_once(spark, tmp_path):
    f = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], "file string, release int, m double")
    labels = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "file string, release int, vulnerable int")
    f.write.parquet(str(tmp_path / "f"))
    labels.write.parquet(str(tmp_path / "l"))
    out = tables.align(spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "l")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["file", "release", "m", "vulnerable"] and out.count() == 2
    assert plan.split("Initial Plan")[0].count("FileScan parquet") == 2
