import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelsift.operators import rollup
from labelsift.sources import features, labelled_text, results, tables


def test_label_tables_csv_and_parquet(spark, tmp_path):
    csv = tmp_path / "labels.csv"
    csv.write_text("file,release,vulnerable\na.cpp,63,True\nb.cpp,63,False\nc.cpp,64,\n")
    df = tables.read_labels(spark, str(csv), fmt="csv")
    assert {r["file"]: r["vulnerable"] for r in df.collect()} == {"a.cpp": 1, "b.cpp": 0, "c.cpp": 0}
    assert tables.read_labels(spark, str(csv), 64, "csv").count() == 1
    df.select("file", "release", (F.col("vulnerable") == 1).alias("vulnerable")).write.parquet(str(tmp_path / "p"))
    plan = tables.read_labels(spark, str(tmp_path / "p"), 63)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(release,63)" in plan


def test_code_table_keeps_line_breaks(spark, tmp_path):
    csv = tmp_path / "code.csv"
    csv.write_text('file,release,vulnerable,code\na.cpp,63,True,"int x;\nint ""y"";"\nb.cpp,63,False,\n')
    rows = {r["file"]: r["code"] for r in tables.read_code(spark, str(csv), fmt="csv").collect()}
    assert rows == {"a.cpp": 'int x;\nint "y";', "b.cpp": None}


def test_side_tables(spark, tmp_path):
    (tmp_path / "latent.csv").write_text("bug_report,file,first_appear,last_appear,reason\n1,a.cpp,60,64,\n2,b.cpp,70,71,why\n")
    (tmp_path / "silent.csv").write_text("file,release,vulnerable\na.cpp,63,True\n")
    assert tables.read_latent(spark, str(tmp_path / "latent.csv")).where("first_appear <= 64").count() == 1
    assert tables.read_silent(spark, str(tmp_path / "silent.csv")).first()["vulnerable"] == 1


def test_raw_metrics_drop_malformed_lines(spark, tmp_path):
    names = ["Kind", "File", *rollup.FILE_FIRST, *rollup.CLASS_SUM, *rollup.CLASS_MEAN, *rollup.FUNCTION_SPREAD]
    good = ",".join(["File", "src\\a.cpp"] + ["1"] * (len(names) - 2))
    (tmp_path / "raw.csv").write_text(",".join(names) + "\n" + good + "\n" + good + ",7,8\n")
    df = tables.read_raw_metrics(spark, str(tmp_path / "raw.csv"), 63)
    assert [r["file"] for r in df.select("file", *names[2:]).collect()] == ["src/a.cpp"]
    assert [r["file"] for r in df.select("file").collect()] == ["src/a.cpp"]


def test_feature_tables(spark, tmp_path):
    path = str(tmp_path / "features")
    sm = spark.createDataFrame([("a", 63, 1.0, None), ("b", 63, float("nan"), 2.0), ("c", 64, 3.0, 4.0)], "file string, release int, m double, n double")
    features.write_features(sm, path, "sm")
    got = {r["file"]: r["features"].toArray().tolist() for r in features.read_features(spark, path, "sm", 63).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 2.0]}
    bow = spark.createDataFrame([("a", 63, Vectors.sparse(4, {1: 1.0}))], ["file", "release", "features"])
    features.write_features(bow.withColumn("release", F.col("release").cast("int")), str(tmp_path / "bow"), "bow", "_val")
    one = features.read_features(spark, str(tmp_path / "bow"), "bow", 63, "_val").first()
    assert one["features"].numNonzeros() == 1
    with pytest.raises(ValueError):
        features.read_features(spark, path, "nope", 63)
    assert features.stack([sm, sm]).count() == 6


def test_labelled_text(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("__label__a first text\nsecond line\n__label__b one\n__label__c\n")
    rows = [(r["label"], r["text"]) for r in labelled_text.read_labelled_text(spark, str(f)).collect()]
    assert rows == [("__label__a", "first text __newline__ second line"), ("__label__b", "one"), ("__label__c", "")]
    recs = spark.createDataFrame([(i, x) for i, x in enumerate("abc")], "id int, text string")
    picked = spark.createDataFrame([(0,), (2,)], "id int")
    assert labelled_text.select_records(recs, picked).count() == 2
    assert [r["text"] for r in labelled_text.select_records(recs, picked, keep=False).collect()] == ["b"]


def result_row(spark, release, technique):
    values = {c: (release if c == "release" else technique if c == "technique" else "x" if c in results.TEXT_COLUMNS else 0.5) for c in results.RESULT_COLUMNS}
    return spark.createDataFrame([tuple(values.values())], results.result_schema())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_append(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    results.append_results(result_row(spark, 63, "baseline"), path, fmt)
    results.append_results(result_row(spark, 64, "pruning"), path, fmt)
    back = results.read_results(spark, path, fmt)
    assert back.columns == results.RESULT_COLUMNS and back.count() == 2


def test_overall_recall(spark, tmp_path):
    labels = spark.createDataFrame([("a", 65, 0), ("b", 65, 1), ("c", 65, 0), ("d", 65, 0)], "file string, release int, vulnerable int")
    silent = spark.createDataFrame([("a", 65)], "file string, release int")
    latent = spark.createDataFrame([("c", 60, 70)], "file string, first_appear int, last_appear int")
    pred = spark.createDataFrame([(63, "x", "x", "baseline", f, 65, p) for f, p in [("a", 1), ("b", 1), ("c", 0), ("d", 1)]],
                                 "release int, classifier string, feature_type string, technique string, file string, test_release int, predicted int")
    results.write_predictions(pred, str(tmp_path / "pred"))
    stored = spark.read.parquet(str(tmp_path / "pred"))
    out = results.add_overall_recall(result_row(spark, 63, "baseline"), stored, labels, silent, latent)
    assert out.first()["recall_o"] == pytest.approx(2 / 3)


def test_predictions_make_files_by_run_not_by_task(spark, tmp_path):
    def runs(predicted, releases):
        return spark.range(40 * 12, numPartitions=12).select(
            (F.col("id") % 40).cast("int").alias("release"), *[F.lit("x").alias(c) for c in results.RUN_KEY[1:]], F.col("id").alias("file"),
            F.lit(65).alias("test_release"), F.lit(predicted).alias("predicted")).where(F.col("release") < releases)

    path = tmp_path / "pred"
    results.write_predictions(runs(0, 40), str(path))
    assert len(list(path.rglob("*.parquet"))) == 40  # not 40 x 3 or more
    results.write_predictions(runs(1, 10), str(path))  # a rerun replaces its own
    back = [(r["release"], r["file"], r["predicted"]) for r in spark.read.parquet(str(path)).collect()]
    assert sorted(back) == sorted((i % 40, i, int(i % 40 < 10)) for i in range(480))


def test_grid(spark, tmp_path):
    (tmp_path / "grid.csv").write_text("63,rf,bert,baseline\n64,rf,sm,pruning\n")
    assert [tuple(r) for r in results.read_grid(spark, str(tmp_path / "grid.csv")).orderBy("release").collect()] == [
        (63, "rf", "bert", "baseline"), (64, "rf", "sm", "pruning")]


@pytest.mark.parametrize("split", [300, 1_000, 10**8])
def test_first_file_row_is_that_of_the_source(spark, tmp_path, split):
    names = ["Kind", "File", *rollup.FILE_FIRST, *rollup.CLASS_SUM, *rollup.CLASS_MEAN, *rollup.FUNCTION_SPREAD]
    want = {}
    (tmp_path / "raw").mkdir()
    for part in range(3):
        lines = [",".join(names)]
        for i in range(60):
            value = part * 1000 + i
            lines.append(",".join(["File", f"src\\f{(i * 7 + part) % 40}.cpp", *[str(value)] * (len(names) - 2)]))
            want.setdefault(f"src/f{(i * 7 + part) % 40}.cpp", value)
        (tmp_path / "raw" / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        raw = tables.read_raw_metrics(spark, str(tmp_path / "raw"), 63)
        labels = spark.createDataFrame([(f, 63) for f in want], "file string, release int")
        got = {r["file"]: r["CountLine"] for r in rollup.roll_up(labels, raw, "row_order").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


@pytest.mark.parametrize("split", [200, 5_000, 10**8])
def test_records_are_numbered_in_the_order_of_the_source(spark, tmp_path, split):
    (tmp_path / "text").mkdir()
    want = []
    for part in range(3):
        records = [f"__label__{i % 3} record {part} {i}\nsecond line {'x' * (i % 50)}\n\nfourth" for i in range(120)]
        want += [f"record {part} {i}" for i in range(120)]
        (tmp_path / "text" / f"part-{part}.txt").write_text("\n".join(records) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        records = labelled_text.read_labelled_text(spark, str(tmp_path / "text"), index="record")
        if split < 10**8:
            assert records.rdd.getNumPartitions() > 3
        got = {r["record"]: r["text"].split(" __newline__")[0] for r in records.collect()}
        ids = spark.createDataFrame([(i,) for i in range(0, 360, 7)], "record bigint")
        chosen = labelled_text.select_records(records, ids, "record")
        others = labelled_text.select_records(records, ids, "record", keep=False)
        assert sorted(r["record"] for r in chosen.collect()) == list(range(0, 360, 7)) and others.count() == 360 - len(range(0, 360, 7))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(want))


def test_results_get_a_new_version(spark, tmp_path):
    labels = spark.createDataFrame([("a", 65, 0), ("b", 65, 1)], "file string, release int, vulnerable int")
    silent = spark.createDataFrame([("a", 65)], "file string, release int")
    latent = spark.createDataFrame([], "file string, first_appear int, last_appear int")
    pred = spark.createDataFrame([(63, "x", "x", "baseline", f, 65, p) for f, p in [("a", 1), ("b", 0)]],
                                 "release int, classifier string, feature_type string, technique string, file string, test_release int, predicted int")
    results.write_predictions(pred, str(tmp_path / "pred"))
    for r in (63, 64):
        results.append_results(result_row(spark, r, "baseline"), str(tmp_path / "results"))
    out = results.write_overall_recall(spark, str(tmp_path / "results"), str(tmp_path / "pred"), labels, silent, latent, str(tmp_path / "results-2"))
    assert out.columns == [*results.RESULT_COLUMNS, "recall_o"]
    assert {r["release"]: r["recall_o"] for r in out.collect()} == {63: 0.5, 64: None}
    assert results.read_results(spark, str(tmp_path / "results")).columns == results.RESULT_COLUMNS


def test_vocabulary_ties_are_cut_by_token(spark):
    from labelsift.plans import feature_jobs

    docs = spark.createDataFrame([("a", 63, ["z", "y", "x", "w", "w"]), ("b", 63, ["y", "z", "x", "v"])], "file string, release int, tokens array<string>")
    model = feature_jobs.bag_of_words(docs, 3)
    assert model.stages[0].vocabulary == ["w", "x", "y"]
    assert {r["file"]: r["features"].numNonzeros() for r in model.transform(docs).collect()} == {"a": 3, "b": 2}
