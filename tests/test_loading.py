"""Sets read by name from files, prepared by their rules; ids that do not depend on the read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fewshot_spark.config import RunConfig
from fewshot_spark.plans import loading as LO
from fewshot_spark.plans import results as RS
from fewshot_spark.plans import runs as RN
from fewshot_spark.sources import catalogue as C
from fewshot_spark.sources import readers as R


def _write(df, root, name, part, kind="parquet"):
    df.write.mode("overwrite").format(kind).option("header", "true").save(f"{root}/{name}/{part}.{kind}")


def test_title_and_body_and_test_sample(spark, tmp_path):
    df = spark.range(6000).select((F.col("id") % 10).cast("int").alias("topic"), F.format_string("t%d", "id").alias("question_title"),
                                  F.format_string("b%d", "id").alias("question_content"))
    for part in ("train", "test"):
        _write(df, tmp_path, "yahoo_answers_topics", part)
    ds = LO.load_set(spark, str(tmp_path), "yahoo_answers_topics")
    assert ds.train.columns == ["row_id", "text", "label"] and ds.train.count() == 6000
    assert ds.test.count() == 5000 and ds.test.first().text.split(" ")[0][0] == "t"
    a = sorted(r.row_id for r in ds.test.collect())
    assert a == sorted(r.row_id for r in LO.load_set(spark, str(tmp_path), "yahoo_answers_topics").test.collect())


def test_flags_and_cut(spark, tmp_path):
    names = list(C.spec("abstract").labels)
    rows = [(i, f"title {i}", "line one\nline two, quoted", *[int(i % 6 == j) for j in range(6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "ID int, TITLE string, ABSTRACT string, " + ", ".join(f"`{n}` int" for n in names))
    df.coalesce(1).write.option("header", "true").csv(f"{tmp_path}/abstract/train.csv")
    ds = LO.load_set(spark, str(tmp_path), "abstract")
    assert (ds.train.count(), ds.test.count()) == (30, 10) and ds.metric == "accuracy"
    assert ds.label_cols[0] == "ComputerScience"
    assert ds.train.join(ds.test, "row_id").count() == 0
    tweets = spark.createDataFrame([("id-7", "so glad", *[True] + [False] * 10)], "ID string, Tweet string, " + ", ".join(
        f"`{n}` boolean" for n in C.spec("semeval2018task1").labels))
    for part in ("train", "test"):
        _write(tweets, tmp_path, "semeval2018task1", part)
    row = LO.load_set(spark, str(tmp_path), "semeval2018task1").test.first()
    assert (row.text, row.label_mask) == ("so glad", 1) and row.row_id >= 0


def test_run_by_names_stores_results_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([(f"good words {i}" if i % 2 else f"poor text {i}", i % 2) for i in range(40)], "text string, label int")
    for part in ("train", "test"):
        _write(df, tmp_path / "data", "imdb", part, "json")
    cfg = RunConfig(datasets=("imdb",), is_dev_set=True, loss="TripletLoss", num_iterations=2, sample_sizes=(4,), seeds_num=1,
                    results_dir=str(tmp_path / "out"), save_embeddings=True)
    with pytest.raises(ValueError):
        LO.load_sets(spark, cfg, str(tmp_path / "data"))[0].test.count()  # fewer rows than the test sample
    LO.TEST_ROWS["imdb"], kept = 20, LO.TEST_ROWS["imdb"]
    try:
        sets = LO.load_sets(spark, cfg, str(tmp_path / "data"))
        assert RN.run_fewshot(spark, cfg, sets).count() == 1
        rec = RS.read_results(spark, cfg.results_dir).collect()
        assert len(rec) == 1 and rec[0].dataset == "imdb" and rec[0].shown_names is None
        base = f"{cfg.results_dir}/embeddings/{rec[0].run_id}/imdb"
        assert spark.read.parquet(f"{base}/test").count() == 20 and spark.read.parquet(f"{base}/anchors").count() == 2
    finally:
        LO.TEST_ROWS["imdb"] = kept


def test_content_ids(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("a", 0), ("c", 1)], "text string, label int")
    ids = lambda d: sorted((r.text, r.row_id) for r in R.read_labelled(d).collect())
    assert ids(df) == ids(df.repartition(3)) and len({i for _, i in ids(df)}) == 4
    text = spark.createDataFrame([("k1", "a", 0), ("k2", "b", 1)], "key string, text string, label int")
    assert len({r.row_id for r in R.read_labelled(text, id_col="key").collect()}) == 2
