"""Hand-made edge cases (FIXTURES §6), run control (resume, override), settings and the demo."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from fewshot_spark.config import RunConfig, run_id
from fewshot_spark.operators import examples as X
from fewshot_spark.operators import prepare as P
from fewshot_spark.operators import sampling as M
from fewshot_spark.operators import variants as VA
from fewshot_spark.plans import results as RS
from fewshot_spark.plans import runs as RN
from fewshot_spark.sources import catalogue as C
from fewshot_spark.sources import readers as R

SPLIT = ["sample_size", "seed_idx"]


def _rows(spark, data, schema="row_id long, text string, label int"):
    return spark.createDataFrame(data, schema)


def test_class_smaller_than_k_and_string_labels(spark):
    df = _rows(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "y"), (5, "e", "y")],
               "row_id long, text string, label string")
    out = M.fewshot_sample(df, 2, 0)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"x": 2, "y": 2}
    assert M.fewshot_sample(df, 10, 0).count() == 5


def test_one_class_only_raises(spark):
    df = _rows(spark, [(i, f"t{i}", 0) for i in range(5)])
    grid = M.fewshot_grid(df, [4], [0])
    with pytest.raises(ValueError, match="one class"):
        X.gen_triplets(grid, {0: "a"}, 2, 0, SPLIT)


def test_null_label_raises_or_drops(spark):
    df = _rows(spark, [(1, "a", 0), (2, "b", None)], "row_id long, text string, label int")
    with pytest.raises(Exception):
        R.read_labelled(df, "text", "label", "row_id").collect()
    assert R.read_labelled(df, "text", "label", "row_id", drop_null_labels=True).count() == 1


def test_null_text_part(spark):
    df = spark.createDataFrame([("t", "c"), ("t", None)], "a string, b string")
    out = [r.text for r in P.with_text(df, "a", "b").collect()]
    assert out == ["t c", None]


def test_equal_rows_different_ids(spark):
    df = _rows(spark, [(7, "same", 1), (3, "same", 1), (5, "same", 0)])
    out = sorted(tuple(r) for r in P.dedup_rows(df, ["text", "label"]).collect())
    assert out == [("same", 0, 5), ("same", 1, 3)]


def test_multilabel_row_sampled_twice_kept_once(spark):
    df = spark.createDataFrame([(1, "both", 1, 1), (2, "a", 1, 0), (3, "b", 0, 1)], "row_id long, text string, x int, y int")
    ml = R.read_multilabel(df, ["x", "y"], "text", "row_id")
    out = M.fewshot_sample_multilabel(ml, ["x", "y"], 5, 0)
    assert sorted(r.row_id for r in out.collect()) == [1, 2, 3]


def test_all_rows_share_a_label(spark):
    df = spark.createDataFrame([(i, f"t{i}", 1, i % 2) for i in range(6)], "row_id long, text string, x int, y int")
    ml = R.read_multilabel(df, ["x", "y"], "text", "row_id").withColumn("s", F.lit(0))
    with pytest.raises(ValueError, match="disjoint"):
        X.gen_triplets_multilabel(ml, "T ", ["x", "y"], ["ex", "why"], 2, 0, ["s"], on_empty="raise")
    assert X.gen_triplets_multilabel(ml, "T ", ["x", "y"], ["ex", "why"], 2, 0, ["s"], on_empty="skip").count() == 0
    # pairs skip rows without a disjoint partner entirely
    assert X.gen_pairs_multilabel(ml, ["x", "y"], 2, 0, ["s"]).count() == 0


def test_label_names_missing_id(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "label int")
    out = [r.label_name for r in P.map_label_names(df, {0: "savoury", 1: "sweet"}).orderBy("label").collect()]
    assert out == ["savoury", "sweet", None]


def test_anchor_missing_label_raises(spark):
    df = _rows(spark, [(1, "a", 0), (2, "b", 3)])
    anchors = spark.createDataFrame([(0, "T zero")], "label_id int, anchor string")
    with pytest.raises(KeyError):
        X.join_anchor(df, anchors)


def test_variants(spark):
    cat = C.label_catalogue(spark)
    with pytest.raises(ValueError):
        VA.anchors_variant(cat, "B")
    alf = {r.label_id: r.anchor for r in VA.anchors_variant(cat, "ALF", 0, ["bbc-news"]).collect()}
    assert alf[0] == "The topic is about a" and alf[4] == "The topic is about e"
    with pytest.raises(ValueError, match="26"):
        VA.anchors_variant(cat, "ALF", 0, ["TREC-QC"]).collect()
    assert VA.anchors_variant(cat, "A", 0, ["bbc-news"]).count() == 0
    short = {r.anchor for r in VA.anchors_variant(cat, "SHORT", 0, ["sst2"]).collect()}
    assert short == {"negative", "positive"}
    assert X.generate_anchors(C.TEMPLATES["sst5"], C.LABELS["sst5"])[0] == "The movie is  terrible"


def test_catalogue_and_resolution(spark):
    assert C.label_catalogue(spark).where("variant = 'default' AND `group` = 'test'").count() == 32
    assert C.label_catalogue(spark).where("variant = 'default' AND `group` = 'dev'").count() == 65
    assert C.label_catalogue(spark).where("variant = 'default' AND `group` = 'multi'").count() == 45
    dev = {r.dataset: r.metric for r in C.resolve_datasets(spark, ["imdb", "toxic_conversations"], is_dev_set=True).collect()}
    assert dev == {"imdb": "accuracy", "toxic_conversations": "matthews_correlation"}
    assert C.resolve_datasets(spark, is_test_set=True, is_dev_set=True).count() == 6  # dev flag wins
    with pytest.raises(KeyError):
        C.resolve_datasets(spark, ["no-such-set"])


def test_run_id_and_config():
    cfg = RunConfig(loss="TripletLoss", setting_name="TEST", model="a/b")
    assert run_id(cfg) == "TEST-a-b-TripletLoss-logistic_regression-itarations_40-batch_16---margin_0.25"
    assert run_id(RunConfig(kind="multilabel")).startswith("MULTILABEL-DEV-")
    assert run_id(RunConfig(kind="ablation", setting_name="PEM")).endswith("--margin_0.25--PEM")
    with pytest.raises(ValueError):
        RunConfig(sample_sizes=16)
    with pytest.raises(ValueError):
        RunConfig(classifier="forest")
    with pytest.raises(ValueError):
        RunConfig(kind="ablation", setting_name="B")


def _small_set(spark):
    parts = M.fraction_split(R.documents_labelled(spark, SF001), 0.75, 42)
    q = C.spec("documents_quality")
    return RN.LabelledSet("documents_quality", parts.where("split = 'train'").drop("split"),
                          parts.where("split = 'test'").drop("split"), list(q.labels), q.template, q.metric)


def test_resume_and_override(spark):
    out_dir = tempfile.mkdtemp(prefix="fewshot-results-", dir="/tmp")
    cfg = RunConfig(loss="TripletLoss", sample_sizes=(2, 4), seeds_num=2, num_iterations=3, results_dir=out_dir)
    first = RN.run_fewshot(spark, cfg, [_small_set(spark)])
    assert first.count() == 4
    stored = spark.read.parquet(RS.results_path(out_dir))
    assert stored.count() == 4
    again = RN.run_fewshot(spark, cfg, [_small_set(spark)])
    assert again.count() == 0
    cfg2 = RunConfig(loss="TripletLoss", sample_sizes=(2, 4, 8), seeds_num=2, num_iterations=3, results_dir=out_dir)
    assert RN.run_fewshot(spark, cfg2, [_small_set(spark)]).select("sample_size").distinct().collect()[0][0] == 8
    cfg3 = RunConfig(loss="TripletLoss", sample_sizes=(2,), seeds_num=2, num_iterations=3, results_dir=out_dir,
                     override_results=True)
    assert RN.run_fewshot(spark, cfg3, [_small_set(spark)]).count() == 2
    stored = RS.read_results(spark, out_dir)
    assert stored.count() == 6 and stored.select(*RS.SPLIT_KEYS).distinct().count() == 6  # replaced, not repeated
    js = RS.results_json(first).first().json
    assert '"macro-f1"' in js and '"accuracy"' in js
    assert spark.read.parquet(f"{out_dir}/runs").count() == 4


def test_multilabel_run(spark):
    base = R.documents_multilabel(spark, SF01)
    parts = M.fraction_split(base, 0.75, 42)
    spec = C.spec("documents_flags")
    ds = RN.LabelledSet("flags", parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split"),
                        list(spec.labels), spec.template, "f1", ["quality", "toxic"])
    for strategy in ("one-vs-rest", "classifier-chain"):
        for loss in ("TripletLoss", "CosineSimilarityLoss"):
            cfg = RunConfig(kind="multilabel", loss=loss, sample_sizes=(4,), seeds_num=2, num_iterations=2,
                            multi_target_strategy=strategy)
            rec = RN.run_fewshot_multilabel(spark, cfg, [ds], write=False).collect()
            assert len(rec) == 2 and all(0.0 <= r.metric_value <= 1.0 for r in rec)
            assert {r.metric for r in rec} == {"accuracy"}


def test_relabel_demo(spark):
    # hand-made frame: three delivery complaints (label 1) and three notes of praise for a recipe (label 0)
    train = spark.createDataFrame([
        (1, "parcel came four days late and the box was crushed", 1),
        (2, "courier left my order in the rain", 1),
        (3, "tracking page shows nothing since monday", 1),
        (4, "this lentil soup is now a family favourite", 0),
        (5, "crisp crust, soft crumb, easy steps", 0),
        (6, "added more garlic and it tasted great", 0),
    ], "row_id long, text string, label int")
    pred = spark.createDataFrame([
        (11, "driver rang the wrong door"), (12, "dough needed an hour longer"), (13, "box arrived open"),
    ], "row_id long, text string")
    cfg = RunConfig(loss="TripletLoss", num_iterations=6)
    sets = [("This note is about ", ["cooking", "shipping"]), ("The writer feels ", ["pleased", "annoyed"])]
    out = RN.run_relabel_demo(spark, cfg, train, pred, sets)
    rows = out.collect()
    assert len(rows) == 3 and out.columns == ["row_id", "pred_0", "name_0", "pred_1", "name_1"]
    assert {r.name_0 for r in rows} <= {"cooking", "shipping"} and {r.name_1 for r in rows} <= {"pleased", "annoyed"}
    assert all((r.name_0, r.name_1) == (sets[0][1][r.pred_0], sets[1][1][r.pred_1]) for r in rows)


def test_csv_source_and_embeddings_sink(spark):
    d = tempfile.mkdtemp(prefix="fewshot-csv-", dir="/tmp")
    with open(f"{d}/abstract.csv", "w") as f:
        f.write('ID,TITLE,ABSTRACT,Computer Science,Physics\n1,"A title","line one\nline two, with comma",1,0\n2,B,"plain",0,1\n')
    schema = "ID int, TITLE string, ABSTRACT string, `Computer Science` int, Physics int"
    df = R.read_csv_labelled(spark, f"{d}/abstract.csv", schema)
    df = P.rename(P.with_text(df, "TITLE", "ABSTRACT"), C.ABSTRACT_RENAMES)
    ml = R.read_multilabel(P.project(df, drop=["TITLE", "ABSTRACT"]), ["ComputerScience", "Physics"], "text", "ID")
    rows = {r.row_id: (r.text, r.label_mask) for r in ml.collect()}
    assert rows[1] == ("A title line one\nline two, with comma", 1) and rows[2] == ("B plain", 2)
    from fewshot_spark.operators.encode import encode_hash

    RS.write_embeddings(encode_hash(ml, dim=16), d, "abstract")
    back = spark.read.parquet(f"{d}/embeddings/abstract")
    assert back.count() == 2 and len(back.first().embedding) == 16


def test_run_with_checkpointed_intermediates(spark):
    cfg = RunConfig(loss="CosineSimilarityLoss", sample_sizes=(2,), seeds_num=2, num_iterations=2, checkpoint_intermediates=True)
    a = sorted((r.seed_idx, r.macro_f1) for r in RN.run_fewshot(spark, cfg, [_small_set(spark)], write=False).collect())
    cfg2 = RunConfig(loss="CosineSimilarityLoss", sample_sizes=(2,), seeds_num=2, num_iterations=2)
    b = sorted((r.seed_idx, r.macro_f1) for r in RN.run_fewshot(spark, cfg2, [_small_set(spark)], write=False).collect())
    assert a == b


def test_multilabel_run_reports_skipped_rows(spark):
    base = R.documents_multilabel(spark, SF01)
    parts = M.fraction_split(base, 0.75, 42)
    spec = C.spec("documents_flags")
    ds = RN.LabelledSet("flags", parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split"),
                        list(spec.labels), spec.template, "f1", ["quality", "toxic"])
    cfg = RunConfig(kind="multilabel", loss="TripletLoss", sample_sizes=(8,), seeds_num=2, num_iterations=2)
    rec = RN.run_fewshot_multilabel(spark, cfg, [ds], write=False)
    grid = M.fewshot_grid_multilabel(ds.train, ["quality", "toxic"], [8], [0, 1])
    both = {r.seed_idx: r["count"] for r in grid.where("label_mask = 3").groupBy("seed_idx").count().collect()}
    for r in rec.collect():
        # (1,1) rows have only unlabelled rows as disjoint partners, and sampled splits hold none
        assert r.skipped_rows == both.get(r.seed_idx, 0)


def test_ablation_keeps_real_and_shown_names(spark):
    ds = _small_set(spark)
    ds = RN.LabelledSet(ds.name, ds.train, ds.test, list(C.DEV_LABELS["sst2"]), C.DEV_TEMPLATES["sst2"], "accuracy")
    cfg = RunConfig(loss="TripletLoss", kind="ablation", setting_name="PEM", sample_sizes=(2,), seeds_num=1, num_iterations=2)
    r = RN.run_ablation(spark, cfg, [ds], C.label_catalogue(spark), {ds.name: "sst2"}, write=False).first()
    assert r.shown_names == {0: "positive", 1: "negative"}  # two labels: the derangement swaps them
    assert set(r.per_class) <= {"negative", "positive"}
    assert r.run_id.startswith("TEM-") and r.run_id.endswith("--PEM")


def test_run_with_user_encoder(spark):
    from fewshot_spark.operators.encode import encode_hash, encode_with_model

    def factory():
        import numpy as np

        from fewshot_spark.operators.encode import hash_vectors

        return lambda texts: hash_vectors(texts, 32) * 2.0  # any model: here a scaled hashed encoding

    ds = _small_set(spark)
    base = RunConfig(loss="TripletLoss", sample_sizes=(2,), seeds_num=2, num_iterations=2, encoder_dim=32)
    user = RunConfig(loss="TripletLoss", sample_sizes=(2,), seeds_num=2, num_iterations=2, encoder_dim=32,
                     encoder=lambda df: encode_with_model(df, factory, 32))
    a = RN.run_fewshot(spark, user, [ds], write=False).collect()
    assert len(a) == 2 and all(0.0 <= r.metric_value <= 1.0 for r in a)
    assert "encoder" in user.as_dict()
    same = RunConfig(loss="TripletLoss", sample_sizes=(2,), seeds_num=2, num_iterations=2, encoder_dim=32,
                     encoder=lambda df: encode_hash(df, dim=32))
    b = sorted((r.seed_idx, r.metric_value) for r in RN.run_fewshot(spark, same, [ds], write=False).collect())
    c = sorted((r.seed_idx, r.metric_value) for r in RN.run_fewshot(spark, base, [ds], write=False).collect())
    assert b == c  # the pluggable path gives the built-in result for the built-in encoder
