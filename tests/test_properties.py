"""Invariants of sampling and example generation, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF01
from fewshot_spark.operators import examples as X
from fewshot_spark.operators import sampling as M
from fewshot_spark.operators import variants as VA
from fewshot_spark.sources import catalogue as C
from fewshot_spark.sources import readers as R

SPLIT = ["sample_size", "seed_idx"]


def _dl(spark):
    return R.documents_labelled(spark, SF01, "quality")


def test_sample_size_is_min_k_nc(spark):
    dl = _dl(spark)
    sizes = {r["label"]: r["count"] for r in dl.groupBy("label").count().collect()}
    grid = M.fewshot_grid(dl, [2, 8, 64, 500], [0, 1, 2])
    got = grid.groupBy(*SPLIT, "label").count().collect()
    for r in got:
        assert r["count"] == min(r["sample_size"], sizes[r["label"]])
    assert len(got) == 4 * 3 * 2
    # no row twice in a split
    assert grid.groupBy(*SPLIT, "row_id").count().where("count > 1").count() == 0


def test_grid_nested_over_k(spark):
    grid = M.fewshot_grid(_dl(spark), [2, 4, 8, 16], [0, 1])
    small = grid.where("sample_size = 4").select("seed_idx", "row_id")
    big = grid.where("sample_size = 16").select("seed_idx", "row_id")
    assert small.join(big, ["seed_idx", "row_id"], "left_anti").count() == 0


def test_seeds_differ_and_repeat(spark):
    dl = _dl(spark)
    a = {r.row_id for r in M.fewshot_sample(dl, 8, 0).collect()}
    b = {r.row_id for r in M.fewshot_sample(dl, 8, 1).collect()}
    a2 = {r.row_id for r in M.fewshot_sample(dl, 8, 0).collect()}
    assert a == a2 and a != b


def test_partition_count_invariance(spark):
    dl = _dl(spark)
    base = {tuple(r) for r in M.fewshot_grid(dl, [4, 16], [0, 1]).select(*SPLIT, "row_id").collect()}
    for n in (1, 8, 64):
        got = {tuple(r) for r in M.fewshot_grid(dl.repartition(n), [4, 16], [0, 1]).select(*SPLIT, "row_id").collect()}
        assert got == base
    rows = M.fewshot_grid(dl, [16], [0])
    t1 = {tuple(r) for r in X.gen_triplets(rows, {0: "a", 1: "b"}, 3, 0, SPLIT).select("iteration", "row_id", "neg_row_id").collect()}
    t2 = {tuple(r) for r in X.gen_triplets(rows.repartition(13), {0: "a", 1: "b"}, 3, 0, SPLIT, bits=3)
          .select("iteration", "row_id", "neg_row_id").collect()}
    assert t1 == t2


def test_fraction_split_cover(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    out = M.fraction_split(docs, 0.75, 42, "doc_id")
    n = docs.count()
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts["train"] == round(0.75 * n) and counts["train"] + counts["test"] == n
    assert out.select("doc_id").distinct().count() == n


def test_sample_exact(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    assert M.sample_exact(docs, 123, 7, "doc_id").count() == 123
    try:
        M.sample_exact(docs, 10_000_000, 7, "doc_id").count()
        raise AssertionError("expected a failure")
    except ValueError:
        pass


def test_triplets_negative_other_class(spark):
    rows = M.fewshot_grid(_dl(spark), [4, 32], [0, 1])
    trip = X.gen_triplets(rows, {0: "low", 1: "high"}, 10, 0, SPLIT)
    labels = rows.select(*SPLIT, F.col("row_id").alias("neg_row_id"), F.col("label").alias("neg_label"))
    j = trip.join(labels, [*SPLIT, "neg_row_id"])
    assert j.where("neg_label = label").count() == 0
    assert trip.count() == rows.count() * 10


def test_pairs_targets(spark):
    rows = M.fewshot_grid(_dl(spark), [8], [0])
    pairs = X.gen_pairs(rows, 5, 0, SPLIT)
    labels = rows.select(*SPLIT, F.col("row_id").alias("other_row_id"), F.col("label").alias("ol"))
    j = pairs.join(rows.select(*SPLIT, "row_id", "label"), [*SPLIT, "row_id"]).join(labels, [*SPLIT, "other_row_id"])
    assert j.where("(target = 1.0 AND ol <> label) OR (target = 0.0 AND ol = label)").count() == 0
    assert pairs.count() == rows.count() * 5 * 2


def test_multilabel_negatives_disjoint(spark):
    dl6 = R.documents_multilabel(spark, SF01, six=True).withColumn("dataset", F.lit("d"))
    ex = X.repeat_iterations(dl6.where("label_mask <> 0"), 5)
    out = X.disjoint_negative(ex, dl6, ["dataset"], 0, out_text="nt")
    masks = dl6.select(F.col("row_id").alias("neg_row_id"), F.col("label_mask").alias("nm"))
    j = out.join(masks, "neg_row_id")
    assert j.where("(label_mask & nm) <> 0").count() == 0


def test_multilabel_no_partner_skip_and_raise(spark):
    # quality/toxic flags: a (1,1) row has only (0,0) rows as disjoint partners; sampled splits
    # never hold unlabelled rows, so (1,1) rows have none.
    ml = R.documents_multilabel(spark, SF01)
    grid = M.fewshot_grid_multilabel(ml, ["quality", "toxic"], [4], [0])
    assert grid.where("label_mask = 0").count() == 0
    spec = C.spec("documents_flags")
    out = X.gen_triplets_multilabel(grid, spec.template, ["quality", "toxic"], list(spec.labels), 2, 0, SPLIT, on_empty="skip")
    assert out.where("label_mask = 3").count() == 0
    if grid.where("label_mask = 3").count():
        try:
            X.gen_triplets_multilabel(grid, spec.template, ["quality", "toxic"], list(spec.labels), 2, 0, SPLIT, on_empty="raise")
            raise AssertionError("expected a failure")
        except ValueError:
            pass


def test_multilabel_dedup(spark):
    ml = R.documents_multilabel(spark, SF01, six=True)
    grid = M.fewshot_grid_multilabel(ml, C.FLAGS6, [8], [0, 1])
    assert grid.groupBy(*SPLIT, "text", "label_mask").count().where("count > 1").count() == 0
    # de-duplication only merges equal rows, so every label present in the data stays represented
    per_label = grid.select(*SPLIT, F.posexplode(F.array(*C.FLAGS6)).alias("l", "f")).where("f = 1")
    assert per_label.select("l").distinct().count() == 6


def test_batches(spark):
    rows = M.fewshot_grid(_dl(spark), [16], [0, 1])
    ex = X.repeat_iterations(rows.select(*SPLIT, "row_id"), 40)
    b = X.assign_batches(ex, SPLIT, 16, 0, ["iteration", "row_id"])
    stats = b.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.max("batch_id").alias("mb"), F.first("steps").alias("steps"),
                                  F.first("warmup_steps").alias("w")).collect()
    import math

    for r in stats:
        assert r["steps"] == math.ceil(r["n"] / 16) == r["mb"] + 1
        assert r["w"] == math.ceil(r["steps"] * 0.1)


def test_permutation_no_fixed_point(spark):
    cat = C.label_catalogue(spark).where("variant = 'default'")
    for seed in (0, 3):
        out = VA.permute_labels(cat, ["dataset"], seed).collect()
        by_set: dict = {}
        for r in out:
            by_set.setdefault(r["dataset"], []).append(r)
        for rs in by_set.values():
            assert all(r["shown_name"] != r["label_name"] for r in rs)
            assert sorted(r["shown_name"] for r in rs) == sorted(r["label_name"] for r in rs)


def test_prefilter_exact_including_fallback(spark, monkeypatch):
    monkeypatch.setattr(M, "PREFILTER_MIN_CLASS_ROWS", 0)  # the cut is normally for large classes only
    dl = _dl(spark)
    ref = {tuple(r) for r in M._ranked_keys(dl.select("row_id", "label"), "label", [2, 8, 64], [0, 1, 2], "row_id",
                                            prefilter=False).collect()}
    got = {tuple(r) for r in M._ranked_keys(dl.select("row_id", "label"), "label", [2, 8, 64], [0, 1, 2], "row_id").collect()}
    assert got == ref
    # a cut far too tight: most (seed, class) groups fall short and are ranked again in full
    monkeypatch.setattr(M, "CANDIDATE_FACTOR", 0)
    monkeypatch.setattr(M, "CANDIDATE_SLACK", 1)
    tight = {tuple(r) for r in M._ranked_keys(dl.select("row_id", "label"), "label", [2, 8, 64], [0, 1, 2], "row_id").collect()}
    assert tight == ref


def test_attach_payload_tiers(spark):
    dl = _dl(spark)
    ref = sorted(tuple(r) for r in M.fewshot_grid(dl, [4, 16], [0, 1]).collect())
    keys = M._ranked_keys(dl.select("row_id", "label"), "label", [4, 16], [0, 1], "row_id").drop("label")
    for max_rows, max_ids in ((0, 10 ** 9), (0, 0)):  # id-set filter tier, then full shuffle join
        out = M.attach_payload(keys, dl, "row_id", max_rows, max_ids).select(
            F.col("sample_size").cast("int"), F.col("seed_idx").cast("int"), *dl.columns)
        assert sorted(tuple(r) for r in out.collect()) == ref


def test_sample_and_split_extremes(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    n = docs.count()
    assert M.sample_exact(docs, 0, 1, "doc_id").count() == 0
    assert M.sample_exact(docs, n, 1, "doc_id").count() == n
    assert M.fraction_split(docs, 0.0, 1, "doc_id").where("split = 'train'").count() == 0
    assert M.fraction_split(docs, 1.0, 1, "doc_id").where("split = 'test'").count() == 0
