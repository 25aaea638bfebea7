"""Paths that only large inputs take, forced on small data: multi-pass radix selection, numbering
in hash sub-groups, and metrics against brute force on random predictions."""

from __future__ import annotations

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from fewshot_spark.functions import ranking as RK
from fewshot_spark.functions.hashing import h60
from fewshot_spark.operators import metrics as V
from fewshot_spark.operators import sampling as M


def test_radix_selection_multi_pass(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("row_id"))
    hashed = docs.select("row_id", h60(F.lit(5), F.col("row_id")).alias("_h")).persist()
    ordered = [(r._h, r.row_id) for r in hashed.orderBy("_h", "row_id").collect()]
    monkeypatch.setattr(RK, "BAND_ROWS", 1)  # force narrowing down to single-row bands
    for k in (1, 2, 500, len(ordered)):
        h, i, n = RK.kth_smallest(hashed, k, "_h", "row_id")
        assert (h, i) == ordered[k - 1] and n == len(ordered)
    # ties on the hash are broken by id
    tied = spark.createDataFrame([(7, 1), (7, 0), (3, 5)], "_h long, row_id long")
    assert RK.kth_smallest(tied, 2, "_h", "row_id")[:2] == (7, 0)
    got = M.sample_exact(docs, 321, 5).count()
    assert got == 321


def test_sub_group_numbering_equals_row_number(spark):
    em = spark.read.parquet(f"{SF01}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "label")
    hp = em.withColumn("_hp", h60(F.lit("pos"), F.col("row_id")))
    ref = hp.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("_hp", "row_id")) - 1)
    want = {(r.row_id, r.pos) for r in ref.collect()}
    for bits in (0, 3, 7):
        got = {(r.row_id, r.pos) for r in RK.number_by_hash(hp, ["label"], "_hp", "row_id", bits=bits).collect()}
        assert got == want


def _brute(pairs):
    classes = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    n = len(pairs)
    f1 = {}
    for c in classes:
        tp = sum(1 for t, p in pairs if t == p == c)
        sup = sum(1 for t, _ in pairs if t == c)
        prd = sum(1 for _, p in pairs if p == c)
        f1[c] = (2 * tp / (sup + prd), sup)
    acc = sum(1 for t, p in pairs if t == p) / n
    tk = [sum(1 for t, _ in pairs if t == c) for c in classes]
    pk = [sum(1 for _, p in pairs if p == c) for c in classes]
    c = sum(1 for t, p in pairs if t == p)
    den = (n * n - sum(x * x for x in pk)) * (n * n - sum(x * x for x in tk))
    mcc = 0.0 if den <= 0 else (c * n - sum(a * b for a, b in zip(pk, tk))) / math.sqrt(den)
    return acc, sum(v for v, _ in f1.values()) / len(f1), sum(v * s for v, s in f1.values()) / n, mcc


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=40))
def test_metrics_match_brute_force(spark, pairs):
    r = V.summary(spark.createDataFrame(pairs, "y_true int, y_pred int"), []).first()
    acc, macro, weighted, mcc = _brute(pairs)
    assert abs(r.accuracy - acc) < 1e-8 and abs(r.micro_f1 - acc) < 1e-8
    assert abs(r.macro_f1 - macro) < 1e-8 and abs(r.weighted_f1 - weighted) < 1e-8
    assert abs(r.mcc - mcc) < 1e-8


def test_queries_independent_of_shuffle_partitions(spark):
    import __spark_entry__ as E

    qs = E.queries()
    names = ["fewshot_grid", "gen_triplets", "negative_sample_multilabel", "batch_assign", "metric_f1"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = {}
        for parts in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results[parts] = {n: sorted(map(tuple, qs[n](spark, SF01).collect())) for n in names}
        assert results["1"] == results["8"] == results["64"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_class_sub_buckets_in_layout(spark, monkeypatch):
    from fewshot_spark.operators import examples as X

    em = spark.read.parquet(f"{SF01}/embeddings.parquet").select(F.lit("e").alias("dataset"), F.col("vec_id").alias("row_id"), "label")
    laid = X.lay_out(em, ["dataset"], "label")
    ref = sorted(map(tuple, X.negative_sample(X.repeat_iterations(laid, 3), laid, ["dataset"], 0, out_text=None)
                     .select("iteration", "row_id", "neg_row_id").collect()))
    monkeypatch.setattr(RK, "GROUP_ROWS_PER_TASK", 4)  # every class counts as hot: numbered in sub-buckets
    laid2 = X.lay_out(em, ["dataset"], "label")
    got = sorted(map(tuple, X.negative_sample(X.repeat_iterations(laid2, 3), laid2, ["dataset"], 0, out_text=None)
                     .select("iteration", "row_id", "neg_row_id").collect()))
    assert got == ref
