"""Physical-plan checks: top-k per class before the shuffle, no row-level cross or nested-loop
join in the partner draws, pruned scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF01
from fewshot_spark.operators import examples as X
from fewshot_spark.operators import sampling as M
from fewshot_spark.sources import readers as R

SPLIT = ["sample_size", "seed_idx"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_group_limit_before_shuffle(spark):
    dl = R.documents_labelled(spark, SF01)
    keys = M._ranked_keys(dl.select("row_id", "label"), "label", [2, 8], [0, 1], "row_id")
    plan = keys._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial before the exchange, final after


def test_sampling_never_shuffles_text(spark):
    """With automatic broadcasts off (a labels table that is large), no exchange carries ``text``."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        payload = M.attach_payload(spark.range(5).withColumnRenamed("id", "row_id"), R.documents_labelled(spark, SF01))
        payload.collect()
        for line in _plan(payload).splitlines():
            if "Exchange hashpartitioning" in line:
                assert "doc_id" in line
        plan = payload._jdf.queryExecution().optimizedPlan().toString().splitlines()
        semi = next(i for i, line in enumerate(plan) if "LeftSemi" in line)
        assert any("text" in line and "Relation" in line for line in plan[semi : semi + 4])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_join_in_draws(spark):
    em = spark.read.parquet(f"{SF01}/embeddings.parquet").select(F.lit("e").alias("dataset"), F.col("vec_id").alias("row_id"), "label")
    laid = X.lay_out(em, ["dataset"], "label")
    neg = X.negative_sample(X.repeat_iterations(laid, 3), laid, ["dataset"], 0, out_text=None)
    dl6 = R.documents_multilabel(spark, SF01, six=True).withColumn("dataset", F.lit("d"))
    dis = X.disjoint_negative(X.repeat_iterations(dl6, 2), dl6, ["dataset"], 0)
    for df in (neg, dis):
        df.collect()
        plan = _plan(df)
        # rows are only ever equi-joined; the one non-equi join pairs distinct label masks
        # (a_mask & b_mask = 0), which Catalyst may plan as a product once a constant split key
        # is folded away; its inputs are the distinct-mask aggregates, not rows
        for line in plan.splitlines():
            if "CartesianProduct" in line or "BroadcastNestedLoopJoin" in line:
                assert "a_mask" in line and "b_mask" in line, line


def test_scan_reads_needed_columns_only(spark):
    dl = R.documents_labelled(spark, SF01).select("row_id", "label")
    plan = dl._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan  # documents scanned without its text
    labels = spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 1").select("doc_id")
    lp = labels._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in lp


def test_default_encoder_has_no_shuffle(spark):
    from fewshot_spark.operators import encode as E

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    assert "Exchange" not in _plan(E.encode_hash(docs))
    assert "Exchange" in _plan(E.encode_hash(docs, method="sql"))


def test_no_query_leaves_a_cached_table(spark):
    """Operators are lazy; what a run or query caches it frees."""
    import __spark_entry__ as E

    spark.catalog.clearCache()
    for key in ("flagship", "fewshot_grid", "gen_pairs", "gen_triplets_multilabel", "negative_sample", "train_grid",
                "metric_f1", "run_relabel_plain", "run_fewshot_multilabel_plain"):
        E.queries()[key](spark, "/root/testdata/sf0.001").collect()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0, key
