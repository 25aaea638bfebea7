"""Scoring a text stream gives the batch predictions."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from fewshot_spark.operators import encode as E
from fewshot_spark.operators import heads as HD
from fewshot_spark.operators import sampling as M
from fewshot_spark.sources import readers as R
from fewshot_spark.streaming.scoring import score_texts, start_scoring


def test_stream_equals_batch(spark):
    dl = R.documents_labelled(spark, SF001)
    train = M.fewshot_grid(dl, [8], [0])
    enc = E.encode_hash(train.select("row_id", "text"), dim=64)
    weights = HD.fit_heads_per_split(train.select("sample_size", "seed_idx", "row_id", "label").join(enc, "row_id"),
                                     ["sample_size", "seed_idx"])
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    batch = {(r.row_id, r.y_pred) for r in score_texts(docs, weights, ["sample_size", "seed_idx"], dim=64).collect()}

    src = tempfile.mkdtemp(prefix="fewshot-stream-src-", dir="/tmp")
    docs.write.mode("overwrite").parquet(f"{src}/part")
    sink = tempfile.mkdtemp(prefix="fewshot-stream-out-", dir="/tmp")
    stream = spark.readStream.schema(docs.schema).parquet(f"{src}/part")
    q = start_scoring(stream, weights, ["sample_size", "seed_idx"], f"{sink}/out", f"{sink}/ckpt", dim=64,
                      names=["low", "high"], trigger_once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{sink}/out")
    assert {(r.row_id, r.y_pred) for r in got.collect()} == batch
    assert set(r.y_name for r in got.select("y_name").distinct().collect()) <= {"low", "high"}


def test_stream_restart_resumes(spark):
    dl = R.documents_labelled(spark, SF001)
    train = M.fewshot_grid(dl, [4], [0])
    enc = E.encode_hash(train.select("row_id", "text"), dim=32)
    weights = HD.fit_heads_per_split(train.select("sample_size", "seed_idx", "row_id", "label").join(enc, "row_id"),
                                     ["sample_size", "seed_idx"])
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    src = tempfile.mkdtemp(prefix="fewshot-stream-src-", dir="/tmp")
    docs.where("row_id < 100").write.parquet(f"{src}/a")
    sink = tempfile.mkdtemp(prefix="fewshot-stream-out-", dir="/tmp")
    schema = docs.schema
    for part in ("a", "b"):
        if part == "b":
            docs.where("row_id >= 100").write.parquet(f"{src}/b")
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        q = start_scoring(stream, weights, ["sample_size", "seed_idx"], f"{sink}/out", dim=32, trigger_once=True)
        q.awaitTermination(300)
    out = spark.read.parquet(f"{sink}/out")
    assert out.count() == docs.count() and out.select("row_id").distinct().count() == docs.count()
