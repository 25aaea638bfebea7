"""Corpus pipeline: five stages of ``fewshot_spark.llm`` over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each one as
Parquet below the cluster's shared checkpoint folder and reads it again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewshot_spark.llm import decontaminate, line_dedup, minhash, packing, quality
from fewshot_spark.llm.queries import vocabulary
from fewshot_spark.session import prepare_session, read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    prepare_session(spark)
    scored = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    mark = scored.columns[-1]
    return scored.where(F.col(mark) >= 0.5).drop(mark)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; a document that loses all its text goes."""
    prepare_session(spark)
    done = line_dedup.drop_recurring(docs, min_docs=3)
    cut = F.col(done.columns[-1])
    left = done.where((cut == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(cut > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.drop(done.columns[-1])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest id) of each group of near-duplicates: five words, similarity 0.8.
    Rows are told apart by id and text, so a row goes only for its own text."""
    prepare_session(spark)
    return minhash.one_of_each(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: five words, containment 0.8."""
    prepare_session(spark)
    leaks = decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return decontaminate.drop_leaking(docs, leaks)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of 1024."""
    prepare_session(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_filter),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("packing", pack),
]

#: Training a network and counting tokens cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = prepare_session(spark).rstrip("/")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
