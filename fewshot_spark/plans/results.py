"""Result, embedding and manifest tables (the sinks of a run).

Results are one Parquet table partitioned by ``run_id``, ``settings`` (fingerprint of all settings
that change a record) and the split keys, with one fixed schema for every kind of run; a split is
finished when its row exists for the same run and settings, which is what ``finished_splits`` reads
back for resuming. A write replaces the partitions of the splits it holds and no others
(committed per job), so a failed job leaves no partial rows, a rerun only adds the missing splits
and an override leaves one row per split. Result folders must be on shared storage (the cluster's
file system).
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, run_id, settings_key

SPLIT_KEYS = ["dataset", "sample_size", "seed_idx"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def results_path(results_dir: str) -> str:
    return f"{results_dir.rstrip('/')}/results"


RECORD_SCHEMA = (
    "run_id string, settings string, dataset string, sample_size int, seed_idx int, macro_f1 double, micro_f1 double, weighted_f1 double, "
    "metric string, metric_value double, per_class map<string,double>, skipped_rows bigint, shown_names map<int,string>"
)


def as_records(records: DataFrame) -> DataFrame:
    """``records`` in the fixed schema; columns that a kind of run does not have are null."""
    fields = [c.strip().split(" ", 1) for c in RECORD_SCHEMA.replace("string,double", "string;double").replace("int,string", "int;string").split(",")]
    return records.select(*[
        (F.col(n) if n in records.columns else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in fields
    ])


def write_results(records: DataFrame, results_dir: str) -> None:
    """Store the result rows (one per split: at most a few thousand per run), replacing any stored
    row of the same split."""
    out = as_records(records).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("run_id", "settings", *SPLIT_KEYS).parquet(results_path(results_dir))


def read_results(spark: SparkSession, results_dir: str) -> DataFrame:
    """All stored result rows in the fixed schema."""
    names = [f.name for f in spark.createDataFrame([], RECORD_SCHEMA).schema]
    return spark.read.schema(RECORD_SCHEMA).parquet(results_path(results_dir)).select(*names)


def finished_splits(spark: SparkSession, cfg: RunConfig) -> DataFrame | None:
    """Split keys with a stored result of this run and these settings (partition pruning), or None."""
    if not cfg.results_dir or not _exists(spark, results_path(cfg.results_dir)):
        return None
    mine = (F.col("run_id") == run_id(cfg)) & (F.col("settings") == settings_key(cfg))
    return read_results(spark, cfg.results_dir).where(mine).select(*SPLIT_KEYS).distinct()


def results_json(records: DataFrame) -> DataFrame:
    """One JSON document per split in the original record shape: ``macro-f1``, ``micro-f1``, the
    metric by name, then one key per class name."""
    base = F.map_from_arrays(
        F.array(F.lit("macro-f1"), F.lit("micro-f1"), F.col("metric")),
        F.array(F.col("macro_f1"), F.col("micro_f1"), F.col("metric_value")),
    )
    return records.select(*[c for c in ("run_id", *SPLIT_KEYS) if c in records.columns],
                          F.to_json(F.map_concat(base, F.col("per_class"))).alias("json"))


def write_embeddings(emb: DataFrame, results_dir: str, name: str) -> None:
    """Embeddings of a table (``row_id, embedding``) or of the anchors, as Parquet."""
    emb.write.mode("overwrite").parquet(f"{results_dir.rstrip('/')}/embeddings/{name}")


def write_manifest(spark: SparkSession, cfg: RunConfig, results_dir: str) -> DataFrame:
    """Provenance row of a run: id, settings as JSON, start time, Spark version."""
    row = [(run_id(cfg), settings_key(cfg), json.dumps(cfg.as_dict(), sort_keys=True, default=str), int(time.time()), spark.version)]
    df = spark.createDataFrame(row, "run_id string, settings string, config string, started_at long, spark_version string")
    df.write.mode("append").parquet(f"{results_dir.rstrip('/')}/runs")
    return df
