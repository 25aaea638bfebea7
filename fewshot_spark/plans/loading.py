"""Datasets by name from files: ``<root>/<name>/<train|test>`` as Parquet, CSV or JSON lines.

Each set is prepared as the experiments define it: joined text columns, renamed labels, seeded
test samples, one file cut 75/25, and the flag columns of multi-label sets in catalogue order.
Nothing is downloaded; the files must already lie on storage that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import prepare as P
from ..operators import sampling as M
from ..sources import catalogue as C
from ..sources import readers as R
from .runs import LabelledSet

# Rows of the seeded test samples, the question set's columns, the paper set's cut.
TEST_ROWS = {"yahoo_answers_topics": 5000, "yelp_review_full": 5000, "imdb": 4000}
TEST_SEED = 0
TITLE_AND_BODY = {"yahoo_answers_topics": ("question_title", "question_content", "topic"), "abstract": ("TITLE", "ABSTRACT", None)}
TEXT_COLUMN = {"semeval2018task1": "Tweet"}
CUT = {"abstract": (0.75, 42)}
ID_COLUMNS = ("row_id", "ID", "id")


def read_part(spark: SparkSession, root: str, name: str, part: str) -> DataFrame:
    """One part of a set: the first of ``.parquet``, ``.csv`` (header), ``.json`` that exists."""
    jvm, base = spark.sparkContext._jvm, f"{root.rstrip('/')}/{name}/{part}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for kind in ("parquet", "csv", "json"):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}.{kind}")
        if path.getFileSystem(conf).exists(path):
            if kind == "csv":
                return spark.read.csv(f"{base}.csv", header=True, inferSchema=True, multiLine=True, escape='"')
            return spark.read.format(kind).load(f"{base}.{kind}")
    raise FileNotFoundError(f"no {base}.parquet, .csv or .json")


def prepared(df: DataFrame, name: str, label_cols: list[str] | None) -> DataFrame:
    """The columns a run needs, under their common names, with stable row ids."""
    if name in TITLE_AND_BODY:
        title, body, label = TITLE_AND_BODY[name]
        df = P.with_text(df, title, body).drop(title, body)
        df = df.withColumnRenamed(label, "label") if label else P.rename(df, C.ABSTRACT_RENAMES)
    elif name in TEXT_COLUMN:
        df = df.withColumnRenamed(TEXT_COLUMN[name], "text")
    key = next((c for c in ID_COLUMNS if c in df.columns), None)
    if label_cols is None:
        return R.read_labelled(df, "text", "label", key)
    return R.read_multilabel(df, label_cols, "text", key)


def load_set(spark: SparkSession, root: str, name: str) -> LabelledSet:
    """Train and test of one catalogue set; an unknown name raises."""
    spec = C.spec(name)
    flags = [C.ABSTRACT_RENAMES.get(n, n) if name == "abstract" else n for n in spec.labels] if spec.multilabel else None
    if name in CUT:
        fraction, seed = CUT[name]
        whole = M.fraction_split(prepared(read_part(spark, root, name, "train"), name, flags), fraction, seed)
        train, test = (whole.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    else:
        train, test = (prepared(read_part(spark, root, name, p), name, flags) for p in ("train", "test"))
    if name in TEST_ROWS:
        test = M.sample_exact(test, TEST_ROWS[name], TEST_SEED)
    metric = "accuracy" if spec.multilabel else spec.metric
    return LabelledSet(name, train, test, list(spec.labels), spec.template, metric, flags)


def load_sets(spark: SparkSession, cfg: RunConfig, root: str) -> list[LabelledSet]:
    """The sets that ``cfg`` names (``datasets``, ``is_dev_set``, ``is_test_set``), read from ``root``."""
    chosen = C.resolve_datasets(spark, list(cfg.datasets) or None, is_dev_set=cfg.is_dev_set, is_test_set=cfg.is_test_set)
    return [load_set(spark, root, r["dataset"]) for r in chosen.collect()]
