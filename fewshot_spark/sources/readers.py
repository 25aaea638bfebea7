"""Readers: every source becomes ``(row_id, text, label)`` or ``(row_id, text, <flags>, label_mask)``.

Only the needed columns are selected right after the scan so that Parquet reads just those
columns (``ReadSchema`` in the plan) and filters reach the scan (``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.label_sets import flag_words
from ..session import read_table
from .catalogue import FLAGS6, LANG_CODES

MASK_LABELS = 62  # labels a BIGINT mask holds


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def read_labelled(
    df: DataFrame,
    text_col: str | Column = "text",
    label_col: str | Column = "label",
    id_col: str | Column | None = None,
    *,
    drop_null_labels: bool = False,
) -> DataFrame:
    """Single-label table ``(row_id BIGINT, text STRING, label INT)``.

    Without ``id_col`` the row id is a hash of the content (``content_ids``). A null label raises
    (one narrow job that reads the label column only) unless ``drop_null_labels``; the label
    itself stays a plain column, so filters and semi joins on the result reach the scan.
    """
    out = df.select(
        _row_id(df, id_col).alias("row_id"),
        _col(text_col).cast("string").alias("text"),
        _col(label_col).alias("label"),
    )
    if id_col is None:
        out = content_ids(out)
    if drop_null_labels:
        return out.where(F.col("label").isNotNull())
    check_labels(df.select(_col(label_col).alias("label")))
    return out


def check_labels(labels: DataFrame) -> None:
    """Raise when the column ``label`` holds a null."""
    if not labels.where(F.col("label").isNull()).select(F.lit(1)).isEmpty():
        raise ValueError("null label in labelled table")


def _row_id(df: DataFrame, id_col: str | Column | None) -> Column:
    """BIGINT row id of a key column: integers as they are, any other type (text keys) by its
    64-bit hash without the sign bit. Null without a key column."""
    if id_col is None:
        return F.lit(None).cast("bigint")
    kind = df.select(_col(id_col).alias("k")).schema["k"].dataType
    if isinstance(kind, T.IntegralType):
        return _col(id_col).cast("bigint")
    return F.xxhash64(_col(id_col)).bitwiseAND(F.lit((1 << 63) - 1))


def content_ids(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Row ids from the content: the 64-bit hash of all other columns; the n-th of several equal
    rows adds n to the hash. The ids are the same on every read and in every file layout. Equal
    rows are numbered inside their hash, so a row that is repeated very often is one group here;
    tables with a key should pass it."""
    rest = [c for c in df.columns if c != id_col]
    keyed = df.withColumn("_h", F.xxhash64(*rest).bitwiseAND(F.lit((1 << 62) - 1)))
    w = Window.partitionBy("_h").orderBy(F.lit(0))
    return keyed.withColumn(id_col, F.col("_h") + F.row_number().over(w) - 1).drop("_h").select(*df.columns)


def with_label_mask(df: DataFrame, label_cols: list[str], out: str = "label_mask") -> DataFrame:
    """Add the bitmask of set flags (bit i = label i); at most 62 labels fit a BIGINT."""
    if len(label_cols) > MASK_LABELS:
        raise ValueError("label_mask holds at most 62 labels; use label_sets.flag_words or the long form (label_unpivot)")
    mask = F.lit(0).cast("bigint")
    for i, c in enumerate(label_cols):
        mask = mask + F.when(F.col(c).cast("int") == 1, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn(out, mask)


def read_multilabel(
    df: DataFrame,
    label_cols: list[str],
    text_col: str | Column = "text",
    id_col: str | Column | None = None,
) -> DataFrame:
    """Wide multi-label table ``(row_id, text, <flags INT 0/1>, label_mask)``.

    Above 62 labels ``label_mask`` is an array of words (``operators.label_sets``), which sampling,
    partner draws and metrics take as well. Flags may be INT or BOOLEAN; they are cast to INT. The label order is the order of
    ``label_cols`` (it must equal the catalogue name order). Row ids as in ``read_labelled``.
    """
    out = df.select(
        _row_id(df, id_col).alias("row_id"),
        _col(text_col).cast("string").alias("text"),
        *[F.col(c).cast("int").alias(c) for c in label_cols],
    )
    out = content_ids(out) if id_col is None else out
    if len(label_cols) > MASK_LABELS:
        return out.withColumn("label_mask", flag_words(label_cols))
    return with_label_mask(out, label_cols)


def read_csv_labelled(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and an explicit schema (quoted multi-line fields allowed)."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """In-memory rows (a demo frame) as a DataFrame."""
    return spark.createDataFrame(rows, schema)


# ---- driver tables -------------------------------------------------------------------------


def documents_labelled(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """``documents ⋈ labels`` as a single-label table; ``label`` is ``quality``, ``toxic`` or ``lang``."""
    docs = read_table(spark, sf_dir, "documents")
    if label == "lang":
        codes = F.array(*[F.lit(c) for c in LANG_CODES])
        check_labels(docs.select(F.when(F.array_contains(codes, F.col("lang")), 1).alias("label")))
        base = docs.select("doc_id", "text", (F.array_position(codes, F.col("lang")).cast("int") - 1).alias("label"))
        joined = base.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    else:
        labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
        check_labels(labels)
        joined = docs.select("doc_id", "text").join(labels, "doc_id")
    return joined.select(F.col("doc_id").cast("bigint").alias("row_id"), "text", "label")


def documents_multilabel(spark: SparkSession, sf_dir: str, six: bool = False) -> DataFrame:
    """``documents ⋈ labels`` as a multi-label table: flags (quality, toxic), or the six flags
    ``en, de, es, fr, quality, toxic`` when ``six``."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    if six:
        cols = [F.col("doc_id"), F.col("text")] + [
            (F.col("lang") == c).cast("int").alias(c) for c in FLAGS6[:4]
        ]
        joined = docs.select(*cols).join(labels, "doc_id")
        return read_multilabel(joined, FLAGS6, "text", "doc_id")
    joined = docs.select("doc_id", "text").join(labels, "doc_id")
    return read_multilabel(joined, ["quality", "toxic"], "text", "doc_id")


def embeddings_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as ``(row_id, embedding ARRAY<DOUBLE>, label)``."""
    em = read_table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.col("label"),
    )
