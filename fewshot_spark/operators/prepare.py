"""Projections and cleaning scalars (all narrow: no shuffle unless stated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .label_sets import has_label


def with_text(df: DataFrame, *cols: str, sep: str = " ", out: str = "text") -> DataFrame:
    """``out = c0 || sep || c1 ...``; a null part gives a null text (``concat``, not ``concat_ws``)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.col(c))
    return df.withColumn(out, F.concat(*parts))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    if keep is not None:
        df = df.select(*keep)
    if drop:
        df = df.drop(*drop)
    return df


def label_unpivot(df: DataFrame, id_cols: list[str], label_cols: list[str]) -> DataFrame:
    """Wide 0/1 flags -> long ``(ids..., label_id)`` for every set flag; label id = column position."""
    pos = F.posexplode(F.array(*[F.col(c).cast("int") for c in label_cols])).alias("label_id", "flag")
    return (
        df.select(*id_cols, pos)
        .where(F.col("flag") == 1)
        .select(*id_cols, F.col("label_id").cast("int").alias("label_id"))
    )


def with_label_set(df: DataFrame, label_cols: list[str], out: str = "labels") -> DataFrame:
    """``labels ARRAY<INT>``: positions of the set flags, in position order."""
    flags = F.array(*[F.col(c).cast("int") for c in label_cols])
    ids = F.transform(flags, lambda x, i: F.when(x == 1, i))
    return df.withColumn(out, F.filter(ids, lambda x: x.isNotNull()))


def map_label_names(df: DataFrame, names: list[str] | dict[int, str], id_col: str = "label", out: str = "label_name") -> DataFrame:
    """Id -> name through a literal map (missing id -> null, like ``Series.map``)."""
    items = list(names.items() if isinstance(names, dict) else enumerate(names))
    if not items:
        return df.withColumn(out, F.lit(None).cast("string"))
    m = F.create_map(*[x for k, v in items for x in (F.lit(int(k)), F.lit(v))])
    return df.withColumn(out, F.try_element_at(m, F.col(id_col)))


def map_label_names_join(df: DataFrame, catalogue: DataFrame, dataset: str, variant: str = "default",
                         id_col: str = "label", out: str = "label_name") -> DataFrame:
    """Id -> name by a broadcast left join on the catalogue (bounded: a fixed dimension table)."""
    names = catalogue.where((F.col("dataset") == dataset) & (F.col("variant") == variant)).select(
        F.col("label_id").alias(id_col), F.col("label_name").alias(out)
    )
    return df.join(F.broadcast(names), id_col, "left")


def multilabel_names(label_cols: list[str], names: list[str], sep: str = ", ") -> Column:
    """``', '.join(names of the set flags)`` in label order (null-skipping ``concat_ws``)."""
    return F.concat_ws(sep, *[F.when(F.col(c).cast("int") == 1, F.lit(n)) for c, n in zip(label_cols, names)])


def multilabel_anchor(template: str, label_cols: list[str], names: list[str]) -> Column:
    return F.concat(F.lit(template), multilabel_names(label_cols, names))


def filter_has_label(df: DataFrame, mask_col: str = "label_mask") -> DataFrame:
    """Rows with at least one label (unlabelled rows cannot be anchors)."""
    return df.where(has_label(df, mask_col))


def dedup_rows(df: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """``drop_duplicates`` on ``keys``, keeping the smallest id (deterministic "first").

    The keys are grouped by a 256-bit hash with partial aggregation before the shuffle, so neither
    texts nor a text's million copies travel; the kept ids then fetch their rows by a semi join.
    Nulls in the keys compare equal. ``id_col`` must be unique.
    """
    h = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    kept = df.groupBy(h.alias("_h")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.select(*keys, id_col).join(kept, id_col, "left_semi").select(*keys, id_col)
