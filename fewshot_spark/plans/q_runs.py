"""Queries: label-name variants, catalogue join, resume filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_h60 as H
from ..operators import sampling as M
from ..operators import variants as VA
from ..session import read_table
from ..sources import catalogue as C
from .registry import DL_SQL, SEEDS, SIZES, dl, register
from .q_examples import grid_select

PERM_SEED = 0


@register(
    "permute_labels",
    f"""
    WITH r AS (SELECT p_brand, p_type AS label_name,
                      (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1)::INTEGER AS label_id
               FROM (SELECT DISTINCT p_brand, p_type FROM part)),
    h AS (SELECT *, {H(str(PERM_SEED), 'p_brand', 'label_id')} AS hh FROM r)
    SELECT p_brand, label_id, label_name,
           coalesce(lead(label_name) OVER (PARTITION BY p_brand ORDER BY hh, label_id),
                    first_value(label_name) OVER (PARTITION BY p_brand ORDER BY hh, label_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shown_name
    FROM h
    """,
)
def q_permute_labels(spark, sf):
    """Derangement of label names, one per group: the part types of each brand (label id = rank
    of the type inside the brand)."""
    from pyspark.sql import Window

    types = read_table(spark, sf, "part").select("p_brand", F.col("p_type").alias("label_name")).distinct()
    labels = types.withColumn(
        "label_id", (F.dense_rank().over(Window.partitionBy("p_brand").orderBy("label_name")) - 1).cast("int"))
    return VA.permute_labels(labels, ["p_brand"], PERM_SEED).select("p_brand", "label_id", "label_name", "shown_name")


@register(
    "derange_labels",
    f"""
    WITH r AS (SELECT p_brand, p_type AS label_name,
                      (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1)::INTEGER AS label_id
               FROM (SELECT DISTINCT p_brand, p_type FROM part)),
    o AS (SELECT r.*, t.try, label_id + 1 AS own,
                 row_number() OVER (PARTITION BY p_brand, t.try ORDER BY {H(str(PERM_SEED), 'p_brand', 't.try', 'label_id')}, label_id) AS pos
          FROM r CROSS JOIN (SELECT range AS try FROM range({VA.TRIES})) t),
    f AS (SELECT p_brand, min(try) AS try FROM (SELECT p_brand, try FROM o GROUP BY ALL HAVING NOT bool_or(own = pos)) GROUP BY ALL)
    SELECT r.p_brand, r.label_id, r.label_name, o.label_name AS shown_name
    FROM r JOIN f ON f.p_brand = r.p_brand JOIN o ON o.p_brand = r.p_brand AND o.try = f.try AND o.pos = r.label_id + 1
    """,
)
def q_derange_labels(spark, sf):
    """Uniform derangement of the part types of each brand (label id = rank of the type inside the brand)."""
    from pyspark.sql import Window

    types = read_table(spark, sf, "part").select("p_brand", F.col("p_type").alias("label_name")).distinct()
    labels = types.withColumn(
        "label_id", (F.dense_rank().over(Window.partitionBy("p_brand").orderBy("label_name")) - 1).cast("int"))
    return VA.derange_labels(labels, ["p_brand"], PERM_SEED).select("p_brand", "label_id", "label_name", "shown_name")


_VARIANTS = ["default", "SHORT", "QA", "A", "PEM", "ALF"]


def _variant_sql() -> str:
    cat = C.catalogue_values_sql(None)
    stored = f"""SELECT dataset, variant, label_id, label_name, label_name AS shown_name, template FROM {cat}
                 WHERE dataset = 'sst2' AND variant IN ('default', 'SHORT', 'QA', 'A')"""
    base = f"(SELECT * FROM {cat} WHERE dataset = 'sst2' AND variant = 'default')"
    pem = f"""SELECT dataset, 'PEM', label_id, label_name,
                 coalesce(lead(label_name) OVER (PARTITION BY dataset ORDER BY {H(str(PERM_SEED), 'dataset', 'label_id')}, label_id),
                          first_value(label_name) OVER (PARTITION BY dataset ORDER BY {H(str(PERM_SEED), 'dataset', 'label_id')}, label_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), template FROM {base}"""
    alf = f"SELECT dataset, 'ALF', label_id, label_name, chr(97 + label_id), template FROM {base}"
    return f"""
    WITH a AS ({stored} UNION ALL {pem} UNION ALL {alf})
    SELECT a.variant, a.label_id, a.label_name, a.shown_name, a.template || a.shown_name AS anchor, count(*) AS n_rows
    FROM {DL_SQL} d JOIN a ON a.label_id = d.label
    GROUP BY ALL
    """


@register("anchors_variant", _variant_sql())
def q_anchors_variant(spark, sf):
    """The binary DL labels read as the two-class review set: rows per anchor of each variant."""
    cat = C.label_catalogue(spark)
    anchors = None
    for v in _VARIANTS:
        a = VA.anchors_variant(cat, v, PERM_SEED, ["sst2"])
        anchors = a if anchors is None else anchors.unionByName(a)
    counts = dl(spark, sf).groupBy(F.col("label").alias("label_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(F.broadcast(anchors), "label_id").select(
        "variant", "label_id", "label_name", "shown_name", "anchor", "n_rows")


@register(
    "join_catalogue",
    f"""
    SELECT d.row_id, d.label, c.label_name, c.template, c.metric
    FROM {DL_SQL} d JOIN {C.catalogue_values_sql()} c ON c.dataset = 'documents_quality' AND c.label_id = d.label
    """,
)
def q_join_catalogue(spark, sf):
    cat = C.label_catalogue(spark).where((F.col("variant") == "default") & (F.col("dataset") == "documents_quality"))
    return dl(spark, sf).select("row_id", "label").join(
        F.broadcast(cat.select(F.col("label_id").alias("label"), "label_name", "template", "metric")), "label")


def _keys_sql(sizes: list[int]) -> str:
    return f"(SELECT sample_size, seed_idx, count(*) AS n_rows FROM {grid_select(DL_SQL, 'label', sizes, SEEDS)} GROUP BY ALL)"


@register(
    "resume_pending",
    f"""
    SELECT r.sample_size, r.seed_idx, r.n_rows FROM {_keys_sql(SIZES)} r
    WHERE NOT EXISTS (SELECT 1 FROM {_keys_sql([2, 4, 8])} d WHERE d.sample_size = r.sample_size AND d.seed_idx = r.seed_idx)
    """,
)
def q_resume_pending(spark, sf):
    """Splits of the full grid that still need a run when the sizes 2, 4, 8 are finished
    (finished = the split keys of an earlier, smaller request; left-anti join on the keys)."""
    from .grid import pending_splits

    rows = dl(spark, sf)
    wanted = M.fewshot_grid(rows, SIZES, SEEDS).groupBy("sample_size", "seed_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    done = M.fewshot_grid(rows, [2, 4, 8], SEEDS).select("sample_size", "seed_idx").distinct()
    return pending_splits(wanted, done, ["sample_size", "seed_idx"])
