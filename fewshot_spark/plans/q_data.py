"""Queries: sources, cleaning scalars, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_h60
from ..operators import prepare as P
from ..operators import sampling as M
from ..session import read_table
from ..sources import catalogue as C
from .registry import DL6_SQL, DL_SQL, DLM_SQL, SEEDS, SEEDS_SQL, SIZES, SIZES_SQL, _values, dl, dl6, dlm, register

# ---- 2.1 sources ---------------------------------------------------------------------------


@register("src_labelled", f"SELECT * FROM {DL_SQL}")
def q_src_labelled(spark, sf):
    return dl(spark, sf)


@register("src_multilabel", f"SELECT * FROM {DL6_SQL}")
def q_src_multilabel(spark, sf):
    return dl6(spark, sf)


@register(
    "label_catalogue",
    f"""
    SELECT c.dataset, c.label_id, c.label_name, c.template, c.metric, count(*) AS n_rows
    FROM (SELECT 'documents_quality' AS dataset, label FROM {DL_SQL}
          UNION ALL SELECT 'embeddings', label FROM embeddings) x
    JOIN {C.catalogue_values_sql()} c ON c.dataset = x.dataset AND c.label_id = x.label
    GROUP BY ALL
    """,
)
def q_label_catalogue(spark, sf):
    """Catalogue rows of the driver sets with the number of data rows per label (broadcast join)."""
    cat = C.label_catalogue(spark).where(F.col("variant") == "default")
    data = dl(spark, sf).select(F.lit("documents_quality").alias("dataset"), "label").unionByName(
        read_table(spark, sf, "embeddings").select(F.lit("embeddings").alias("dataset"), "label")
    )
    counts = data.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(
        F.broadcast(cat), (counts.dataset == cat.dataset) & (counts.label == cat.label_id)
    ).select(cat.dataset, "label_id", "label_name", "template", "metric", "n_rows")


@register(
    "resolve_datasets",
    f"""
    SELECT r.dataset, r.metric, r.n_labels, count(DISTINCT x.label)::BIGINT AS n_seen, count(*) AS n_rows
    FROM (SELECT 'documents_quality' AS dataset, label FROM {DL_SQL}
          UNION ALL SELECT 'documents_toxic', l.toxic FROM labels l
          UNION ALL SELECT 'embeddings', label FROM embeddings) x
    JOIN (SELECT dataset, any_value(metric) AS metric, count(*)::INTEGER AS n_labels
          FROM {C.catalogue_values_sql()} WHERE "group" = 'driver' GROUP BY dataset) r ON r.dataset = x.dataset
    GROUP BY ALL
    """,
)
def q_resolve_datasets(spark, sf):
    """Resolve the driver group to (dataset, metric) and semi-join the data present for each."""
    chosen = C.resolve_datasets(spark, group="driver").select("dataset", "metric", "n_labels")
    data = (
        dl(spark, sf).select(F.lit("documents_quality").alias("dataset"), "label")
        .unionByName(read_table(spark, sf, "labels").select(F.lit("documents_toxic").alias("dataset"), F.col("toxic").alias("label")))
        .unionByName(read_table(spark, sf, "embeddings").select(F.lit("embeddings").alias("dataset"), "label"))
    )
    agg = data.groupBy("dataset").agg(
        F.count_distinct("label").cast("bigint").alias("n_seen"), F.count(F.lit(1)).alias("n_rows")
    )
    return agg.join(F.broadcast(chosen), "dataset").select("dataset", "metric", "n_labels", "n_seen", "n_rows")


# ---- 2.2 projections -----------------------------------------------------------------------


@register(
    "prep_text_concat",
    """
    SELECT a.conv_id, a.turn, a.text || ' ' || b.text AS text
    FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    """,
)
def q_prep_text_concat(spark, sf):
    """Title + ' ' + content with a null side: a turn and the next turn of the conversation
    (the last turn has none, so its text is null). Equi-join on (conv_id, turn), no window."""
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    both = conv.withColumnRenamed("text", "title").join(nxt, ["conv_id", "turn"], "left")
    return P.with_text(both, "title", "content").select("conv_id", "turn", "text")


@register(
    "prep_rename",
    "SELECT d.doc_id AS row_id, d.text, l.quality AS label, l.toxic AS flag_toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def q_prep_rename(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    j = docs.join(read_table(spark, sf, "labels"), "doc_id")
    return P.rename(j, {"doc_id": "row_id", "quality": "label", "toxic": "flag_toxic"})


@register("prep_project", "SELECT l.quality AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q_prep_project(spark, sf):
    return P.project(dl(spark, sf), drop=["row_id"])


@register(
    "label_unpivot",
    "SELECT row_id, label_id FROM ("
    + " UNION ALL ".join(f"SELECT row_id, {i} AS label_id FROM {DL6_SQL} WHERE {c} = 1" for i, c in enumerate(C.FLAGS6))
    + ")",
)
def q_label_unpivot(spark, sf):
    return P.label_unpivot(dl6(spark, sf), ["row_id"], C.FLAGS6)


@register(
    "label_matrix",
    f"""
    SELECT row_id, label_mask, list_filter([{', '.join(f'CASE WHEN {c} = 1 THEN {i} END' for i, c in enumerate(C.FLAGS6))}], lambda x: x IS NOT NULL)::VARCHAR AS labels,
           bit_count(label_mask)::INTEGER AS n_labels
    FROM {DL6_SQL}
    """,
)
def q_label_matrix(spark, sf):
    df = P.with_label_set(dl6(spark, sf), C.FLAGS6)
    return df.select(
        "row_id",
        "label_mask",
        F.concat(F.lit("["), F.array_join("labels", ", "), F.lit("]")).alias("labels"),
        F.bit_count("label_mask").cast("int").alias("n_labels"),
    )


@register(
    "map_label_names",
    f"""
    SELECT e.vec_id, e.label, c.label_name
    FROM embeddings e LEFT JOIN {C.catalogue_values_sql()} c ON c.dataset = 'documents_lang' AND c.label_id = e.label
    """,
)
def q_map_label_names(spark, sf):
    """Id -> name for the 10 embedding classes against a 4-name list: ids 4..9 map to null."""
    em = read_table(spark, sf, "embeddings").select("vec_id", "label")
    return P.map_label_names(em, C.spec("documents_lang").labels, "label", "label_name")


_NAMES6 = C.spec("documents_flags6").labels
_TPL6 = C.spec("documents_flags6").template


@register(
    "multilabel_anchor_names",
    f"""
    SELECT row_id, concat_ws(', ', {', '.join(f"CASE WHEN {c} = 1 THEN '{n}' END" for c, n in zip(C.FLAGS6, _NAMES6))}) AS label_names,
           '{_TPL6}' || concat_ws(', ', {', '.join(f"CASE WHEN {c} = 1 THEN '{n}' END" for c, n in zip(C.FLAGS6, _NAMES6))}) AS anchor
    FROM {DL6_SQL}
    """,
)
def q_multilabel_anchor_names(spark, sf):
    df = dl6(spark, sf)
    return df.select(
        "row_id",
        P.multilabel_names(C.FLAGS6, list(_NAMES6)).alias("label_names"),
        P.multilabel_anchor(_TPL6, C.FLAGS6, list(_NAMES6)).alias("anchor"),
    )


@register("filter_has_label", f"SELECT row_id, label_mask FROM {DLM_SQL} WHERE label_mask <> 0")
def q_filter_has_label(spark, sf):
    return P.filter_has_label(dlm(spark, sf)).select("row_id", "label_mask")


@register(
    "dedup_rows",
    f"SELECT text, label, min(row_id) AS row_id FROM {DL_SQL} GROUP BY text, label",
)
def q_dedup_rows(spark, sf):
    return P.dedup_rows(dl(spark, sf), ["text", "label"])


# ---- 2.4 sampling --------------------------------------------------------------------------


def _grid_sql(base: str, label: str, sizes_sql: str, seeds_sql: str, cols: str) -> str:
    return f"""
    WITH base AS {base},
    r AS (SELECT b.row_id, s.seed_idx,
                 row_number() OVER (PARTITION BY s.seed_idx, b.{label} ORDER BY {sql_h60('s.seed', 'b.row_id')}, b.row_id) AS rk
          FROM base b CROSS JOIN {seeds_sql} s)
    SELECT z.sample_size::INTEGER AS sample_size, r.seed_idx::INTEGER AS seed_idx, {cols}
    FROM r JOIN {sizes_sql} z ON r.rk <= z.sample_size JOIN base b ON b.row_id = r.row_id
    """


@register(
    "fewshot_sample",
    _grid_sql(DL_SQL, "label", _values([(8,)], ["sample_size"]), _values([(0, 0)], ["seed_idx", "seed"]),
              "b.row_id, b.text, b.label").replace(
        "SELECT z.sample_size::INTEGER AS sample_size, r.seed_idx::INTEGER AS seed_idx, ", "SELECT "),
)
def q_fewshot_sample(spark, sf):
    return M.fewshot_sample(dl(spark, sf), 8, 0)


@register("fewshot_grid", _grid_sql(DL_SQL, "label", SIZES_SQL, SEEDS_SQL, "b.row_id, b.text, b.label"))
def q_fewshot_grid(spark, sf):
    return M.fewshot_grid(dl(spark, sf), SIZES, SEEDS)


def _grid_ml_sql(sizes_sql: str, seeds_sql: str, keys: bool = True) -> str:
    long = " UNION ALL ".join(f"SELECT row_id, {i} AS label_id FROM base WHERE {c} = 1" for i, c in enumerate(C.FLAGS6))
    head = "z.sample_size::INTEGER AS sample_size, k.seed_idx::INTEGER AS seed_idx, " if keys else ""
    return f"""
    WITH base AS {DL6_SQL},
    long AS ({long}),
    r AS (SELECT l.row_id, s.seed_idx,
                 row_number() OVER (PARTITION BY s.seed_idx, l.label_id ORDER BY {sql_h60('s.seed', 'l.row_id')}, l.row_id) AS rk
          FROM long l CROSS JOIN {seeds_sql} s),
    k AS (SELECT DISTINCT z.sample_size, r.seed_idx, r.row_id FROM r JOIN {sizes_sql} z ON r.rk <= z.sample_size),
    rows AS (SELECT k.sample_size, k.seed_idx, b.* FROM k JOIN base b ON b.row_id = k.row_id),
    firsts AS (SELECT sample_size, seed_idx, text, label_mask, min(row_id) AS row_id FROM rows GROUP BY ALL)
    SELECT {head.replace('z.sample_size', 'k.sample_size')}b.* FROM firsts k JOIN base b ON b.row_id = k.row_id
    """


@register("fewshot_sample_multilabel", _grid_ml_sql(_values([(4,)], ["sample_size"]), _values([(0, 0)], ["seed_idx", "seed"]), keys=False))
def q_fewshot_sample_multilabel(spark, sf):
    return M.fewshot_sample_multilabel(dl6(spark, sf), C.FLAGS6, 4, 0)


@register("fewshot_grid_multilabel", _grid_ml_sql(SIZES_SQL, _values([(i, i) for i in range(5)], ["seed_idx", "seed"])))
def q_fewshot_grid_multilabel(spark, sf):
    return M.fewshot_grid_multilabel(dl6(spark, sf), C.FLAGS6, SIZES, list(range(5)))


@register(
    "test_subsample",
    f"""
    SELECT doc_id, text, lang FROM documents
    ORDER BY {sql_h60('0', 'doc_id')}, doc_id LIMIT 500
    """,
)
def q_test_subsample(spark, sf):
    """500 documents without replacement at seed 0 (the original draws 5,000 / 4,000 of a test split)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    return M.sample_exact(docs, 500, 0, "doc_id")


@register(
    "fraction_split",
    f"""
    WITH n AS (SELECT count(*) AS n FROM documents),
    r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {sql_h60('42', 'doc_id')}, doc_id) AS rk FROM documents)
    SELECT doc_id, lang, CASE WHEN rk <= round_even(0.75 * n.n, 0) THEN 'train' ELSE 'test' END AS split
    FROM r, n
    """,
)
def q_fraction_split(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return M.fraction_split(docs, 0.75, 42, "doc_id")
