"""Queries: anchors, partners, triplets, pairs, iterations, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_h60 as H
from ..operators import examples as X
from ..operators import sampling as M
from ..session import read_table
from ..sources import catalogue as C
from .registry import DL6_SQL, DL_SQL, _values, dl, dl6, register

DRAW_SEED = 0
ITERS = 40
SPLIT = ["sample_size", "seed_idx"]
EX_SIZES = [16]
EX_SEEDS = list(range(5))
ML_SIZES = [4]
ML_SEEDS = list(range(3))

QUALITY = C.spec("documents_quality")
EMB = C.spec("embeddings")


def _case(col: str, mapping: dict[int, str]) -> str:
    arms = " ".join(f"WHEN {k} THEN '" + v.replace("'", "''") + "'" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


def grid_select(base: str, label: str, sizes: list[int], seeds: list[int], cols: str = "b.*") -> str:
    """SQL of a few-shot grid over CTE ``base`` (row_id + label column)."""
    seeds_sql = _values([(i, s) for i, s in enumerate(seeds)], ["seed_idx", "seed"])
    sizes_sql = _values([(s,) for s in sizes], ["sample_size"])
    return f"""(SELECT z.sample_size::INTEGER AS sample_size, r.seed_idx::INTEGER AS seed_idx, {cols}
      FROM (SELECT b.row_id, s.seed_idx,
                   row_number() OVER (PARTITION BY s.seed_idx, b.{label} ORDER BY {H('s.seed', 'b.row_id')}, b.row_id) AS rk
            FROM {base} b CROSS JOIN {seeds_sql} s) r
      JOIN {sizes_sql} z ON r.rk <= z.sample_size JOIN {base} b ON b.row_id = r.row_id)"""


def grid_ml_select(base: str, flags: list[str], sizes: list[int], seeds: list[int]) -> str:
    seeds_sql = _values([(i, s) for i, s in enumerate(seeds)], ["seed_idx", "seed"])
    sizes_sql = _values([(s,) for s in sizes], ["sample_size"])
    long = " UNION ALL ".join(f"SELECT row_id, {i} AS label_id FROM {base} WHERE {c} = 1" for i, c in enumerate(flags))
    return f"""(SELECT f.sample_size::INTEGER AS sample_size, f.seed_idx::INTEGER AS seed_idx, b.*
      FROM (SELECT k.sample_size, k.seed_idx, b.text, b.label_mask, min(b.row_id) AS row_id
            FROM (SELECT DISTINCT z.sample_size, r.seed_idx, r.row_id
                  FROM (SELECT l.row_id, s.seed_idx,
                               row_number() OVER (PARTITION BY s.seed_idx, l.label_id ORDER BY {H('s.seed', 'l.row_id')}, l.row_id) AS rk
                        FROM ({long}) l CROSS JOIN {seeds_sql} s) r
                  JOIN {sizes_sql} z ON r.rk <= z.sample_size) k
            JOIN {base} b ON b.row_id = k.row_id GROUP BY ALL) f
      JOIN {base} b ON b.row_id = f.row_id)"""


def laid_sql(src: str, split: list[str], cls: str) -> str:
    """SQL of ``lay_out``: class offsets plus hash-ordered position inside the class."""
    sk = ", ".join(split)
    part = ", ".join(f"s.{k}" for k in [*split, cls])
    return f"""(SELECT s.*, c.n_c, c.off_c, c.tot,
        c.off_c + row_number() OVER (PARTITION BY {part} ORDER BY {H("'pos'", 's.row_id')}, s.row_id) - 1 AS pos
      FROM {src} s JOIN (
        SELECT {sk}, {cls}, n_c,
               coalesce(sum(n_c) OVER (PARTITION BY {sk} ORDER BY {cls} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_c,
               sum(n_c) OVER (PARTITION BY {sk}) AS tot
        FROM (SELECT {sk}, {cls}, count(*) AS n_c FROM {src} GROUP BY ALL) x) c
      USING ({sk}, {cls}))"""


def _on(split: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in split)


def _draw_sql(split: list[str], tag: str, alias: str = "e", extra: list[str] | None = None) -> str:
    parts = [str(DRAW_SEED), *[f"{alias}.{k}" for k in split], f"{alias}.iteration", f"{alias}.row_id",
             *[f"{alias}.{c}" for c in (extra or [])], f"'{tag}'"]
    return H(*parts)


def _iters(n: int = ITERS) -> str:
    return f"(SELECT range::INTEGER AS iteration FROM range({n}))"


# ---- Spark inputs --------------------------------------------------------------------------


def ex_split(spark, sf):
    return M.fewshot_grid(dl(spark, sf), EX_SIZES, EX_SEEDS)


def ml_split(spark, sf):
    return M.fewshot_grid_multilabel(dl6(spark, sf), C.FLAGS6, ML_SIZES, ML_SEEDS)


def em_rows(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("dataset"), F.col("vec_id").alias("row_id"), "label"
    )


EX_SPLIT_SQL = grid_select(DL_SQL, "label", EX_SIZES, EX_SEEDS)
ML_SPLIT_SQL = grid_ml_select("base6", C.FLAGS6, ML_SIZES, ML_SEEDS)
EM_SQL = "(SELECT 'embeddings' AS dataset, vec_id AS row_id, label FROM embeddings)"
QUALITY_ANCHORS = X.generate_anchors(QUALITY.template, list(QUALITY.labels))
EMB_ANCHORS = X.generate_anchors(EMB.template, list(EMB.labels))


# ---- anchors -------------------------------------------------------------------------------


@register(
    "generate_anchors",
    f"""
    SELECT x.dataset, x.label AS label_id, c.template || c.label_name AS anchor, count(*) AS n_rows
    FROM (SELECT 'documents_quality' AS dataset, label FROM {DL_SQL} UNION ALL SELECT 'embeddings', label FROM embeddings) x
    JOIN {C.catalogue_values_sql()} c ON c.dataset = x.dataset AND c.label_id = x.label
    GROUP BY ALL
    """,
)
def q_generate_anchors(spark, sf):
    """Anchor sentence of every label present in the data, with its row count."""
    anchors = X.anchors_frame(C.label_catalogue(spark).where(F.col("variant") == "default"))
    data = dl(spark, sf).select(F.lit("documents_quality").alias("dataset"), "label").unionByName(
        read_table(spark, sf, "embeddings").select(F.lit("embeddings").alias("dataset"), "label")
    )
    counts = data.groupBy("dataset", F.col("label").alias("label_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(F.broadcast(anchors.drop("variant")), ["dataset", "label_id"]).select(
        "dataset", "label_id", "anchor", "n_rows"
    )


@register(
    "join_anchor",
    f"SELECT row_id, label, {_case('label', QUALITY_ANCHORS)} AS anchor FROM {DL_SQL}",
)
def q_join_anchor(spark, sf):
    anchors = X.anchors_frame(C.label_catalogue(spark).where(
        (F.col("variant") == "default") & (F.col("dataset") == "documents_quality")))
    return X.join_anchor(dl(spark, sf).select("row_id", "label"), anchors.select("label_id", "anchor"))


# ---- iterations, partners ------------------------------------------------------------------


@register(
    "iter_repeat",
    f"SELECT s.sample_size, s.seed_idx, i.iteration, s.row_id FROM {EX_SPLIT_SQL} s CROSS JOIN {_iters()} i",
)
def q_iter_repeat(spark, sf):
    rows = ex_split(spark, sf).select(*SPLIT, "row_id")
    return X.repeat_iterations(rows, ITERS).select(*SPLIT, "iteration", "row_id")


def _neg_sql(src: str, split: list[str], cls: str, cols: str, tag: str = "neg", iters: int = ITERS) -> str:
    return f"""
    WITH laid AS {laid_sql(src, split, cls)},
    e AS (SELECT l.*, i.iteration FROM laid l CROSS JOIN {_iters(iters)} i),
    d AS (SELECT e.*, {_draw_sql(split, tag)} % (e.tot - e.n_c) AS r FROM e)
    SELECT {cols} FROM d JOIN laid o ON {_on(split, 'o', 'd')}
      AND o.pos = CASE WHEN d.r < d.off_c THEN d.r ELSE d.r + d.n_c END
    """


def _pos_sql(src: str, split: list[str], cls: str, cols: str, tag: str = "pos", iters: int = ITERS) -> str:
    return f"""
    WITH laid AS {laid_sql(src, split, cls)},
    e AS (SELECT l.*, i.iteration FROM laid l CROSS JOIN {_iters(iters)} i)
    SELECT {cols} FROM e d JOIN laid o ON {_on(split, 'o', 'd')}
      AND o.pos = d.off_c + {_draw_sql(split, tag, 'd')} % d.n_c
    """


@register(
    "negative_sample",
    _neg_sql(EM_SQL, ["dataset"], "label", "d.iteration, d.row_id, d.label, o.row_id AS neg_row_id, o.label AS neg_label"),
)
def q_negative_sample(spark, sf):
    """A uniform other-class row per embedding row and iteration (whole table = one split)."""
    rows = em_rows(spark, sf)
    laid = X.lay_out(rows, ["dataset"], "label")
    ex = X.repeat_iterations(laid, ITERS)
    out = X.negative_sample(ex, laid, ["dataset"], DRAW_SEED, out_text=None, carry={"label": "neg_label"})
    return out.select("iteration", "row_id", "label", "neg_row_id", "neg_label")


@register(
    "positive_sample",
    _pos_sql(EM_SQL, ["dataset"], "label", "d.iteration, d.row_id, d.label, o.row_id AS pos_row_id, o.label AS pos_label"),
)
def q_positive_sample(spark, sf):
    rows = em_rows(spark, sf)
    laid = X.lay_out(rows, ["dataset"], "label")
    ex = X.repeat_iterations(laid, ITERS)
    out = X.positive_sample(ex, laid, ["dataset"], DRAW_SEED, out_text=None, carry={"label": "pos_label"})
    return out.select("iteration", "row_id", "label", "pos_row_id", "pos_label")


# ---- triplets and pairs --------------------------------------------------------------------


@register(
    "gen_triplets",
    f"WITH split AS {EX_SPLIT_SQL}, q AS ("
    + _neg_sql("split", SPLIT, "label",
               f"d.sample_size, d.seed_idx, d.iteration, d.row_id, d.label, o.row_id AS neg_row_id, "
               f"{_case('d.label', QUALITY_ANCHORS)} AS anchor, d.text AS positive, o.text AS negative")
    + ") SELECT * FROM q",
)
def q_gen_triplets(spark, sf):
    return X.gen_triplets(ex_split(spark, sf), QUALITY_ANCHORS, ITERS, DRAW_SEED, SPLIT)


@register(
    "gen_pairs",
    f"WITH split AS {EX_SPLIT_SQL}, p AS ("
    + _pos_sql("split", SPLIT, "label",
               "d.sample_size, d.seed_idx, d.iteration, d.row_id, o.row_id AS other_row_id, d.text AS text_a, "
               "o.text AS text_b, 1.0::DOUBLE AS target")
    + "), n AS ("
    + _neg_sql("split", SPLIT, "label",
               "d.sample_size, d.seed_idx, d.iteration, d.row_id, o.row_id AS other_row_id, d.text AS text_a, "
               "o.text AS text_b, 0.0::DOUBLE AS target")
    + ") SELECT * FROM p UNION ALL SELECT * FROM n",
)
def q_gen_pairs(spark, sf):
    return X.gen_pairs(ex_split(spark, sf), ITERS, DRAW_SEED, SPLIT)


def _disjoint_sql(split: list[str], ex_src: str, rows_src: str, cols: str, tag: str = "neg") -> str:
    """Disjoint-label negative in SQL: mask blocks, range pick, equi-join on position in mask."""
    sk = ", ".join(split)
    return f"""
    mc AS (SELECT {sk}, label_mask, count(*) AS n_m FROM {rows_src} GROUP BY ALL),
    pr AS (SELECT {', '.join('a.' + k for k in split)}, a.label_mask AS a_mask, b.label_mask AS b_mask, b.n_m
           FROM mc a JOIN mc b ON {_on(split, 'a', 'b')} AND (a.label_mask & b.label_mask) = 0),
    blk AS (SELECT *, coalesce(sum(n_m) OVER (PARTITION BY {sk}, a_mask ORDER BY b_mask
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
                   sum(n_m) OVER (PARTITION BY {sk}, a_mask) AS tot_a FROM pr),
    tot AS (SELECT DISTINCT {sk}, a_mask, tot_a FROM blk),
    d AS (SELECT e.*, {_draw_sql(split, tag)} % t.tot_a AS r
          FROM {ex_src} e JOIN tot t ON {_on(split, 't', 'e')} AND t.a_mask = e.label_mask),
    pk AS (SELECT d.*, blk.b_mask, d.r - blk.lo AS p FROM d JOIN blk ON {_on(split, 'blk', 'd')}
           AND blk.a_mask = d.label_mask AND d.r >= blk.lo AND d.r < blk.lo + blk.n_m),
    lm AS (SELECT r.*, row_number() OVER (PARTITION BY {', '.join('r.' + k for k in split)}, r.label_mask
                                          ORDER BY {H("'pos'", 'r.row_id')}, r.row_id) - 1 AS p FROM {rows_src} r)
    SELECT {cols} FROM pk d JOIN lm o ON {_on(split, 'o', 'd')} AND o.label_mask = d.b_mask AND o.p = d.p
    """


DL6_ONE = f"(SELECT 'dl6' AS dataset, * FROM {DL6_SQL})"


@register(
    "negative_sample_multilabel",
    f"WITH rows AS {DL6_ONE}, ex AS (SELECT r.*, i.iteration FROM rows r CROSS JOIN {_iters()} i WHERE r.label_mask <> 0), "
    + _disjoint_sql(["dataset"], "ex", "rows", "d.iteration, d.row_id, d.label_mask, o.row_id AS neg_row_id, o.label_mask AS neg_mask"),
)
def q_negative_sample_multilabel(spark, sf):
    """Per labelled row and iteration a uniform row sharing no label (whole DL6 = one split)."""
    rows = dl6(spark, sf).withColumn("dataset", F.lit("dl6"))
    ex = X.repeat_iterations(rows.where(F.col("label_mask") != 0), ITERS)
    out = X.disjoint_negative(ex, rows, ["dataset"], DRAW_SEED, out_text="_neg_text")
    masks = rows.select(F.col("row_id").alias("neg_row_id"), F.col("label_mask").alias("neg_mask"))
    return out.join(masks, "neg_row_id").select("iteration", "row_id", "label_mask", "neg_row_id", "neg_mask")


def _long_sql(src: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}row_id, text, {i} AS label_id FROM {src} WHERE {c} = 1" for i, c in enumerate(C.FLAGS6)
    )


@register(
    "positive_sample_multilabel",
    f"WITH long AS ({_long_sql(DL6_ONE, 'dataset, ')}), q AS ("
    + _pos_sql("long", ["dataset"], "label_id", "d.iteration, d.row_id, d.label_id, o.row_id AS pos_row_id").replace(
        "d.off_c + " + _draw_sql(["dataset"], "pos", "d"), "d.off_c + " + _draw_sql(["dataset"], "pos", "d", ["label_id"]))
    + ") SELECT * FROM q",
)
def q_positive_sample_multilabel(spark, sf):
    """Per row, iteration and set label a uniform row with that label (whole DL6 = one split)."""
    rows = dl6(spark, sf).withColumn("dataset", F.lit("dl6"))
    out = X.positive_sample_multilabel(rows, rows, C.FLAGS6, ITERS, DRAW_SEED, ["dataset"])
    return out.select("iteration", "row_id", "label_id", F.col("other_row_id").alias("pos_row_id"))


_NAMES6 = list(C.spec("documents_flags6").labels)
_TPL6 = C.spec("documents_flags6").template
_ANCHOR6 = "'" + _TPL6 + "' || concat_ws(', ', " + ", ".join(
    f"CASE WHEN d.{c} = 1 THEN '{n}' END" for c, n in zip(C.FLAGS6, _NAMES6)) + ")"


@register(
    "gen_triplets_multilabel",
    f"WITH base6 AS {DL6_SQL}, rows AS {ML_SPLIT_SQL}, "
    f"ex AS (SELECT r.*, i.iteration FROM rows r CROSS JOIN {_iters()} i WHERE r.label_mask <> 0), "
    + _disjoint_sql(SPLIT, "ex", "rows",
                    f"d.sample_size, d.seed_idx, d.iteration, d.row_id, d.label_mask, o.row_id AS neg_row_id, "
                    f"{_ANCHOR6} AS anchor, d.text AS positive, o.text AS negative"),
)
def q_gen_triplets_multilabel(spark, sf):
    """Multi-label triplets on the DL6 few-shot splits; rows without a disjoint partner skipped."""
    return X.gen_triplets_multilabel(ml_split(spark, sf), _TPL6, C.FLAGS6, _NAMES6, ITERS, DRAW_SEED, SPLIT,
                                     on_empty="skip")


def _pairs_ml_sql() -> str:
    elig = f"""elig AS (SELECT r.* FROM rows r WHERE EXISTS (SELECT 1 FROM rows b WHERE {_on(SPLIT, 'b', 'r')}
                                                        AND (b.label_mask & r.label_mask) = 0))"""
    neg = _disjoint_sql(SPLIT, "ex", "rows",
                        "d.sample_size, d.seed_idx, d.iteration, d.row_id, -1 AS label_id, o.row_id AS other_row_id, "
                        "d.text AS text_a, o.text AS text_b, 0.0::DOUBLE AS target")
    long_rows = _long_sql("rows", "sample_size, seed_idx, ")
    long_ex = _long_sql("elig", "sample_size, seed_idx, ")
    pos = f"""
    laid AS {laid_sql('long_rows', SPLIT, 'label_id')},
    sz AS (SELECT DISTINCT sample_size, seed_idx, label_id, n_c, off_c FROM laid),
    pe AS (SELECT x.*, i.iteration, sz.n_c, sz.off_c FROM long_ex x CROSS JOIN {_iters()} i
           JOIN sz ON sz.sample_size = x.sample_size AND sz.seed_idx = x.seed_idx AND sz.label_id = x.label_id),
    pos AS (SELECT d.sample_size, d.seed_idx, d.iteration, d.row_id, d.label_id, o.row_id AS other_row_id,
                   d.text AS text_a, o.text AS text_b, 1.0::DOUBLE AS target
            FROM pe d JOIN laid o ON {_on(SPLIT, 'o', 'd')} AND o.pos = d.off_c + {_draw_sql(SPLIT, 'pos', 'd', ['label_id'])} % d.n_c)
    """
    return (
        f"WITH base6 AS {DL6_SQL}, rows AS {ML_SPLIT_SQL}, {elig}, "
        f"ex AS (SELECT r.*, i.iteration FROM elig r CROSS JOIN {_iters()} i), "
        f"long_rows AS ({long_rows}), long_ex AS ({long_ex}), {pos.strip()}, negs AS ("
        + "WITH " + neg.strip() + ") SELECT * FROM pos UNION ALL SELECT * FROM negs"
    )


@register("gen_pairs_multilabel", _pairs_ml_sql())
def q_gen_pairs_multilabel(spark, sf):
    return X.gen_pairs_multilabel(ml_split(spark, sf), C.FLAGS6, ITERS, DRAW_SEED, SPLIT)


@register(
    "batch_assign",
    f"""
    WITH e AS (SELECT s.sample_size, s.seed_idx, i.iteration, s.row_id FROM {EX_SPLIT_SQL} s CROSS JOIN {_iters()} i)
    SELECT sample_size, seed_idx, iteration, row_id,
           ((row_number() OVER (PARTITION BY sample_size, seed_idx
                 ORDER BY {H(str(DRAW_SEED), 'sample_size', 'seed_idx', "'batch'", 'iteration', 'row_id')}, iteration, row_id) - 1) // 16)::BIGINT AS batch_id,
           ceil(count(*) OVER (PARTITION BY sample_size, seed_idx) / 16)::BIGINT AS steps,
           ceil(ceil(count(*) OVER (PARTITION BY sample_size, seed_idx) / 16) * 0.1::DOUBLE)::BIGINT AS warmup_steps
    FROM e
    """,
)
def q_batch_assign(spark, sf):
    """Shuffled batches of 16 over the triplet examples of every split (steps, warm-up)."""
    ex = X.repeat_iterations(ex_split(spark, sf).select(*SPLIT, "row_id"), ITERS)
    return X.assign_batches(ex, SPLIT, 16, DRAW_SEED, ["iteration", "row_id"]).select(
        *SPLIT, "iteration", "row_id", "batch_id", "steps", "warmup_steps"
    )
