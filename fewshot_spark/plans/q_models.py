"""Queries: encoders, losses, heads, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_h60 as H
from ..operators import encode as E
from ..operators import examples as X
from ..operators import heads as HD
from ..operators import losses as L
from ..operators import metrics as V
from ..operators import sampling as M
from ..session import read_table
from ..sources import catalogue as C
from ..sources import readers as R
from .q_examples import DRAW_SEED, EM_SQL, _neg_sql, _pos_sql, grid_select
from .registry import DL_SQL, dl, register

DIM = 256
ITERS_EM = 40
SENT_VECTORS = 20_000  # vectors that a join sends to all tasks at most
EMB = C.spec("embeddings")
TOKENS_SQL = r"list_filter(string_split_regex(lower({t}), '[ \t\r\n]+'), lambda x: x <> '')"


def _encode_sql(src: str, id_expr: str, text_expr: str, dim: int = DIM) -> str:
    """Long form ``(id, b, v, ss)`` of the hashed encoding of ``src``."""
    return f"""
    tk AS (SELECT {id_expr} AS id, unnest({TOKENS_SQL.format(t=text_expr)}) AS tok FROM {src}),
    cell AS (SELECT id, {H('tok')} % {dim} AS b, sum(1 - 2 * ({H("'s'", 'tok')} % 2)) AS v FROM tk GROUP BY ALL),
    nrm AS (SELECT id, sum(v * v) AS ss FROM cell GROUP BY ALL),
    enc AS (SELECT cell.id, cell.b, cell.v, round(cell.v / sqrt(nrm.ss), 6) AS value FROM cell JOIN nrm USING (id))
    """


def _long(df, id_col: str, vec: str = "embedding", nonzero: bool = True):
    out = df.select(id_col, F.posexplode(vec).alias("dim", "value"))
    return out.where(F.col("value") != 0) if nonzero else out


# ---- encoders ------------------------------------------------------------------------------


@register(
    "encode_hash",
    "WITH " + _encode_sql("documents", "doc_id", "text").strip()
    + " SELECT id AS row_id, b::INTEGER AS dim, value FROM enc WHERE v <> 0",
)
def q_encode_hash(spark, sf):
    """Hashed 256-d encoding of every whole document, long form of the non-zero cells."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return _long(E.encode_hash(docs, dim=DIM), "row_id")


@register(
    "truncate_tokens",
    f"""
    SELECT doc_id, len(tk)::INTEGER AS n_tokens, len(list_slice(tk, 1, 256))::INTEGER AS n_kept,
           array_to_string(list_slice(tk, 1, 256), ' ') AS kept
    FROM (SELECT doc_id, {TOKENS_SQL.format(t='text')} AS tk FROM documents)
    """,
)
def q_truncate_tokens(spark, sf):
    """Token count and the first 256 tokens (a model's maximum sequence length) per document."""
    docs = read_table(spark, sf, "documents")
    toks = E.tokens("text")
    kept = E.truncate_tokens(toks, 256)
    return docs.select("doc_id", F.size(toks).alias("n_tokens"), F.size(kept).alias("n_kept"),
                       F.array_join(kept, " ").alias("kept"))


@register(
    "l2_normalize",
    """
    WITH e AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS ss FROM embeddings)
    SELECT vec_id, (unnest(range(len(embedding))))::INTEGER AS dim,
           round(CASE WHEN ss > 0 THEN unnest(embedding)::DOUBLE / sqrt(ss) ELSE 0.0 END, 6) AS value
    FROM e
    """,
)
def q_l2_normalize(spark, sf):
    em = read_table(spark, sf, "embeddings")
    normed = em.select("vec_id", E.l2_normalize("embedding").alias("embedding"))
    return normed.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", "dim", F.round("value", 6).alias("value"))


_ANCHOR_SRC = f"""(SELECT DISTINCT x.dataset || ':' || x.label AS aid, c.template || c.label_name AS anchor
    FROM (SELECT 'documents_quality' AS dataset, label FROM {DL_SQL} UNION ALL SELECT 'embeddings', label FROM embeddings) x
    JOIN {C.catalogue_values_sql()} c ON c.dataset = x.dataset AND c.label_id = x.label)"""


@register(
    "encode_anchors",
    "WITH " + _encode_sql(_ANCHOR_SRC, "aid", "anchor").strip()
    + " SELECT id AS anchor_id, b::INTEGER AS dim, value FROM enc WHERE v <> 0",
)
def q_encode_anchors(spark, sf):
    """Hashed encoding of the anchor sentence of every label present in the data."""
    from ..operators.examples import anchors_frame

    anchors = anchors_frame(C.label_catalogue(spark).where(F.col("variant") == "default"))
    data = dl(spark, sf).select(F.lit("documents_quality").alias("dataset"), "label").unionByName(
        read_table(spark, sf, "embeddings").select(F.lit("embeddings").alias("dataset"), "label"))
    present = data.select("dataset", F.col("label").alias("label_id")).distinct()
    src = present.join(F.broadcast(anchors.drop("variant")), ["dataset", "label_id"]).select(
        F.concat_ws(":", "dataset", F.col("label_id").cast("string")).alias("anchor_id"), F.col("anchor").alias("text"))
    return _long(E.encode_hash(src, "anchor_id", dim=DIM), "anchor_id")


# ---- losses on the embeddings table ---------------------------------------------------------

_CENT_SQL = """(SELECT label, list(m ORDER BY dim) AS c FROM (
    SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    GROUP BY ALL) GROUP BY label)"""
_EMV_SQL = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _cos_sql(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-8))"


def em_vectors(spark, sf):
    return R.embeddings_labelled(spark, sf).withColumn("dataset", F.lit("embeddings"))


@register(
    "triplet_loss",
    "WITH q AS (" + _neg_sql(EM_SQL, ["dataset"], "label", "d.row_id, d.label, o.row_id AS neg_row_id")
    + f"""), t AS (SELECT q.label, greatest((1 - {_cos_sql('c.c', 'p.v')}) - (1 - {_cos_sql('c.c', 'n.v')}) + 0.25, 0.0) AS l
          FROM q JOIN {_CENT_SQL} c ON c.label = q.label JOIN {_EMV_SQL} p ON p.vec_id = q.row_id JOIN {_EMV_SQL} n ON n.vec_id = q.neg_row_id)
    SELECT label, count(*) AS n, round(avg(l), 6) AS loss, sum(CASE WHEN l > 0 THEN 1 ELSE 0 END)::BIGINT AS active FROM t GROUP BY label
    """,
)
def q_triplet_loss(spark, sf):
    """Cosine triplet loss (margin 0.25) per class: anchor = class centroid, positive = the row,
    negative = a uniform row of another class, 40 iterations."""
    rows = em_vectors(spark, sf)
    laid = X.lay_out(rows.select("dataset", "row_id", "label"), ["dataset"], "label")
    ex = X.repeat_iterations(laid, ITERS_EM)
    trip = X.negative_sample(ex, laid, ["dataset"], DRAW_SEED, out_text=None).select("row_id", "label", "neg_row_id")
    cents = L.mean_vectors(rows, ["label"], "embedding", out="a")
    vecs = rows.select("row_id", "embedding")
    joined = (trip.join(cents, "label")
              .join(vecs.withColumnRenamed("embedding", "p"), "row_id")
              .join(vecs.select(F.col("row_id").alias("neg_row_id"), F.col("embedding").alias("n")), "neg_row_id"))
    return L.triplet_loss(joined, ["label"], "a", "p", "n", 0.25)


@register(
    "cosine_similarity_loss",
    "WITH p AS (" + _pos_sql(EM_SQL, ["dataset"], "label", "d.row_id, d.label, o.row_id AS other, 1.0::DOUBLE AS target")
    + "), n AS (" + _neg_sql(EM_SQL, ["dataset"], "label", "d.row_id, d.label, o.row_id AS other, 0.0::DOUBLE AS target")
    + f"""), q AS (SELECT * FROM p UNION ALL SELECT * FROM n),
    t AS (SELECT q.label, power({_cos_sql('a.v', 'b.v')} - q.target, 2) AS l
          FROM q JOIN {_EMV_SQL} a ON a.vec_id = q.row_id JOIN {_EMV_SQL} b ON b.vec_id = q.other)
    SELECT label, count(*) AS n, round(avg(l), 6) AS loss FROM t GROUP BY label
    """,
)
def q_cosine_similarity_loss(spark, sf):
    """Cosine-similarity loss per class over one positive and one negative pair per row and iteration."""
    rows = em_vectors(spark, sf)
    laid = X.lay_out(rows.select("dataset", "row_id", "label"), ["dataset"], "label")
    ex = X.repeat_iterations(laid, 40)
    pos = X.positive_sample(ex, laid, ["dataset"], DRAW_SEED, out_id="other", out_text=None).withColumn("target", F.lit(1.0))
    neg = X.negative_sample(ex, laid, ["dataset"], DRAW_SEED, out_id="other", out_text=None).withColumn("target", F.lit(0.0))
    pairs = pos.select("row_id", "label", "other", "target").unionByName(neg.select("row_id", "label", "other", "target"))
    # the pairs are many times the vectors: hashing the vectors spares sorting (and spilling) pairs with vectors
    how = "broadcast" if rows.count() <= SENT_VECTORS else "shuffle_hash"
    vecs = rows.select("row_id", "embedding").hint(how)
    joined = pairs.join(vecs.withColumnRenamed("embedding", "u"), "row_id").join(
        vecs.select(F.col("row_id").alias("other"), F.col("embedding").alias("v")).hint(how), "other")
    return L.cosine_similarity_loss(joined, ["label"], "u", "v", "target")


# ---- predictions and single-label metrics -----------------------------------------------------

EM_TRAIN_SQL = grid_select("(SELECT vec_id AS row_id, label, embedding FROM embeddings)", "label", [16], [0])
PRED_SQL = f"""
    WITH tr AS {EM_TRAIN_SQL},
    w AS (SELECT label, list(m ORDER BY dim) AS c FROM (
            SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM tr)
            GROUP BY ALL) GROUP BY label),
    sc AS (SELECT e.vec_id, e.label AS y_true, w.label AS cls,
                  row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE), w.c), 9) DESC, w.label) AS rk
           FROM embeddings e, w),
    pred AS (SELECT vec_id AS row_id, y_true, cls AS y_pred FROM sc WHERE rk = 1)
"""


def em_predictions(spark, sf):
    """Nearest-centroid (class-mean weights, 16 rows per class, seed 0) predictions for all of EM."""
    rows = R.embeddings_labelled(spark, sf)
    train = M.fewshot_grid(rows, [16], [0])
    weights = HD.fit_centroids(train, ["sample_size", "seed_idx"])
    return HD.predict(rows, weights, ["sample_size", "seed_idx"]).drop("sample_size", "seed_idx")


@register("predict", PRED_SQL + "SELECT row_id, y_true, y_pred FROM pred")
def q_predict(spark, sf):
    return em_predictions(spark, sf)


_SUMMARY_SQL = PRED_SQL + """,
    cc AS (SELECT label, sum(tp)::BIGINT AS tp, sum(sup)::BIGINT AS support, sum(prd)::BIGINT AS predicted FROM (
            SELECT y_true AS label, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS prd FROM pred
            UNION ALL SELECT y_pred, 0, 0, 1 FROM pred) GROUP BY label),
    agg AS (SELECT sum(support)::DOUBLE AS s, sum(tp)::DOUBLE AS c, avg(2.0 * tp / (support + predicted)) AS macro,
                   sum(2.0 * tp / (support + predicted) * support) / sum(support)::DOUBLE AS weighted,
                   sum(predicted::DOUBLE * support) AS pt, sum(predicted::DOUBLE * predicted) AS pp,
                   sum(support::DOUBLE * support) AS tt, sum(support::DOUBLE + predicted) AS den FROM cc)
"""


@register("metric_accuracy", _SUMMARY_SQL + "SELECT s::BIGINT AS n, round(c / s, 9) AS accuracy FROM agg")
def q_metric_accuracy(spark, sf):
    return V.summary(em_predictions(spark, sf), []).select("n", "accuracy")


@register(
    "metric_f1",
    _SUMMARY_SQL + "SELECT round(macro, 9) AS macro_f1, round(2.0 * c / den, 9) AS micro_f1, round(weighted, 9) AS weighted_f1 FROM agg",
)
def q_metric_f1(spark, sf):
    return V.summary(em_predictions(spark, sf), []).select("macro_f1", "micro_f1", "weighted_f1")


@register(
    "metric_f1_per_class",
    _SUMMARY_SQL + f"""SELECT cc.label, n.label_name, cc.tp, cc.support, cc.predicted, round(2.0 * tp / (support + predicted), 9) AS f1
    FROM cc LEFT JOIN {C.catalogue_values_sql()} n ON n.dataset = 'embeddings' AND n.label_id = cc.label""",
)
def q_metric_f1_per_class(spark, sf):
    """Per-class F1 joined to class names by id."""
    from ..operators.prepare import map_label_names

    pc = V.f1_per_class(em_predictions(spark, sf), [])
    return map_label_names(pc, list(EMB.labels), "label", "label_name").select(
        "label", "label_name", "tp", "support", "predicted", "f1")


@register(
    "metric_mcc",
    _SUMMARY_SQL + """SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) > 0
        THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END, 9) AS mcc FROM agg""",
)
def q_metric_mcc(spark, sf):
    return V.summary(em_predictions(spark, sf), []).select("mcc")


@register(
    "result_record",
    _SUMMARY_SQL + """SELECT round(macro, 9) AS macro_f1, round(2.0 * c / den, 9) AS micro_f1, round(weighted, 9) AS weighted_f1,
        'accuracy' AS metric, round(c / s, 9) AS metric_value, (SELECT count(*) FROM cc)::INTEGER AS n_classes FROM agg""",
)
def q_result_record(spark, sf):
    """The stored result row (per-class F1 as a name -> value map; here its size is shown)."""
    pred = em_predictions(spark, sf)
    rec = V.result_record(V.summary(pred, []).withColumn("_k", F.lit(1)), V.f1_per_class(pred, []).withColumn("_k", F.lit(1)),
                          ["_k"], "accuracy", list(EMB.labels))
    return rec.select("macro_f1", "micro_f1", "weighted_f1", "metric", "metric_value", F.size("per_class").alias("n_classes"))


# ---- multi-label predictions and metrics ------------------------------------------------------

ML_LABELS = ["quality", "toxic"]


def dl_multilabel_predictions(spark, sf):
    """Nearest-centroid one-vs-rest on the hashed encoding of DL: label l is predicted when the
    row's vector is closer (dot product) to the centroid of rows with l than of rows without.
    The flags ride along the encoder; the driver gets one centroid per label and side."""
    import numpy as np

    rows = R.documents_multilabel(spark, sf).select("row_id", "text", *ML_LABELS, "label_mask")
    enc = E.encode_hash(rows, dim=DIM, keep=ML_LABELS)
    sides = enc.select(F.posexplode(F.array(*ML_LABELS)).alias("l", "f"), "embedding")
    cents = np.zeros((2, len(ML_LABELS), DIM))
    for r in L.mean_vectors(sides, ["l", "f"], "embedding").collect():
        cents[r["f"], r["l"]] = r["centroid"]
    shifts = 1 << np.arange(len(ML_LABELS))

    def score(batches):
        for pdf in E.small_batches(batches, "text"):
            X = E.hash_vectors(pdf["text"].tolist(), DIM)
            s0, s1 = (np.round(X @ c.T, 9) for c in cents)
            yield pdf[["row_id", "true_mask"]].assign(pred_mask=((s1 > s0) * shifts).sum(axis=1))

    scored = rows.select("row_id", "text", F.col("label_mask").alias("true_mask"))
    return scored.mapInPandas(score, "row_id long, true_mask long, pred_mask long")


_ML_PRED_SQL = f"""
    WITH rows AS (SELECT d.doc_id AS row_id, d.text, l.quality, l.toxic,
                         (l.quality + 2 * l.toxic)::BIGINT AS label_mask FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    {_encode_sql('rows', 'row_id', 'text').strip()},
    cells AS (SELECT id AS row_id, b AS dim, value FROM enc WHERE v <> 0),
    flags AS (SELECT row_id, 0 AS l, quality AS f FROM rows UNION ALL SELECT row_id, 1, toxic FROM rows),
    gn AS (SELECT l, f, count(*) AS g_n FROM flags GROUP BY ALL),
    cents AS (SELECT x.l, x.f, x.dim, x.s / gn.g_n AS c FROM (
                SELECT fl.l, fl.f, ce.dim, sum(ce.value) AS s FROM cells ce JOIN flags fl USING (row_id) GROUP BY ALL) x
              JOIN gn ON gn.l = x.l AND gn.f = x.f),
    sc AS (SELECT ce.row_id, ct.l, sum(CASE WHEN ct.f = 1 THEN ce.value * ct.c ELSE 0.0 END) AS s1,
                  sum(CASE WHEN ct.f = 0 THEN ce.value * ct.c ELSE 0.0 END) AS s0
           FROM cells ce JOIN cents ct ON ct.dim = ce.dim GROUP BY ALL),
    pm AS (SELECT row_id, sum(CASE WHEN round(s1, 9) > round(s0, 9) THEN (1 << l) ELSE 0 END)::BIGINT AS pred_mask FROM sc GROUP BY row_id),
    pred AS (SELECT r.row_id, r.label_mask AS true_mask, coalesce(pm.pred_mask, 0)::BIGINT AS pred_mask FROM rows r LEFT JOIN pm USING (row_id)),
    lc AS (SELECT l, sum(((true_mask & pred_mask) >> l) & 1) AS tp, sum((true_mask >> l) & 1) AS support,
                  sum((pred_mask >> l) & 1) AS predicted FROM pred, (SELECT unnest([0, 1]) AS l) GROUP BY l)
"""


@register("multilabel_predict", _ML_PRED_SQL + "SELECT * FROM pred")
def q_multilabel_predict(spark, sf):
    return dl_multilabel_predictions(spark, sf)


@register(
    "metric_subset_accuracy",
    _ML_PRED_SQL + "SELECT count(*) AS n, round(avg(CASE WHEN true_mask = pred_mask THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred",
)
def q_metric_subset_accuracy(spark, sf):
    return V.multilabel_summary(dl_multilabel_predictions(spark, sf), [], 2).select("n", "accuracy")


def _ml_f1_sql(zero: float) -> str:
    f1 = f"CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE {zero} END"
    micro = f"CASE WHEN sum(support + predicted) > 0 THEN 2.0 * sum(tp) / sum(support + predicted) ELSE {zero} END"
    return (_ML_PRED_SQL + f""", pl AS (SELECT l, tp, support, predicted, {f1} AS f1 FROM lc)
    SELECT round(avg(f1), 9) AS macro_f1, round({micro}, 9) AS micro_f1,
           round(CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END, 9) AS weighted_f1,
           round(list(f1 ORDER BY l)[1], 9) AS f1_quality, round(list(f1 ORDER BY l)[2], 9) AS f1_toxic
    FROM pl""")


def _ml_f1(spark, sf, zero: float):
    pred = dl_multilabel_predictions(spark, sf)
    s = V.multilabel_summary(pred, [], 2, zero_division=zero).withColumn("_k", F.lit(1))
    per = V.multilabel_f1_per_label(pred, [], 2, zero_division=zero).groupBy().agg(
        F.max(F.when(F.col("label") == 0, F.col("f1"))).alias("f1_quality"),
        F.max(F.when(F.col("label") == 1, F.col("f1"))).alias("f1_toxic")).withColumn("_k", F.lit(1))
    return s.join(per, "_k").select("macro_f1", "micro_f1", "weighted_f1", "f1_quality", "f1_toxic")


@register("metric_f1_multilabel", _ml_f1_sql(0.0))
def q_metric_f1_multilabel(spark, sf):
    return _ml_f1(spark, sf, 0.0)


@register("metric_f1_zero_division", _ml_f1_sql(1.0))
def q_metric_f1_zero_division(spark, sf):
    return _ml_f1(spark, sf, 1.0)
