"""Queries: the flagship slice, adapter and head training, the split grid, whole runs
(SURVEY 2.8 T3-T10, 2.10 R1-R4). Training queries have no SQL oracle (rows-only check); their
invariants are in the tests."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.hashing import sql_h60 as H
from ..operators import adapter as AD
from ..operators import encode as E
from ..operators import examples as X
from ..operators import heads as HD
from ..operators import large as LG
from ..operators import losses as L
from ..operators import metrics as V
from ..operators import sampling as M
from ..session import prepare_session
from ..sources import catalogue as C
from ..sources import readers as R
from . import results as RS
from . import runs as RN
from .q_examples import EM_SQL, _neg_sql, grid_ml_select, grid_select
from .q_models import _CENT_SQL, _EMV_SQL, _cos_sql, _encode_sql
from .registry import DL_SQL, DLM_SQL, SEEDS, SIZES, dl, register

QUALITY = C.spec("documents_quality")
TOXIC = C.spec("documents_toxic")
FLAG_ITERS = 2
SPLIT = ["sample_size", "seed_idx"]


# ---- flagship: sample -> anchors -> triplets -> hashed encoding -> triplet loss per class ---------


def _flagship_sql() -> str:
    anchors = " ".join(f"WHEN {i} THEN '{a}'" for i, a in X.generate_anchors(QUALITY.template, list(QUALITY.labels)).items())
    trip = _neg_sql("split", SPLIT, "label", f"d.row_id, d.label, o.row_id AS neg_row_id, CASE d.label {anchors} END AS anchor",
                    iters=FLAG_ITERS)
    texts = "(SELECT 'r:' || row_id AS tid, text FROM split UNION ALL SELECT DISTINCT 'a:' || label, anchor FROM trip)"
    enc = _encode_sql(texts, "tid", "text").strip()

    def dot(a: str, b: str) -> str:
        return f"(SELECT coalesce(sum(x.value * y.value), 0) FROM enc x JOIN enc y ON x.b = y.b WHERE x.id = {a} AND y.id = {b})"

    def nrm(a: str) -> str:
        return f"(SELECT sqrt(coalesce(sum(x.value * x.value), 0)) FROM enc x WHERE x.id = {a})"

    a, p, n = "'a:' || t.label", "'r:' || t.row_id", "'r:' || t.neg_row_id"
    return f"""
    WITH split AS {grid_select(DL_SQL, 'label', [8], [0])},
    trip AS ({trip}),
    {enc},
    cs AS (SELECT t.label, {dot(a, p)} / greatest({nrm(a)} * {nrm(p)}, 1e-8) AS c_ap,
                  {dot(a, n)} / greatest({nrm(a)} * {nrm(n)}, 1e-8) AS c_an FROM trip t)
    SELECT label, count(*) AS n, round(avg(greatest((1 - c_ap) - (1 - c_an) + 0.25, 0.0)), 6) AS loss,
           sum(CASE WHEN (1 - c_ap) - (1 - c_an) + 0.25 > 0 THEN 1 ELSE 0 END)::BIGINT AS active
    FROM cs GROUP BY label
    """


@register("flagship", _flagship_sql())
def q_flagship(spark, sf):
    """Minimum end-to-end slice: 8 rows per quality class (seed 0) -> anchors -> triplets with a
    random other-class negative (2 iterations) -> hashed 256-d encoding of anchors and texts ->
    cosine triplet loss (margin 0.25) per class. The encoder is an Arrow map (``mapInPandas``);
    everything else is Spark SQL operators."""
    rows = M.fewshot_grid(dl(spark, sf), [8], [0])
    anchors = X.generate_anchors(QUALITY.template, list(QUALITY.labels))
    trip = X.gen_triplets(rows, anchors, FLAG_ITERS, 0, SPLIT).select("row_id", "label", "neg_row_id", "anchor")
    texts = rows.select(F.concat(F.lit("r:"), F.col("row_id").cast("string")).alias("tid"), "text").unionByName(
        trip.select(F.concat(F.lit("a:"), F.col("label").cast("string")).alias("tid"), F.col("anchor").alias("text")).distinct())
    enc = E.encode_hash(texts, "tid", "text", dim=256)
    j = (trip.withColumn("ta", F.concat(F.lit("a:"), F.col("label").cast("string")))
         .withColumn("tp", F.concat(F.lit("r:"), F.col("row_id").cast("string")))
         .withColumn("tn", F.concat(F.lit("r:"), F.col("neg_row_id").cast("string"))))
    j = (j.join(enc.select(F.col("tid").alias("ta"), F.col("embedding").alias("a")), "ta")
         .join(enc.select(F.col("tid").alias("tp"), F.col("embedding").alias("p")), "tp")
         .join(enc.select(F.col("tid").alias("tn"), F.col("embedding").alias("n")), "tn"))
    return L.triplet_loss(j, ["label"], "a", "p", "n", 0.25)


# ---- adapter (T3) -------------------------------------------------------------------------------


@register("fit_adapter")
def q_fit_adapter(spark, sf):
    """Distributed full-batch adapter fit on the whole embeddings table: triplets (class centroid,
    row, random other-class row) x 5 iterations, 20 steps. Returns the loss before each step and
    after the last (the loss must fall)."""
    ex = _adapter_examples(spark, sf).persist()
    W, hist = AD.fit_adapter(ex, "triplet", steps=20, lr=2.0, margin=0.25)
    final = AD.adapter_loss(ex, W, "triplet", 0.25)
    ex.unpersist()
    data = [(i, float(v)) for i, v in enumerate(hist)] + [(len(hist), float(final))]
    return spark.createDataFrame(data, "step int, loss double")


def _adapter_examples(spark, sf, iterations: int = 5, batches: bool = False):
    """Triplets (class centroid, row, random other-class row) x iterations with their vectors; with
    ``batches`` each iteration is a mini-batch."""
    rows = R.embeddings_labelled(spark, sf).withColumn("dataset", F.lit("embeddings"))
    laid = X.lay_out(rows.select("dataset", "row_id", "label"), ["dataset"], "label")
    trip = X.negative_sample(X.repeat_iterations(laid, iterations), laid, ["dataset"], 0, out_text=None)
    cents = L.mean_vectors(rows, ["label"], "embedding", out="a")
    vecs = rows.select("row_id", "embedding")
    ex = (trip.select("row_id", "label", "neg_row_id", "iteration").join(cents, "label")
          .join(vecs.withColumnRenamed("embedding", "p"), "row_id")
          .join(vecs.select(F.col("row_id").alias("neg_row_id"), F.col("embedding").alias("n")), "neg_row_id"))
    return ex.select("a", "p", "n", *([F.col("iteration").alias("batch_id")] if batches else []))


STEPS, STEP_RATES = 3, {"sgd": 2.0, "adamw": 0.01}


def _steps_sql(optimizer: str) -> str:
    """The first steps of the adapter from the identity: W in long form and the loss before each step."""
    ctes = [
        "q AS (" + _neg_sql(EM_SQL, ["dataset"], "label", "d.iteration, d.row_id, d.label, o.row_id AS neg_row_id", iters=STEPS) + ")",
        f"x AS MATERIALIZED (SELECT 'a' || label AS id, c AS x FROM {_CENT_SQL} UNION ALL SELECT 'r' || vec_id, v FROM {_EMV_SQL})",
        "dims AS (SELECT unnest(range(1, (SELECT max(len(x)) FROM x) + 1)) AS i)",
        "s0 AS (SELECT p.i, q.i AS j, (p.i = q.i)::INTEGER::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM dims p, dims q)",
    ]
    for k in range(STEPS):
        rate = repr(AD.lr_at(k, STEPS, STEP_RATES[optimizer]))
        ctes += [
            f"u{k} AS MATERIALIZED (SELECT id, x, u, greatest(sqrt(list_dot_product(u, u)), 1e-8) AS n FROM ("
            f"SELECT id, x, list(list_dot_product(w, x) ORDER BY i) AS u FROM x, (SELECT i, list(w ORDER BY j) AS w FROM s{k} GROUP BY i) GROUP BY ALL))",
            f"e{k} AS MATERIALIZED (SELECT a.id AS a, p.id AS p, n.id AS n, a.n AS na, p.n AS np, n.n AS nn, "
            f"list_dot_product(a.u, p.u) / (a.n * p.n) AS ap, list_dot_product(a.u, n.u) / (a.n * n.n) AS an FROM q "
            f"JOIN u{k} a ON a.id = 'a' || q.label JOIN u{k} p ON p.id = 'r' || q.row_id JOIN u{k} n ON n.id = 'r' || q.neg_row_id WHERE q.iteration = {k})",
            f"l{k} AS (SELECT avg(greatest(an - ap + 0.25, 0.0)) AS loss, count(*) AS n FROM e{k})",
            f"act{k} AS (SELECT * FROM e{k} WHERE (1 - ap) - (1 - an) + 0.25 > 0)",
            f"c{k} AS (SELECT t, s, sum(c) AS c FROM (SELECT a AS t, n AS s, 1 / (na * nn) AS c FROM act{k} "
            f"UNION ALL SELECT a, p, -1 / (na * np) FROM act{k} UNION ALL SELECT a, a, (ap - an) / (na * na) FROM act{k} "
            f"UNION ALL SELECT p, a, -1 / (na * np) FROM act{k} UNION ALL SELECT p, p, ap / (np * np) FROM act{k} "
            f"UNION ALL SELECT n, a, 1 / (na * nn) FROM act{k} UNION ALL SELECT n, n, -an / (nn * nn) FROM act{k}) GROUP BY ALL)",
            f"h{k} AS (SELECT c.t, d.i, sum(c.c * u.u[d.i]) AS h FROM c{k} c JOIN u{k} u ON u.id = c.s, dims d GROUP BY ALL)",
            f"g{k} AS (SELECT h.i, d.i AS j, sum(h.h * x.x[d.i]) / (SELECT n FROM l{k}) AS g FROM h{k} h JOIN x ON x.id = h.t, dims d GROUP BY ALL)",
        ]
        if optimizer == "sgd":
            ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT s.i, s.j, s.w - {rate} * g.g AS w FROM s{k} s JOIN g{k} g ON g.i = s.i AND g.j = s.j)")
            continue
        ctes.append(
            f"s{k + 1} AS MATERIALIZED (SELECT i, j, w - {rate} * (m / (1 - pow(0.9::DOUBLE, {k + 1})) / (sqrt(v / (1 - pow(0.999::DOUBLE, {k + 1}))) + 1e-8) "
            f"+ 0.01 * (w - (i = j)::INTEGER)) AS w, m, v FROM (SELECT s.i, s.j, s.w, 0.9 * s.m + 0.1 * g.g AS m, 0.999 * s.v + 0.001 * g.g * g.g AS v "
            f"FROM s{k} s JOIN g{k} g ON g.i = s.i AND g.j = s.j))")
    losses = ", ".join(f"(SELECT round(loss, 6) FROM l{k}) AS loss_{k}" for k in range(STEPS))
    return "WITH " + ", ".join(ctes) + f" SELECT i::INTEGER AS i, j::INTEGER AS j, round(w, 6) AS w, {losses} FROM s{STEPS}"


def _register_steps(name: str, optimizer: str) -> None:
    @register(name, _steps_sql(optimizer))
    def q_steps(spark, sf):
        """The adapter after its first mini-batch steps over all rows, one batch an iteration."""
        ex = _adapter_examples(spark, sf, STEPS, batches=True)
        W, losses = AD.fit_adapter(ex, "triplet", STEPS, STEP_RATES[optimizer], 0.25, optimizer=optimizer)
        seen = [round(v, 6) for v in losses]
        data = [(i + 1, j + 1, round(float(w), 6), *seen) for i, row in enumerate(W) for j, w in enumerate(row)]
        return spark.createDataFrame(data, "i int, j int, w double, " + ", ".join(f"loss_{k} double" for k in range(STEPS)))


_register_steps("adapter_steps", "sgd")
_register_steps("adapter_steps_moments", "adamw")


# ---- heads (T5-T9) and the split grid (T10) -------------------------------------------------------


def _em(spark, sf):
    return R.embeddings_labelled(spark, sf)


@register("head_logreg")
def q_head_logreg(spark, sf):
    """MLlib logistic regression (scikit-learn scaling) on 64 rows per class, scored on all rows."""
    rows = _em(spark, sf)
    train = M.fewshot_sample(rows, 64, 0)
    model = HD.mllib_logreg(train)
    pred = HD.mllib_predict(model, rows).select(F.col("label").alias("y_true"), "y_pred")
    return V.summary(pred, [])


@register("head_linear_svc")
def q_head_linear_svc(spark, sf):
    """Squared-hinge linear SVC (one-vs-rest) per split of an 8/32-row grid, 3 seeds, in parallel."""
    rows = _em(spark, sf)
    train = M.fewshot_grid(rows, [8, 32], [0, 1, 2])
    weights = HD.fit_heads_per_split(train, SPLIT, "LinearSVC")
    conf = HD.predict(rows, weights, SPLIT, aggregate=True)
    return V.summary(conf, SPLIT, n_col="n")


def _dl_ml_sets(spark, sf):
    parts = M.fraction_split(R.documents_multilabel(spark, sf), 0.75, 42)
    sides = [parts.where(F.col("split") == s) for s in ("train", "test")]
    return tuple(E.encode_hash(side, dim=256, keep=["quality", "toxic", "label_mask"]) for side in sides)


def _multilabel_head(spark, sf, strategy: str):
    train, test = _dl_ml_sets(spark, sf)
    models = HD.mllib_multilabel(train, ["quality", "toxic"], strategy)
    pred = HD.mllib_multilabel_predict(models, test, strategy)
    return V.multilabel_summary(pred.select(F.col("label_mask").alias("true_mask"), "pred_mask"), [], 2)


@register("head_one_vs_rest")
def q_head_one_vs_rest(spark, sf):
    """One binary MLlib LR per label (quality, toxic) on the hashed documents, 75/25 split."""
    return _multilabel_head(spark, sf, "one-vs-rest")


@register("head_multi_output")
def q_head_multi_output(spark, sf):
    return _multilabel_head(spark, sf, "multi-output")


@register("head_classifier_chain")
def q_head_classifier_chain(spark, sf):
    """Label j also sees labels < j (true in fit, predicted in predict)."""
    return _multilabel_head(spark, sf, "classifier-chain")


# ---- heads on all rows of a table, with a certificate of the optimum --------------------------

OPTIMAL = 2 * HD.GRADIENT_TOL  # bound on the gradient's largest entry, recomputed in SQL functions


def _certified(rows, heads, kind: str):
    """Per label: rows, positives, and whether the fitted weights are an optimum over all rows."""
    found = LG.gradient_sizes(rows, heads, kind)
    return found.select("label", "n_rows", "positives", (F.col("gradient") <= OPTIMAL).alias("optimal"))


_EM_HEAD_SQL = f"SELECT label, (SELECT count(*) FROM {EM_SQL}) AS n_rows, count(*) AS positives, true AS optimal FROM {EM_SQL} GROUP BY label"
_FLAG_HEAD_SQL = "SELECT 0 AS label, count(*) AS n_rows, sum(quality)::BIGINT AS positives, true AS optimal FROM {0} UNION ALL " \
    "SELECT 1, count(*), sum(toxic)::BIGINT, true FROM {0}"


def _em_head(spark, sf, fit, kind: str):
    rows = _em(spark, sf)
    classes, W, b = fit(rows)
    one_of = F.transform(F.sequence(F.lit(0), F.lit(int(classes.max()))), lambda i: (i == F.col("label")).cast("int"))
    heads = LG.class_weights(spark, classes, W, b).withColumn("chain", F.array().cast("array<double>"))
    return _certified(rows.select("row_id", "embedding", one_of.alias("labels")), heads, kind)


@register("head_logreg_all", _EM_HEAD_SQL)
def q_head_logreg_all(spark, sf):
    """Soft-max logistic regression on all vectors: sums in Spark, certified at its optimum."""
    return _em_head(spark, sf, LG.fit_logreg, "softmax")


@register("head_linear_svc_all", _EM_HEAD_SQL)
def q_head_linear_svc_all(spark, sf):
    """Squared-hinge SVC with penalised intercept on all vectors, all classes in the same passes."""
    return _em_head(spark, sf, LG.fit_linear_svc, "hinge")


def _flag_heads(spark, sf, strategy: str):
    rows = E.encode_hash(R.documents_multilabel(spark, sf), dim=256, keep=["quality", "toxic"]).persist()
    try:
        heads, _ = LG.fit_multilabel(rows, ["quality", "toxic"], strategy)
    finally:
        rows.unpersist()
    return _certified(rows.select("row_id", "embedding", F.array("quality", "toxic").alias("labels")), LG.multilabel_weights(spark, heads), "logistic")


def _register_flag_heads(name: str, strategy: str) -> None:
    @register(name, _FLAG_HEAD_SQL.format(DLM_SQL))
    def run(spark, sf):
        return _flag_heads(spark, sf, strategy)

    run.__doc__ = f"Both labels of all documents in one {strategy} fit, certified at its optimum."


for _name, _strategy in (("head_one_vs_rest_all", "one-vs-rest"), ("head_multi_output_all", "multi-output"), ("head_classifier_chain_all", "classifier-chain")):
    _register_flag_heads(_name, _strategy)


@register("train_grid")
def q_train_grid(spark, sf):
    """The full grid (sizes 2..64 x 20 seeds) of the embeddings table: one soft-max LR per split,
    all splits fitted in parallel, every split scored on the whole table (confusion counts only)."""
    rows = _em(spark, sf)
    train = M.fewshot_grid(rows, SIZES, SEEDS)
    weights = HD.fit_heads_per_split(train, SPLIT, "logistic_regression").checkpoint()
    conf = HD.predict(rows, weights, SPLIT, aggregate=True)
    return V.summary(conf, SPLIT, n_col="n")


# ---- whole runs (R1-R4) -------------------------------------------------------------------------


def _dl_set(spark, sf, label: str = "quality", spec: C.DatasetSpec = QUALITY) -> RN.LabelledSet:
    parts = M.fraction_split(R.documents_labelled(spark, sf, label), 0.75, 42)
    return RN.LabelledSet(spec.dataset, parts.where(F.col("split") == "train").drop("split"),
                          parts.where(F.col("split") == "test").drop("split"), list(spec.labels), spec.template, spec.metric)


def _records(rec, *extra: str):
    return rec.select("run_id", "dataset", "sample_size", "seed_idx", "macro_f1", "micro_f1", "weighted_f1",
                      "metric", "metric_value", "per_class", *extra)


@register("run_fewshot")
def q_run_fewshot(spark, sf):
    """Single-label anchored run on documents ⋈ labels (75/25 split): sizes 2..64 x 20 seeds,
    triplet loss, 40 iterations, batch 16, logistic regression; one result row per split."""
    cfg = RunConfig(loss="TripletLoss", sample_sizes=tuple(SIZES), seeds_num=len(SEEDS), setting_name="DRIVER")
    return _records(RN.run_fewshot(spark, cfg, [_dl_set(spark, sf)], write=False))


@register("run_fewshot_pairs")
def q_run_fewshot_pairs(spark, sf):
    """The comparison method: plain positive/negative pairs with the cosine-similarity loss, 20 iterations."""
    cfg = RunConfig(loss="CosineSimilarityLoss", num_iterations=20, sample_sizes=tuple(SIZES), seeds_num=5,
                    setting_name="DRIVER")
    return _records(RN.run_fewshot(spark, cfg, [_dl_set(spark, sf)], write=False))


@register("run_fewshot_multilabel")
def q_run_fewshot_multilabel(spark, sf):
    """Multi-label anchored run on (quality, toxic) flags: rows without a disjoint partner are
    skipped as anchors; one-vs-rest heads; subset accuracy and F1 per split."""
    base = R.documents_multilabel(spark, sf)
    parts = M.fraction_split(base, 0.75, 42)
    spec = C.spec("documents_flags")
    ds = RN.LabelledSet("documents_flags", parts.where(F.col("split") == "train").drop("split"),
                        parts.where(F.col("split") == "test").drop("split"), list(spec.labels), spec.template, "f1",
                        ["quality", "toxic"])
    cfg = RunConfig(loss="TripletLoss", kind="multilabel", sample_sizes=(2, 4, 8, 16), seeds_num=5, setting_name="multilabel")
    return _records(RN.run_fewshot_multilabel(spark, cfg, [ds], write=False), "skipped_rows")


@register("run_ablation")
def q_run_ablation(spark, sf):
    """Label-name ablation: the binary quality labels read as the two-class review set with the
    permuted names (PEM); result keys keep the real names."""
    cfg = RunConfig(loss="TripletLoss", kind="ablation", setting_name="PEM", sample_sizes=(2, 8, 32), seeds_num=5)
    ds = _dl_set(spark, sf)
    ds = RN.LabelledSet(ds.name, ds.train, ds.test, list(C.DEV_LABELS["sst2"]), C.DEV_TEMPLATES["sst2"], "accuracy")
    rec = RN.run_ablation(spark, cfg, [ds], C.label_catalogue(spark), {ds.name: "sst2"}, write=False)
    return _records(rec, "shown_names")


# ---- the same runs with class-mean heads and no adapter, restated in SQL ------------------------


def _cut_sql(base: str) -> str:
    return f"""base AS (SELECT * FROM {base}),
    cut AS (SELECT b.*, row_number() OVER (ORDER BY {H('42', 'row_id')}, row_id) <= round_even(0.75 * count(*) OVER (), 0) AS is_train FROM base b),
    train AS (SELECT * FROM cut WHERE is_train), test AS (SELECT * FROM cut WHERE NOT is_train)"""


_ACCURACY_SQL = "'accuracy' AS metric, round(sum(tp) / sum(sup)::DOUBLE, 9) AS metric_value"
# multi-class Matthews correlation from the class counts, as the metric operator computes it
_MCC_SQL = """'matthews_correlation' AS metric, round(CASE
    WHEN (sum(sup)::DOUBLE * sum(sup) - sum(prd::DOUBLE * prd)) * (sum(sup)::DOUBLE * sum(sup) - sum(sup::DOUBLE * sup)) > 0
    THEN (sum(tp)::DOUBLE * sum(sup) - sum(prd::DOUBLE * sup))
         / sqrt((sum(sup)::DOUBLE * sum(sup) - sum(prd::DOUBLE * prd)) * (sum(sup)::DOUBLE * sum(sup) - sum(sup::DOUBLE * sup)))
    ELSE 0.0 END, 9) AS metric_value"""


def _centroid_run_sql(sizes: list[int], seeds: list[int], shown: str = "", base: str = DL_SQL,
                      dataset: str = "documents_quality", metric: str = _ACCURACY_SQL) -> str:
    """Records of a run with class-mean heads: one row per split."""
    return f"""
    WITH {_cut_sql(base)},
    split AS {grid_select('train', 'label', sizes, seeds, 'b.row_id, b.label')},
    {_encode_sql('cut', 'row_id', 'text').strip()},
    sz AS (SELECT sample_size, seed_idx, label, count(*) AS n FROM split GROUP BY ALL),
    cent AS (SELECT s.sample_size, s.seed_idx, s.label, e.b, sum(e.value) / any_value(sz.n) AS c
             FROM split s JOIN enc e ON e.id = s.row_id JOIN sz USING (sample_size, seed_idx, label) GROUP BY ALL),
    dots AS (SELECT e.id, c.sample_size, c.seed_idx, c.label, sum(e.value * c.c) AS s
             FROM enc e JOIN cent c USING (b) WHERE e.id IN (SELECT row_id FROM test) GROUP BY ALL),
    ranked AS (SELECT t.row_id, t.label AS y_true, sz.sample_size, sz.seed_idx, sz.label AS y_pred,
                      row_number() OVER (PARTITION BY t.row_id, sz.sample_size, sz.seed_idx ORDER BY round(coalesce(d.s, 0), 9) DESC, sz.label) AS rk
               FROM test t CROSS JOIN sz LEFT JOIN dots d ON d.id = t.row_id AND d.sample_size = sz.sample_size
                    AND d.seed_idx = sz.seed_idx AND d.label = sz.label),
    pred AS (SELECT * FROM ranked WHERE rk = 1),
    cc AS (SELECT sample_size, seed_idx, label, sum(tp) AS tp, sum(sup) AS sup, sum(prd) AS prd FROM (
            SELECT sample_size, seed_idx, y_true AS label, (y_true = y_pred)::INTEGER AS tp, 1 AS sup, 0 AS prd FROM pred
            UNION ALL SELECT sample_size, seed_idx, y_pred, 0, 0, 1 FROM pred) GROUP BY ALL)
    SELECT '{dataset}' AS dataset, sample_size, seed_idx, round(avg(2.0 * tp / (sup + prd)), 9) AS macro_f1,
           round(2.0 * sum(tp) / sum(sup + prd), 9) AS micro_f1,
           round(sum(2.0 * tp / (sup + prd) * sup) / sum(sup), 9) AS weighted_f1,
           {metric},
           max(CASE WHEN label = 0 THEN round(2.0 * tp / (sup + prd), 9) END) AS f1_0,
           max(CASE WHEN label = 1 THEN round(2.0 * tp / (sup + prd), 9) END) AS f1_1{shown}
    FROM cc GROUP BY sample_size, seed_idx
    """


def _plain(kind: str, **other) -> RunConfig:
    return RunConfig(loss="TripletLoss", kind=kind, classifier="centroid", use_adapter=False, num_iterations=1, **other)


def _flat(rec, names: list[str], *extra):
    return rec.select("dataset", "sample_size", "seed_idx", "macro_f1", "micro_f1", "weighted_f1", "metric", "metric_value",
                      *[F.try_element_at("per_class", F.lit(n)).alias(f"f1_{i}") for i, n in enumerate(names)], *extra)


@register("run_fewshot_plain", _centroid_run_sql(SIZES, SEEDS[:5]))
def q_run_fewshot_plain(spark, sf):
    """The whole single-label run (cut, grid, anchors, examples, encoding, heads, scoring, records)
    with class-mean heads and no adapter: sizes 2..64 x 5 seeds."""
    cfg = _plain("single", sample_sizes=tuple(SIZES), seeds_num=5, setting_name="DRIVER")
    return _flat(RN.run_fewshot(spark, cfg, [_dl_set(spark, sf)], write=False), list(QUALITY.labels))


@register("resume_records", f"""
    WITH stored AS ({_centroid_run_sql([2, 4], SEEDS[:3])}),
    wanted AS (SELECT s.sample_size, i.seed_idx FROM (VALUES (2), (4), (8)) s(sample_size), (VALUES (0), (1), (2), (3)) i(seed_idx))
    SELECT sample_size, seed_idx, stored.macro_f1, stored.metric_value, stored.f1_0, stored.f1_1,
           stored.sample_size IS NULL AS pending, true AS pending_with_other_settings
    FROM wanted LEFT JOIN stored USING (sample_size, seed_idx)
    """)
def q_resume_records(spark, sf):
    """A run of two sizes and three seeds whose records are committed two splits at a time, read
    back from the shared folder, against a larger request: what is stored, what is pending, and what
    would be pending under another setting."""
    from dataclasses import replace

    folder = f"{prepare_session(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    cfg = _plain("single", sample_sizes=(2, 4), seeds_num=3, setting_name="DRIVER", results_dir=folder, splits_per_commit=2)
    ds = _dl_set(spark, sf)
    RN.run_fewshot(spark, cfg, [ds])
    stored = _flat(RS.read_results(spark, folder), list(QUALITY.labels))
    wider = replace(cfg, sample_sizes=(2, 4, 8), seeds_num=4)
    keys = ["sample_size", "seed_idx"]
    wanted = RN.pending(spark, replace(wider, override_results=True), ds).select(*keys)
    for name, asked in (("pending", wider), ("pending_with_other_settings", replace(wider, adapter_lr=0.1))):
        left = RN.pending(spark, asked, ds).select(*keys, F.lit(True).alias(name))
        wanted = wanted.join(left, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return wanted.join(stored.select(*keys, "macro_f1", "metric_value", "f1_0", "f1_1"), keys, "left")


@register("resume_records", f"""
    WITH stored AS ({_centroid_run_sql([2, 4], SEEDS[:3])}),
    wanted AS (SELECT s.sample_size, i.seed_idx FROM (VALUES (2), (4), (8)) s(sample_size), (VALUES (0), (1), (2), (3)) i(seed_idx))
    SELECT sample_size, seed_idx, stored.macro_f1, stored.metric_value, stored.f1_0, stored.f1_1,
           stored.macro_f1 IS NULL AS pending, true AS pending_with_other_settings
    FROM wanted LEFT JOIN stored USING (sample_size, seed_idx)
    """)
def q_resume_records(spark, sf):
    """A run of two sizes and three seeds whose records are committed two splits at a time, read
    back from the shared folder, against a larger request: what is stored, what is pending, and what
    would be pending under another setting."""
    folder = f"{prepare_session(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    cfg = _plain("single", sample_sizes=(2, 4), seeds_num=3, setting_name="DRIVER", results_dir=folder, splits_per_commit=2)
    ds = _dl_set(spark, sf)
    RN.run_fewshot(spark, cfg, [ds])
    stored = _flat(RS.read_results(spark, folder), list(QUALITY.labels))
    wider = replace(cfg, sample_sizes=(2, 4, 8), seeds_num=4)
    keys = ["sample_size", "seed_idx"]
    wanted = RN.pending_splits(spark, replace(wider, override_results=True), ds).select(*keys)
    for name, asked in (("pending", wider), ("pending_with_other_settings", replace(wider, adapter_lr=0.1))):
        left = RN.pending_splits(spark, asked, ds).select(*keys, F.lit(True).alias(name))
        wanted = wanted.join(left, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return wanted.join(stored.select(*keys, "macro_f1", "metric_value", "f1_0", "f1_1"), keys, "left")


TOXIC_SQL = DL_SQL.replace("l.quality AS label", "l.toxic AS label")


@register("run_fewshot_matthews_plain", _centroid_run_sql([4, 16, 64], SEEDS[:5], "", TOXIC_SQL, "documents_toxic", _MCC_SQL))
def q_run_fewshot_matthews_plain(spark, sf):
    """The single-label run on the toxic flag, whose stored metric is the Matthews correlation."""
    cfg = _plain("single", sample_sizes=(4, 16, 64), seeds_num=5, setting_name="DRIVER")
    return _flat(RN.run_fewshot(spark, cfg, [_dl_set(spark, sf, "toxic", TOXIC)], write=False), list(TOXIC.labels))


@register("run_fewshot_svc")
def q_run_fewshot_svc(spark, sf):
    """The single-label run with LinearSVC heads."""
    cfg = RunConfig(loss="TripletLoss", classifier="LinearSVC", sample_sizes=(4, 16), seeds_num=3, num_iterations=10, setting_name="DRIVER")
    return _records(RN.run_fewshot(spark, cfg, [_dl_set(spark, sf)], write=False))


def _run_flags(spark, sf, strategy: str, loss: str):
    parts = M.fraction_split(R.documents_multilabel(spark, sf), 0.75, 42)
    spec = C.spec("documents_flags")
    ds = RN.LabelledSet("documents_flags", parts.where(F.col("split") == "train").drop("split"),
                        parts.where(F.col("split") == "test").drop("split"), list(spec.labels), spec.template, "accuracy",
                        ["quality", "toxic"])
    cfg = RunConfig(loss=loss, kind="multilabel", sample_sizes=(4, 16), seeds_num=3, num_iterations=10,
                    multi_target_strategy=strategy, setting_name="multilabel")
    return _records(RN.run_fewshot_multilabel(spark, cfg, [ds], write=False), "skipped_rows")


@register("run_fewshot_multilabel_chain")
def q_run_fewshot_multilabel_chain(spark, sf):
    """The multi-label run with classifier-chain heads."""
    return _run_flags(spark, sf, "classifier-chain", "TripletLoss")


@register("run_fewshot_multilabel_pairs")
def q_run_fewshot_multilabel_pairs(spark, sf):
    """The multi-label run on pairs with the cosine-similarity loss."""
    return _run_flags(spark, sf, "one-vs-rest", "CosineSimilarityLoss")


_REVIEW_NAMES = list(C.DEV_LABELS["sst2"])
_SHOWN_SQL = "".join(
    f""",
           (SELECT shown_name FROM (SELECT label_id, coalesce(lead(label_name) OVER w, first_value(label_name) OVER w) AS shown_name
              FROM {C.catalogue_values_sql()} WHERE dataset = 'sst2'
              WINDOW w AS (ORDER BY {H('0', 'dataset', 'label_id')}, label_id)) WHERE label_id = {i}) AS shown_{i}"""
    for i in range(len(_REVIEW_NAMES))
)


@register("run_ablation_plain", _centroid_run_sql([2, 8, 32], SEEDS[:5], _SHOWN_SQL))
def q_run_ablation_plain(spark, sf):
    """The ablation run with permuted label names, class-mean heads and no adapter; the names that
    the anchors showed stand beside the F1 of the real classes."""
    ds = _dl_set(spark, sf)
    ds = RN.LabelledSet(ds.name, ds.train, ds.test, _REVIEW_NAMES, C.DEV_TEMPLATES["sst2"], "accuracy")
    cfg = _plain("ablation", setting_name="PEM", sample_sizes=(2, 8, 32), seeds_num=5)
    rec = RN.run_ablation(spark, cfg, [ds], C.label_catalogue(spark), {ds.name: "sst2"}, write=False)
    return _flat(rec, _REVIEW_NAMES, *[F.try_element_at("shown_names", F.lit(i)).alias(f"shown_{i}") for i in range(len(_REVIEW_NAMES))])


def _stored_variant_sql(variant: str) -> str:
    """Shown names of a stored variant (or of the letters)."""
    if variant == "ALF":
        return "".join(f", chr(97 + {i}) AS shown_{i}" for i in range(len(_REVIEW_NAMES)))
    return "".join(
        f", (SELECT label_name FROM {C.catalogue_values_sql(variant)} WHERE dataset = 'sst2' AND label_id = {i}) AS shown_{i}"
        for i in range(len(_REVIEW_NAMES))
    )


def _register_variant(variant: str) -> None:
    @register(f"run_ablation_{variant.lower()}_plain", _centroid_run_sql([2, 8], SEEDS[:3], _stored_variant_sql(variant)))
    def run(spark, sf):
        ds = _dl_set(spark, sf)
        ds = RN.LabelledSet(ds.name, ds.train, ds.test, _REVIEW_NAMES, C.DEV_TEMPLATES["sst2"], "accuracy")
        cfg = _plain("ablation", setting_name=variant, sample_sizes=(2, 8), seeds_num=3)
        rec = RN.run_ablation(spark, cfg, [ds], C.label_catalogue(spark), {ds.name: "sst2"}, write=False)
        return _flat(rec, _REVIEW_NAMES, *[F.try_element_at("shown_names", F.lit(i)).alias(f"shown_{i}") for i in range(len(_REVIEW_NAMES))])


for _v in ("ALF", "SHORT", "QA", "A"):
    _register_variant(_v)


@register(
    "split_plan",
    "WITH " + f"""split AS {grid_select(DL_SQL, 'label', SIZES, SEEDS, 'b.row_id, b.label')},
    n AS (SELECT sample_size, seed_idx, count(*) AS n_train, 40 * count(*) AS n_examples FROM split GROUP BY ALL)
    SELECT sample_size, seed_idx, n_train, n_examples, ceil(n_examples / 16.0)::BIGINT AS steps,
           ceil(0.1 * ceil(n_examples / 16.0))::BIGINT AS warmup_steps FROM n""",
)
def q_split_plan(spark, sf):
    """What every split of the full grid trains on: rows, triplets (40 iterations), adapter steps
    (batch 16) and warm-up steps, counted from the generated examples."""
    grid = M.fewshot_grid(dl(spark, sf).select("row_id", "label"), SIZES, SEEDS)
    ex = X.gen_triplets(grid, X.generate_anchors(QUALITY.template, list(QUALITY.labels)), 40, 0, SPLIT, text_col=None)
    steps = X.assign_batches(ex.select(*SPLIT, "iteration", "row_id"), SPLIT, 16, 0, ["iteration", "row_id"])
    return steps.groupBy(*SPLIT).agg(
        F.count_distinct("row_id").alias("n_train"), F.count(F.lit(1)).alias("n_examples"),
        F.count_distinct("batch_id").alias("steps"), F.max("warmup_steps").alias("warmup_steps"))


@register(
    "adapter_initial_loss",
    "WITH q AS (" + _neg_sql(EM_SQL, ["dataset"], "label", "d.row_id, d.label, o.row_id AS neg_row_id", iters=5)
    + f""")
    SELECT count(*) AS n, round(avg(greatest((1 - {_cos_sql('c.c', 'p.v')}) - (1 - {_cos_sql('c.c', 'n.v')}) + 0.25, 0.0)), 6) AS loss
    FROM q JOIN {_CENT_SQL} c ON c.label = q.label JOIN {_EMV_SQL} p ON p.vec_id = q.row_id JOIN {_EMV_SQL} n ON n.vec_id = q.neg_row_id
    """,
)
def q_adapter_initial_loss(spark, sf):
    """Loss that the adapter starts from (identity map) over all its training triplets."""
    import numpy as np

    ex = _adapter_examples(spark, sf)
    n = ex.count()
    dim = ex.select(F.size("p")).first()[0]
    return spark.createDataFrame([(n, round(float(AD.adapter_loss(ex, np.eye(dim), "triplet", 0.25)), 6))], "n long, loss double")


def _multilabel_run_sql(sizes: list[int], seeds: list[int]) -> str:
    flags = ["quality", "toxic"]
    pos = " UNION ALL ".join(f"SELECT sample_size, seed_idx, row_id, {i} AS l, {c} AS f FROM split" for i, c in enumerate(flags))
    return f"""
    WITH {_cut_sql(DLM_SQL)},
    split AS {grid_ml_select('train', flags, sizes, seeds)},
    {_encode_sql('cut', 'row_id', 'text').strip()},
    fl AS ({pos}),
    sz AS (SELECT sample_size, seed_idx, l, count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 0) AS n0 FROM fl GROUP BY ALL),
    w AS (SELECT fl.sample_size, fl.seed_idx, fl.l, e.b,
                 coalesce(sum(e.value) FILTER (WHERE f = 1), 0) / any_value(n1) - coalesce(sum(e.value) FILTER (WHERE f = 0), 0) / any_value(n0) AS c
          FROM fl JOIN enc e ON e.id = fl.row_id JOIN sz USING (sample_size, seed_idx, l) WHERE n1 > 0 AND n0 > 0 GROUP BY ALL),
    dots AS (SELECT e.id, w.sample_size, w.seed_idx, w.l, sum(e.value * w.c) AS s
             FROM enc e JOIN w USING (b) WHERE e.id IN (SELECT row_id FROM test) GROUP BY ALL),
    lab AS (SELECT t.row_id, sz.sample_size, sz.seed_idx, sz.l, CASE WHEN sz.l = 0 THEN t.quality ELSE t.toxic END AS t,
                   CASE WHEN n0 = 0 THEN 1 WHEN n1 = 0 THEN 0 WHEN coalesce(d.s, 0) > 0 THEN 1 ELSE 0 END AS p
            FROM test t CROSS JOIN sz LEFT JOIN dots d ON d.id = t.row_id AND d.sample_size = sz.sample_size
                 AND d.seed_idx = sz.seed_idx AND d.l = sz.l),
    f AS (SELECT sample_size, seed_idx, l, sum(t * p) AS tp, sum(t) AS sup, sum(p) AS prd,
                 CASE WHEN sum(t) + sum(p) > 0 THEN 2.0 * sum(t * p) / (sum(t) + sum(p)) ELSE 0 END AS f1 FROM lab GROUP BY ALL),
    ex AS (SELECT sample_size, seed_idx, avg(ok) AS acc FROM (
             SELECT sample_size, seed_idx, row_id, min((t = p)::INTEGER) AS ok FROM lab GROUP BY ALL) GROUP BY ALL),
    sk AS (SELECT sample_size, seed_idx, sum((label_mask <> 0 AND NOT EXISTS (SELECT 1 FROM split o WHERE o.sample_size = s.sample_size
             AND o.seed_idx = s.seed_idx AND (o.label_mask & s.label_mask) = 0))::BIGINT)::BIGINT AS skipped_rows FROM split s GROUP BY ALL)
    SELECT 'documents_flags' AS dataset, sample_size, seed_idx, round(avg(f1), 9) AS macro_f1,
           round(CASE WHEN sum(sup + prd) > 0 THEN 2.0 * sum(tp) / sum(sup + prd) ELSE 0 END, 9) AS micro_f1,
           round(CASE WHEN sum(sup) > 0 THEN sum(f1 * sup) / sum(sup) ELSE 0 END, 9) AS weighted_f1,
           'accuracy' AS metric, round(any_value(ex.acc), 9) AS metric_value,
           max(CASE WHEN l = 0 THEN round(f1, 9) END) AS f1_0, max(CASE WHEN l = 1 THEN round(f1, 9) END) AS f1_1,
           any_value(sk.skipped_rows) AS skipped_rows
    FROM f JOIN ex USING (sample_size, seed_idx) JOIN sk USING (sample_size, seed_idx) GROUP BY sample_size, seed_idx
    """


@register("run_fewshot_multilabel_plain", _multilabel_run_sql([2, 4, 8, 16], SEEDS[:5]))
def q_run_fewshot_multilabel_plain(spark, sf):
    """The whole multi-label run with class-mean heads per label and no adapter: the stored metric
    is the subset accuracy; rows without a disjoint partner are counted."""
    parts = M.fraction_split(R.documents_multilabel(spark, sf), 0.75, 42)
    spec = C.spec("documents_flags")
    ds = RN.LabelledSet("documents_flags", parts.where(F.col("split") == "train").drop("split"),
                        parts.where(F.col("split") == "test").drop("split"), list(spec.labels), spec.template, "accuracy",
                        ["quality", "toxic"])
    cfg = _plain("multilabel", sample_sizes=(2, 4, 8, 16), seeds_num=5, setting_name="multilabel")
    return _flat(RN.run_fewshot_multilabel(spark, cfg, [ds], write=False), list(spec.labels), "skipped_rows")


_RELABEL_SETS = [(QUALITY.template, list(QUALITY.labels)), (TOXIC.template, list(TOXIC.labels))]


@register(
    "run_relabel_plain",
    f"""
    WITH base AS (SELECT * FROM {DL_SQL}),
    split AS {grid_select('base', 'label', [8], [0], 'b.row_id, b.label')},
    {_encode_sql('base', 'row_id', 'text').strip()},
    sz AS (SELECT label, count(*) AS n FROM split GROUP BY ALL),
    cent AS (SELECT s.label, e.b, sum(e.value) / any_value(sz.n) AS c FROM split s JOIN enc e ON e.id = s.row_id JOIN sz USING (label) GROUP BY ALL),
    dots AS (SELECT e.id, c.label, sum(e.value * c.c) AS s FROM enc e JOIN cent c USING (b) GROUP BY ALL),
    r AS (SELECT b.row_id, sz.label AS p, row_number() OVER (PARTITION BY b.row_id ORDER BY round(coalesce(d.s, 0), 9) DESC, sz.label) AS rk
          FROM base b CROSS JOIN sz LEFT JOIN dots d ON d.id = b.row_id AND d.label = sz.label)
    SELECT row_id, p AS pred_0, CASE p WHEN 0 THEN '{QUALITY.labels[0]}' ELSE '{QUALITY.labels[1]}' END AS name_0,
           p AS pred_1, CASE p WHEN 0 THEN '{TOXIC.labels[0]}' ELSE '{TOXIC.labels[1]}' END AS name_1
    FROM r WHERE rk = 1
    """,
)
def q_run_relabel_plain(spark, sf):
    """Two anchor sets over the same training rows, class-mean heads and no adapter."""
    rows = dl(spark, sf)
    return RN.run_relabel_demo(spark, _plain("single"), M.fewshot_sample(rows, 8, 0), rows.select("row_id", "text"), _RELABEL_SETS)


@register("run_relabel_demo")
def q_run_relabel_demo(spark, sf):
    """Same 16 training rows, two anchor sets (text quality vs. tone): both predictions for every
    labelled document side by side."""
    rows = dl(spark, sf)
    train = M.fewshot_sample(rows, 8, 0)
    cfg = RunConfig(loss="TripletLoss", num_iterations=20)
    return RN.run_relabel_demo(spark, cfg, train, rows.select("row_id", "text"),
                               _RELABEL_SETS)
