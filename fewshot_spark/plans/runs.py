"""End-to-end runs: load -> few-shot grid -> resume filter -> anchors + examples -> encode ->
per-split adapter and head -> predict the test table -> metrics -> result table.

One lazy plan per dataset; the only driver round-trips are bounded: the pending split keys
(sizes x seeds), the per-split weights (chunk by chunk) and the row counts of size checks.
Every draw is a seeded hash and every fit is deterministic, so a task recomputed after a lost
executor produces the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, run_id, settings_key
from ..operators import encode as E
from ..operators import examples as X
from ..operators import heads as HD
from ..operators import metrics as V
from ..operators import sampling as M
from . import grid as G
from . import results as RS


@dataclass
class LabelledSet:
    """A dataset to run: train and test tables ``(row_id, text, label)`` (single-label) or
    ``(row_id, text, <flags>, label_mask)`` (multi-label), with its names, template and metric."""

    name: str
    train: DataFrame
    test: DataFrame
    names: list[str]
    template: str
    metric: str = "accuracy"
    label_cols: list[str] | None = None


def _encode(df: DataFrame, cfg: RunConfig, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Hashed encoding; its vectors are already unit length (or zero), so the optional
    normalisation layer leaves them unchanged and the fused test scoring needs no extra step."""
    if cfg.encoder is not None:
        enc = cfg.encoder(df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")))
        enc = enc.select(F.col("row_id").alias(id_col), F.col("embedding").cast("array<double>").alias("embedding"))
    else:
        enc = E.encode_hash(df.select(id_col, text_col), id_col, text_col, dim=cfg.encoder_dim)
    if cfg.add_normalization_layer:
        enc = enc.withColumn("embedding", E.l2_normalize("embedding"))
    return enc


def _keep(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Reuse a bounded intermediate: ``persist()``, or a reliable ``checkpoint()`` into the
    cluster's checkpoint folder when the run asks for cut lineage."""
    return df.checkpoint(eager=False) if cfg.checkpoint_intermediates else df.persist()


def _anchor_vectors(spark: SparkSession, anchors, cfg: RunConfig) -> DataFrame:
    """Anchor sentences (a dict, or a table ``(anchor_key, text)``) as ``(anchor_key, embedding)``,
    encoded in Spark like any other text; each split is joined to those it uses."""
    if isinstance(anchors, dict):
        anchors = spark.createDataFrame([(int(k), t) for k, t in anchors.items()], "anchor_key long, text string")
    return _encode(anchors, cfg, "anchor_key")


def _texts(ds: LabelledSet, cfg: RunConfig) -> LabelledSet:
    """The set with whole texts, or with the first ``max_seq_length`` tokens where a run asks so."""
    if cfg.max_seq_length is None:
        return ds
    cut = F.array_join(E.truncate_tokens(E.tokens("text"), cfg.max_seq_length), " ")
    return replace(ds, train=ds.train.withColumn("text", cut), test=ds.test.withColumn("text", cut))


def _save_embeddings(spark: SparkSession, ds: LabelledSet, anchors, cfg: RunConfig, write: bool) -> None:
    """Embeddings of the test texts and of the anchors, once per dataset, where a run asks so."""
    if cfg.save_embeddings and cfg.results_dir and write:
        name = f"{run_id(cfg)}/{ds.name}"
        RS.write_embeddings(_encode(ds.test, cfg), cfg.results_dir, f"{name}/test")
        RS.write_embeddings(_anchor_vectors(spark, anchors, cfg), cfg.results_dir, f"{name}/anchors")


def _pending_sizes(spark: SparkSession, ds: LabelledSet, cfg: RunConfig, done: DataFrame | None) -> DataFrame:
    """Split keys still to run, from sizes x seeds (no row is sampled to learn them)."""
    wanted = spark.createDataFrame([(ds.name, s, i) for s in cfg.sample_sizes for i in range(len(cfg.seeds))],
                                   "dataset string, sample_size int, seed_idx int")
    return G.pending_splits(wanted, done, RS.SPLIT_KEYS, cfg.override_results)


def pending_splits(spark: SparkSession, cfg: RunConfig, ds: LabelledSet) -> DataFrame:
    """Keys of a set's splits that have no stored record of this run and these settings."""
    return _pending_sizes(spark, ds, cfg, RS.finished_splits(spark, cfg))


def _chunks(ds: LabelledSet, cfg: RunConfig, done: DataFrame | None) -> list[list]:
    """Keys of the pending splits, in pieces whose records are committed together."""
    pending = sorted(tuple(r) for r in _pending_sizes(ds.train.sparkSession, ds, cfg, done).collect())
    return [pending[i : i + cfg.splits_per_commit] for i in range(0, len(pending), cfg.splits_per_commit)]


def _grid_single(ds: LabelledSet, cfg: RunConfig, pending: list) -> DataFrame:
    """Rows of the pending splits."""
    grid = M.fewshot_grid(ds.train.select("row_id", "text", "label"), sorted({k[1] for k in pending}), cfg.seeds)
    grid = _only(grid.withColumn("dataset", F.lit(ds.name)), pending)
    return _keep(G.bounded_rows(grid, RS.SPLIT_KEYS, cfg.max_fit_rows, cfg.draw_seed).select(*RS.SPLIT_KEYS, "row_id", "label"), cfg)


def _router(cfg: RunConfig, most_rows: int | None) -> dict:
    """How ``train_splits`` treats large splits; a grid whose splits cannot be large is not counted."""
    fits = most_rows is not None and most_rows <= cfg.stream_rows
    return {"stream_rows": None if fits else cfg.stream_rows, "max_steps": cfg.max_large_steps, "optimizer": cfg.optimizer}


def _only(grid: DataFrame, pending: list) -> DataFrame:
    """Rows of the pending splits (at most sizes x seeds keys)."""
    keys = grid.sparkSession.createDataFrame([tuple(r) for r in pending], "dataset string, sample_size int, seed_idx int")
    return grid.join(F.broadcast(keys), RS.SPLIT_KEYS, "left_semi")


def _encode_grid_rows(grid: DataFrame, train: DataFrame, cfg: RunConfig) -> DataFrame:
    """Encode each sampled row once (not once per split) and attach its vector to every split."""
    ids = grid.select("row_id").distinct()
    small = ids.count() <= M.MAX_BROADCAST_IDS  # 8 bytes an id; beyond the bound a plain semi join
    texts = train.select("row_id", "text").join(F.broadcast(ids) if small else ids, "row_id", "left_semi")
    return _encode(texts, cfg)


def run_fewshot(spark: SparkSession, cfg: RunConfig, datasets: list[LabelledSet], anchor_names: dict | None = None,
                write: bool = True) -> DataFrame:
    """Single-label run (also the ablation run, whose anchors come through ``anchor_names``:
    dataset -> (template, shown names)). Returns the result records of the splits it ran; they
    are stored piece by piece (``splits_per_commit``), so a run that ends early keeps what it had."""
    done = RS.finished_splits(spark, cfg)
    if cfg.results_dir and write:
        RS.write_manifest(spark, cfg, cfg.results_dir)
    out = None
    for ds in datasets:
        ds = _texts(ds, cfg)
        template, shown = (anchor_names or {}).get(ds.name, (ds.template, ds.names))
        anchors = X.generate_anchors(template, list(shown))
        _save_embeddings(spark, ds, anchors, cfg, write)
        for pending in _chunks(ds, cfg, done):
            rec, cached = _single_records(spark, cfg, ds, anchors, pending)
            if anchor_names:  # per-class F1 stays keyed by the real names; those that the anchors showed stand beside it
                rec = rec.withColumn("shown_names", F.map_from_arrays(
                    F.array(*[F.lit(i) for i in range(len(shown))]), F.array(*[F.lit(n) for n in shown])))
            rec = _finished(spark, rec, cfg, write, cached)
            out = rec if out is None else out.unionByName(rec)
    return RS.as_records(spark.createDataFrame([], RS.RECORD_SCHEMA)) if out is None else out


def _single_records(spark: SparkSession, cfg: RunConfig, ds: LabelledSet, anchors: dict, pending: list) -> tuple[DataFrame, list[DataFrame]]:
    """Records of some splits of a set, and what they keep cached."""
    keys = RS.SPLIT_KEYS
    grid = _grid_single(ds, cfg, pending)
    enc = _encode_grid_rows(grid, ds.train, cfg)
    rows = grid.select(*keys, "row_id", "label").join(enc, "row_id")
    if cfg.triplet:
        trip = X.gen_triplets(grid.select(*keys, "row_id", "label"), anchors, cfg.num_iterations,
                              cfg.draw_seed, keys, text_col=None)
        ex = trip.select(*keys, "iteration", "row_id", F.col("label").alias("anchor_key"),
                         F.col("neg_row_id").alias("other_row_id"))
        ex = G.with_batch_key(ex, keys, cfg.draw_seed, ["iteration", "row_id"])
        anchor_vecs = _anchor_vectors(spark, anchors, cfg)
        loss = "triplet"
    else:
        pairs = X.gen_pairs(grid.select(*keys, "row_id", "label"), cfg.num_iterations, cfg.draw_seed, keys,
                            text_col=None)
        ex = G.with_batch_key(pairs.select(*keys, "iteration", "row_id", "other_row_id", "target"), keys,
                              cfg.draw_seed, ["iteration", "row_id", "target"])
        anchor_vecs = None
        loss = "cosine"
    # kept so that the size checks and the fit read the same rows instead of making the examples anew
    rows, ex = _keep(rows, cfg), _keep(ex, cfg)
    weights = G.train_splits(rows, ex, keys, anchor_vecs, loss, cfg.classifier, cfg.adapter_lr, cfg.margin,
                             use_adapter=cfg.use_adapter, batch_size=cfg.batch_size,
                             **_router(cfg, max(k[1] for k in pending) * len(ds.names)))
    weights = weights.persist()
    if cfg.encoder is None:  # encode inside the scoring pass
        conf = HD.predict(ds.test.select("row_id", "text", "label"), weights, keys, aggregate=True,
                          encode=("text", cfg.encoder_dim))
    else:
        test = _encode(ds.test, cfg).join(ds.test.select("row_id", "label"), "row_id")
        conf = HD.predict(test, weights, keys, aggregate=True)
    summary = V.summary(conf, keys, n_col="n")
    per_class = V.f1_per_class(conf, keys, n_col="n")
    return V.result_record(summary, per_class, keys, ds.metric, list(ds.names)), [rows, ex, weights, grid]


def _finished(spark: SparkSession, rec: DataFrame, cfg: RunConfig, write: bool, cached: list[DataFrame]) -> DataFrame:
    """Compute the records of one piece (one row per split), store them, free the caches, and return
    the records as a plain table."""
    rec = rec.withColumn("run_id", F.lit(run_id(cfg))).withColumn("settings", F.lit(settings_key(cfg)))
    rows = rec.collect()
    rec = spark.createDataFrame(rows, rec.schema)
    if cfg.results_dir and write and rows:
        RS.write_results(rec, cfg.results_dir)
    for df in cached:
        df.unpersist()
    return rec


def run_fewshot_multilabel(spark: SparkSession, cfg: RunConfig, datasets: list[LabelledSet], write: bool = True) -> DataFrame:
    """Multi-label run: label-wise sampling with de-duplication, anchors naming every set label,
    disjoint-label negatives, one binary head per label (one-vs-rest / multi-output / chain)."""
    if cfg.kind != "multilabel":
        raise ValueError("a multi-label run needs kind='multilabel'")
    done = RS.finished_splits(spark, cfg)
    if cfg.results_dir and write:
        RS.write_manifest(spark, cfg, cfg.results_dir)
    out = None
    for ds in datasets:
        ds = _texts(ds, cfg)
        for at, pending in enumerate(_chunks(ds, cfg, done)):
            rec, cached = _multilabel_records(spark, cfg, ds, pending, write and at == 0)
            rec = _finished(spark, rec, cfg, write, cached)
            out = rec if out is None else out.unionByName(rec)
    return RS.as_records(spark.createDataFrame([], RS.RECORD_SCHEMA)) if out is None else out


def _multilabel_records(spark: SparkSession, cfg: RunConfig, ds: LabelledSet, pending: list, write: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Records of some splits of a multi-label set, and what they keep cached."""
    keys = RS.SPLIT_KEYS
    lc = list(ds.label_cols or [])
    sizes = sorted({k[1] for k in pending})
    grid = _only(M.fewshot_grid_multilabel(ds.train, lc, sizes, cfg.seeds).withColumn("dataset", F.lit(ds.name)), pending)
    grid = _keep(G.bounded_rows(grid, keys, cfg.max_fit_rows, cfg.draw_seed).drop("text"), cfg)
    enc = _encode_grid_rows(grid, ds.train, cfg)
    rows = grid.select(*keys, "row_id", *lc, "label_mask").join(enc, "row_id")
    if cfg.triplet:
        from ..operators.prepare import multilabel_anchor

        trip = X.gen_triplets_multilabel(grid, ds.template, lc, list(ds.names), cfg.num_iterations, cfg.draw_seed,
                                         keys, text_col=None, on_empty=cfg.on_empty)
        ex = trip.select(*keys, "iteration", "row_id", F.col("label_mask").alias("anchor_key"),
                         F.col("neg_row_id").alias("other_row_id"))
        ex = G.with_batch_key(ex, keys, cfg.draw_seed, ["iteration", "row_id"])
        masks = grid.where(F.col("label_mask") != 0).select(
            "label_mask", multilabel_anchor(ds.template, lc, list(ds.names)).alias("anchor")).distinct()
        anchors = masks.select(F.col("label_mask").alias("anchor_key"), F.col("anchor").alias("text"))
        anchor_vecs = _anchor_vectors(spark, anchors, cfg)
        _save_embeddings(spark, ds, anchors, cfg, write)
        loss = "triplet"
    else:
        pairs = X.gen_pairs_multilabel(grid.select(*keys, "row_id", *lc, "label_mask"), lc, cfg.num_iterations,
                                       cfg.draw_seed, keys, text_col=None)
        ex = G.with_batch_key(pairs.select(*keys, "iteration", "row_id", "label_id", "other_row_id", "target"), keys,
                              cfg.draw_seed, ["iteration", "row_id", "label_id"])
        anchor_vecs = None
        loss = "cosine"
    rows, ex = _keep(rows, cfg), _keep(ex, cfg)
    weights = G.train_splits_multilabel(rows, ex, keys, lc, anchor_vecs, loss, cfg.multi_target_strategy,
                                        cfg.adapter_lr, cfg.margin, cfg.use_adapter,
                                        batch_size=cfg.batch_size, head=cfg.classifier,
                                        **_router(cfg, max(sizes) * len(lc))).persist()
    if cfg.encoder is None:
        conf = G.predict_multilabel(ds.test.select("row_id", "text", "label_mask"), weights, keys,
                                    encode=("text", cfg.encoder_dim))
    else:
        test = _encode(ds.test, cfg).join(ds.test.select("row_id", "label_mask"), "row_id")
        conf = G.predict_multilabel(test, weights, keys)
    summary = V.multilabel_summary(conf, keys, len(lc), n_col="n")
    per_label = V.multilabel_f1_per_label(conf, keys, len(lc), n_col="n")
    # labelled rows of a split with no disjoint-label partner (skipped as triplet anchors)
    blocks = X.disjoint_blocks(grid.select(*keys, "label_mask"), keys).select(*keys, F.col("a_mask").alias("label_mask"))
    skipped = (grid.where(F.col("label_mask") != 0).select(*keys, "label_mask")
               .join(blocks, [*keys, "label_mask"], "left_anti")
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("skipped_rows")))
    rec = (V.result_record(summary, per_label, keys, "accuracy", list(ds.names))
           .join(skipped, keys, "left").withColumn("skipped_rows", F.coalesce("skipped_rows", F.lit(0)).cast("bigint")))
    return rec, [rows, ex, weights, grid]


def run_ablation(spark: SparkSession, cfg: RunConfig, datasets: list[LabelledSet], catalogue: DataFrame,
                 catalogue_dataset: dict[str, str] | None = None, write: bool = True) -> DataFrame:
    """Single-label run whose anchors use the label-name variant ``cfg.setting_name`` (chosen once
    per dataset, shared by all splits). Result keys keep the real class names."""
    from ..operators.variants import anchors_variant

    if cfg.kind != "ablation":
        raise ValueError("an ablation run needs kind='ablation'")
    names = {}
    for ds in datasets:
        src = (catalogue_dataset or {}).get(ds.name, ds.name)
        rows = anchors_variant(catalogue, cfg.setting_name, cfg.draw_seed, [src]).orderBy("label_id").collect()
        if not rows:
            raise KeyError(f"variant {cfg.setting_name!r} has no tables for {src!r}")
        names[ds.name] = (rows[0]["template"], [r["shown_name"] for r in rows])
    return run_fewshot(spark, cfg, datasets, anchor_names=names, write=write)


def run_relabel_demo(spark: SparkSession, cfg: RunConfig, train: DataFrame, rows: DataFrame,
                     anchor_sets: list[tuple[str, list[str]]]) -> DataFrame:
    """Same training rows, several anchor sets: one adapter + head per set, predictions side by
    side ``(row_id, pred_0, name_0, pred_1, name_1, ...)``. The train table is one split: a task
    streams it up to ``cfg.stream_rows`` rows, a larger one is trained by distributed steps."""
    keys = ["anchor_set"]
    train = G.bounded_rows(train.withColumn("anchor_set", F.lit(0)), keys, cfg.max_fit_rows, cfg.draw_seed).drop("anchor_set")
    enc_train = _encode(train, cfg).join(train.select("row_id", "label"), "row_id")
    base = train.select("row_id", "text", "label")
    weights_all = None
    for i, (template, names) in enumerate(anchor_sets):
        anchors = X.generate_anchors(template, list(names))
        split = base.withColumn("anchor_set", F.lit(i))
        trip = X.gen_triplets(split, anchors, cfg.num_iterations, cfg.draw_seed, keys, text_col=None)
        ex = G.with_batch_key(trip.select(*keys, "iteration", "row_id", F.col("label").alias("anchor_key"),
                                          F.col("neg_row_id").alias("other_row_id")),
                              keys, cfg.draw_seed, ["iteration", "row_id"])
        w = G.train_splits(enc_train.withColumn("anchor_set", F.lit(i)), ex, keys, _anchor_vectors(spark, anchors, cfg),
                           "triplet", cfg.classifier, cfg.adapter_lr, cfg.margin, cfg.use_adapter, batch_size=cfg.batch_size,
                           **_router(cfg, None))
        weights_all = w if weights_all is None else weights_all.unionByName(w)
    enc_rows = _encode(rows, cfg)
    pred = HD.predict(enc_rows, weights_all, keys, label_col=None)
    wide = pred.groupBy("row_id").pivot("anchor_set", list(range(len(anchor_sets)))).agg(F.first("y_pred"))
    cols = ["row_id"]
    for i, (_, names) in enumerate(anchor_sets):
        m = F.create_map(*[x for j, n in enumerate(names) for x in (F.lit(j), F.lit(n))])
        wide = wide.withColumnRenamed(str(i), f"pred_{i}").withColumn(f"name_{i}", F.try_element_at(m, F.col(f"pred_{i}")))
        cols += [f"pred_{i}", f"name_{i}"]
    return wide.select(*cols)
