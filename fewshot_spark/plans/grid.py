"""Split-parallel training over the few-shot grid, and the resume filter.

Every (dataset, sample size, seed) split is independent, so all splits train in parallel. Rows,
anchor vectors and examples are one tagged table, partitioned by split and sorted by kind and
batch order, which each task reads as a stream (``mapInPandas``): it holds one split's rows and
anchors (rows bounded by ``max_fit_rows``), takes the adapter's mini-batch steps while the
examples pass (warm-up and linear decay, W reset to the identity for every split), fits the head
on the adapted embeddings and returns the head folded through the adapter: one linear map per
split. There is no bound on the number of examples.
A split of more rows than a task should hold (``stream_rows``) is trained by distributed steps and
fits instead (``operators.adapter``, ``operators.large``): no task holds its rows, and with the same
batches both ways give the same maps.
Prediction then scores the test table against all splits' maps in Arrow batches and returns
only confusion counts, so nothing grows with splits x test rows.
"""

from __future__ import annotations

from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import adapter as AD
from ..operators import large as LG
from ..operators.adapter import grad_cosine, grad_triplet
from ..operators.heads import chosen, fit_binary_np, fit_head_np, scored_rows, weight_chunks


def pending_splits(wanted: DataFrame, done: DataFrame | None, keys: list[str], override: bool = False) -> DataFrame:
    """Splits still to run: ``wanted`` minus the keys already in ``done`` (left-anti join), or all
    of ``wanted`` when ``override``."""
    if override or done is None:
        return wanted
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def bounded_rows(df: DataFrame, keys: list[str], limit: int | None, seed: int, id_col: str = "row_id") -> DataFrame:
    """At most ``limit`` rows per split, those with the smallest seeded hash of their id (a
    documented bound on what one head is fitted on; ``None``: all rows).

    A split over the bound is cut by radix selection of its ``limit``-th hash (``kth_smallest``),
    split by split; no split is sorted in one task, and splits within the bound are left alone."""
    if limit is None:
        return df
    from ..functions.hashing import h60
    from ..functions.ranking import kth_smallest, upto_pair

    over = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).collect()
    if not over:
        return df
    h = h60(F.lit(int(seed)), F.lit("fit"), F.col(id_col))
    fits = F.lit(True)
    for r in over:
        mine = _is_split(r, keys)
        hk, ik, _ = kth_smallest(df.where(mine).select(h.alias("h"), F.col(id_col).alias("row_id")), limit, "h", "row_id", r["_n"])
        fits = fits & (~mine | upto_pair("_h", id_col, hk, ik))
    return df.withColumn("_h", h).where(fits).drop("_h")


def _is_split(row, keys: list[str]):
    """Condition that a row belongs to the split of ``row``."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).eqNullSafe(F.lit(row[k]))
    return found


def _stream(both: DataFrame, keys: list[str], order: list[str], fit, schema) -> DataFrame:
    """Run ``fit`` once per split over a sorted stream.

    Splits are hash-partitioned (over at least as many partitions as there are cores, and not
    merged by AQE: the fits are CPU-bound) and sorted by kind (rows, anchors, examples), then by
    batch order. A task holds the rows and anchors of one split (bounded by ``max_fit_rows``) and
    one Arrow batch of its examples, however many examples there are.
    """
    n = max(both.sparkSession.sparkContext.defaultParallelism, 1)
    sorted_ = both.repartition(n, *keys).sortWithinPartitions(*keys, "_kind", *order, "row_id")

    def chunks(batches):
        """``(split key, frame)`` pieces in order; a split may come in several."""
        for pdf in batches:
            if len(pdf):
                code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
                cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
                for s, e in zip(cut[:-1], cut[1:]):
                    part = pdf.iloc[s:e]
                    yield tuple(part[k].iloc[0] for k in keys), part

    def run(batches):
        for key, parts in groupby(chunks(batches), key=lambda x: x[0]):
            out = fit(key, (p for _, p in parts))
            if out is not None:
                yield out

    return sorted_.mapInPandas(run, schema)


def _rows_then_examples(parts):
    """Rows and anchor vectors of a split (held), and an iterator over its example frames."""
    held, rest = [], None
    for p in parts:
        ex = p[p["_kind"] == 2]
        held.append(p[p["_kind"] < 2])
        if len(ex):
            rest = ex
            break
    head = pd.concat(held)
    examples = chain([] if rest is None else [rest], parts)
    return head[head["_kind"] == 0], head[head["_kind"] == 1], examples


def with_batch_key(ex: DataFrame, keys: list[str], seed: int, key_cols: list[str]) -> DataFrame:
    """Add ``batch_key`` = the shuffle hash of ``assign_batches`` (a projection, no window): the
    split task orders its examples by (batch_key, iteration, row_id) and cuts batches of
    ``batch_size``, which gives exactly the batches ``assign_batches`` numbers."""
    from ..functions.hashing import h60

    return ex.withColumn("batch_key", h60(F.lit(int(seed)), *[F.col(k) for k in keys], F.lit("batch"),
                                              *[F.col(c) for c in key_cols]))


def _order_cols(examples: DataFrame) -> list[str]:
    return ["batch_id"] if "batch_id" in examples.columns else ["batch_key", "iteration"]


def _adapt(X: np.ndarray, row_index: pd.Index, examples, anchors: dict, loss: str, lr: float, margin: float, steps: int,
           batch_size: int, by_id: bool, optimizer: str = "sgd") -> np.ndarray:
    """Mini-batch adapter steps over the ordered example frames of one split, with warm-up and
    linear decay over ``steps``; a batch that a frame cuts is completed from the next one."""
    run = AD.Steps(X.shape[1], steps, lr, optimizer)
    if loss == "triplet":
        akeys = pd.Index(list(anchors))
        A_all = np.vstack(list(anchors.values())) if anchors else np.zeros((0, X.shape[1]))
    held = None

    def indexed(ex):
        """Row, partner, anchor (or target) positions of a frame's examples, and their batch ids."""
        ip = row_index.get_indexer(ex["row_id"].to_numpy())
        io = row_index.get_indexer(ex["other_row_id"].to_numpy())
        if (ip < 0).any() or (io < 0).any():
            raise ValueError("an example refers to a row that is not in its split")
        if loss == "triplet":
            x = akeys.get_indexer(ex["anchor_key"].to_numpy().astype(np.int64))
            if (x < 0).any():
                raise KeyError("an example's anchor key has no anchor vector")
        else:
            x = ex["target"].to_numpy().astype(np.float64)
        return [ip, io, x, ex["batch_id"].to_numpy() if by_id else ip]

    def apply(ip, io, x):
        if loss == "triplet":
            _, G = grad_triplet(run.W, A_all[x], X[ip], X[io], margin)
        else:
            _, G = grad_cosine(run.W, X[ip], X[io], x)
        run.take(G / len(ip))

    for ex in examples:
        cols = indexed(ex)
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        b = cols[3]
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if by_id else np.arange(0, len(b), batch_size)
        for a, z in zip(starts[:-1], starts[1:]):
            apply(*(c[a:z] for c in cols[:3]))
        held = [c[starts[-1]:] for c in cols]
    if held is not None:
        apply(*held[:3])
    return run.W


def _prepared(rows, examples, keys, row_cols, anchors: DataFrame | None, loss: str, vec_col: str, batch_size: int):
    """Rows (kind 0), used anchor vectors (1) and examples (2) of every split in one table, with
    the split's number of adapter steps on its rows; also the order columns of the examples."""
    order = _order_cols(examples)
    by_id = order == ["batch_id"]
    count = F.count_distinct("batch_id") if by_id else F.ceil(F.count(F.lit(1)) / batch_size)
    rows = rows.select(*keys, *row_cols).join(examples.groupBy(*keys).agg(count.cast("int").alias("_steps")), keys, "left")
    rows = rows.withColumn("_steps", F.coalesce("_steps", F.lit(0)))
    ex_cols = [*order, "row_id", "other_row_id", "anchor_key" if loss == "triplet" else "target"]
    parts = [rows.withColumn("_kind", F.lit(0)), examples.select(*keys, *ex_cols).withColumn("_kind", F.lit(2))]
    if loss == "triplet":
        used = examples.select(*keys, "anchor_key").distinct()
        vec = anchors.select(F.col("anchor_key").cast(examples.schema["anchor_key"].dataType).alias("anchor_key"), vec_col)
        parts.append(used.join(vec, "anchor_key").select(*keys, F.col("anchor_key").cast("long").alias("row_id"), vec_col).withColumn("_kind", F.lit(1)))
    types = {f.name: f.dataType for p in parts for f in p.schema.fields}
    # integer columns of another kind are -1 (not null), so ids keep their exact int64 values in pandas
    fill = {c: F.lit(None).cast(t) if isinstance(t, T.ArrayType) else F.lit(-1).cast(t) for c, t in types.items()}
    whole = None
    for p in parts:
        p = p.select(*[p[c] if c in p.columns else fill[c].alias(c) for c in types])
        whole = p if whole is None else whole.unionByName(p)
    return whole, order, by_id


def _anchor_table(spark, anchors, vec_col: str) -> DataFrame | None:
    """Anchor vectors ``(anchor_key, vector)``; a dict (anchor key -> vector) becomes a table."""
    if anchors is None or isinstance(anchors, DataFrame):
        return anchors
    rows = [(int(k), [float(x) for x in v]) for k, v in anchors.items()]
    return spark.createDataFrame(rows, f"anchor_key long, {vec_col} array<double>")


def _routed(rows: DataFrame, examples: DataFrame, keys: list[str], stream_rows: int | None):
    """``(rows, examples)`` of the splits that a task streams, and the keys of the larger ones."""
    if stream_rows is None:
        return rows, examples, []
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stream_rows).select(*keys).collect()
    for r in large:
        rows, examples = (x.where(~_is_split(r, keys)) for x in (rows, examples))
    return rows, examples, large


def _large_rows(rows: DataFrame, examples: DataFrame, keys: list[str], split, anchors: DataFrame | None, loss: str, lr: float,
                margin: float, use_adapter: bool, vec_col: str, batch_size: int, max_steps: int, optimizer: str) -> tuple[DataFrame, np.ndarray | None]:
    """Adapted rows of one large split, and its adapter.

    Examples get their vectors by joins and go to mini-batches: those of ``batch_id`` where they
    have it, else ranges of ``batch_key``, at most ``max_steps`` of them (so a batch grows with the
    split: every step is a job)."""
    mine = _is_split(split, keys)
    rows, examples = rows.where(mine), examples.where(mine)
    if not use_adapter:
        return rows, None
    if "batch_id" in examples.columns:
        steps = examples.agg(F.max("batch_id")).first()[0]
        steps, batch = 0 if steps is None else int(steps) + 1, F.col("batch_id")
    else:
        from ..functions.hashing import HASH_BITS

        steps = min(max_steps, -(-examples.count() // batch_size))
        batch = F.floor(F.col("batch_key") / F.lit(float(1 << HASH_BITS)) * steps)
    if not steps:
        return rows, None
    vectors = rows.select("row_id", vec_col)
    other = vectors.select(F.col("row_id").alias("other_row_id"), F.col(vec_col).alias("n" if loss == "triplet" else "v"))
    ex = examples.withColumn("batch_id", batch.cast("int")).join(vectors.withColumnRenamed(vec_col, "p" if loss == "triplet" else "u"), "row_id").join(other, "other_row_id")
    if loss == "triplet":
        vec = anchors.select(F.col("anchor_key").cast(examples.schema["anchor_key"].dataType).alias("anchor_key"), F.col(vec_col).alias("a"))
        ex = ex.join(vec, "anchor_key")
    W, _ = AD.fit_adapter(ex, loss, steps, lr, margin, optimizer=optimizer)
    return AD.apply_adapter(rows, W, vec_col), W


def train_splits(
    rows: DataFrame,
    examples: DataFrame,
    keys: list[str],
    anchor_vectors: dict | DataFrame | None,
    loss: str = "triplet",
    head: str = "logistic_regression",
    lr: float = 0.5,
    margin: float = 0.25,
    use_adapter: bool = True,
    label_col: str = "label",
    vec_col: str = "embedding",
    batch_size: int = 16,
    stream_rows: int | None = None,
    max_steps: int = 200,
    optimizer: str = "sgd",
) -> DataFrame:
    """Single-label: ``(keys, label, weights, bias)`` per split, adapter folded in.

    ``rows``: keys, row_id, label, embedding. ``examples``: keys, row_id, other_row_id, anchor_key
    (the label, triplets) or target (pairs), and either ``batch_id`` (``assign_batches``) or
    ``batch_key`` + ``iteration`` (``with_batch_key``). ``anchor_vectors``: a table
    ``(anchor_key, <vec_col>)`` or a dict; each split gets those its examples use. A split of more
    than ``stream_rows`` rows is trained by distributed steps (at most ``max_steps`` of them, where
    the examples have no ``batch_id``) and a distributed fit; the others each stream through a task.
    """
    key_fields = [rows.schema[k] for k in keys]
    schema = T.StructType(key_fields + [
        T.StructField("label", rows.schema[label_col].dataType),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("bias", T.DoubleType()),
    ])
    anchors = _anchor_table(rows.sparkSession, anchor_vectors, vec_col)
    all_rows, all_examples = rows, examples
    rows, examples, large = _routed(rows, examples, keys, stream_rows)
    both, order, by_id = _prepared(rows, examples, keys, ["row_id", label_col, vec_col], anchors, loss, vec_col, batch_size)

    def fit(key, parts):
        r, a, ex = _rows_then_examples(parts)
        if len(r) == 0:
            return None
        X = np.vstack(r[vec_col].to_numpy()).astype(np.float64)
        W = np.eye(X.shape[1])
        if use_adapter:
            vecs = {int(k): np.asarray(v, dtype=np.float64) for k, v in zip(a["row_id"], a[vec_col])}
            W = _adapt(X, pd.Index(r["row_id"].to_numpy()), ex, vecs, loss, lr, margin, int(r["_steps"].iloc[0]), batch_size, by_id, optimizer)
        y = r[label_col].to_numpy().astype(np.int64)
        classes = np.unique(y)
        Hh, b = fit_head_np(head, X @ W.T, y, classes)
        out = {k: [v] * len(classes) for k, v in zip(keys, key)}
        out["label"] = classes
        out["weights"] = list(Hh @ W)
        out["bias"] = b
        return pd.DataFrame(out)

    out = _stream(both, keys, order, fit, schema)
    for split in large:
        adapted, W = _large_rows(all_rows, all_examples, keys, split, anchors, loss, lr, margin, use_adapter, vec_col, batch_size, max_steps, optimizer)
        classes, H, b = LG.fit_head(head, adapted, label_col, vec_col)
        H = H if W is None else H @ W
        got = [(*split, c.item(), w.tolist(), float(x)) for c, w, x in zip(classes, H, b, strict=True)]
        out = out.unionByName(rows.sparkSession.createDataFrame(got, schema))
    return out


def train_splits_multilabel(
    rows: DataFrame,
    examples: DataFrame,
    keys: list[str],
    label_cols: list[str],
    anchor_vectors: dict | DataFrame | None,
    loss: str = "triplet",
    strategy: str = "one-vs-rest",
    lr: float = 0.5,
    margin: float = 0.25,
    use_adapter: bool = True,
    vec_col: str = "embedding",
    batch_size: int = 16,
    head: str = "logistic_regression",
    stream_rows: int | None = None,
    max_steps: int = 200,
    optimizer: str = "sgd",
) -> DataFrame:
    """Multi-label: per split and label ``(keys, label, weights, chain ARRAY<DOUBLE>, bias,
    constant INT)``. ``chain`` holds the weights of the earlier labels (classifier chain only);
    ``constant`` is set when a label column is constant in the split (one-vs-rest predicts it,
    multi-output raises). Splits of more than ``stream_rows`` rows as in ``train_splits``."""
    key_fields = [rows.schema[k] for k in keys]
    schema = T.StructType(key_fields + [
        T.StructField("label", T.IntegerType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("chain", T.ArrayType(T.DoubleType())),
        T.StructField("bias", T.DoubleType()),
        T.StructField("constant", T.IntegerType()),
    ])
    anchors = _anchor_table(rows.sparkSession, anchor_vectors, vec_col)
    all_rows, all_examples = rows, examples
    rows, examples, large = _routed(rows, examples, keys, stream_rows)
    both, order, by_id = _prepared(rows, examples, keys, ["row_id", *label_cols, vec_col], anchors, loss, vec_col, batch_size)

    def fit(key, parts):
        r, a, ex = _rows_then_examples(parts)
        if len(r) == 0:
            return None
        X = np.vstack(r[vec_col].to_numpy()).astype(np.float64)
        W = np.eye(X.shape[1])
        if use_adapter:
            vecs = {int(k): np.asarray(v, dtype=np.float64) for k, v in zip(a["row_id"], a[vec_col])}
            W = _adapt(X, pd.Index(r["row_id"].to_numpy()), ex, vecs, loss, lr, margin, int(r["_steps"].iloc[0]), batch_size, by_id, optimizer)
        Xa = X @ W.T
        Y = r[label_cols].to_numpy().astype(np.int64)
        recs = []
        for j in range(len(label_cols)):
            t = Y[:, j]
            feats = Xa if strategy != "classifier-chain" or j == 0 else np.hstack([Xa, Y[:, :j].astype(np.float64)])
            if t.min() == t.max():
                if strategy == "multi-output":
                    raise ValueError(f"label column {label_cols[j]!r} has one value only in split {key}")
                recs.append((j, np.zeros(X.shape[1]), [], 0.0, int(t[0])))
                continue
            if head == "centroid":
                w, b = feats[t == 1].mean(axis=0) - feats[t == 0].mean(axis=0), 0.0
            else:
                w, b = fit_binary_np(feats, t)
            wx, wc = w[: X.shape[1]], w[X.shape[1]:]
            recs.append((j, wx @ W, list(wc), b, None))
        out = {k: [v] * len(recs) for k, v in zip(keys, key)}
        out["label"] = [x[0] for x in recs]
        out["weights"] = [x[1] for x in recs]
        out["chain"] = [x[2] for x in recs]
        out["bias"] = [x[3] for x in recs]
        out["constant"] = pd.array([x[4] for x in recs], dtype="Int32")
        return pd.DataFrame(out)

    out = _stream(both, keys, order, fit, schema)
    for split in large:
        adapted, W = _large_rows(all_rows, all_examples, keys, split, anchors, loss, lr, margin, use_adapter, vec_col, batch_size, max_steps, optimizer)
        fitted = LG.fit_label_centroids(adapted, label_cols, strategy, vec_col) if head == "centroid" else LG.fit_multilabel(adapted, label_cols, strategy, vec_col)[0]
        got = [
            (*split, j, (h.w if W is None else h.w @ W).tolist(), h.chain.tolist(), h.b, h.constant) for j, h in enumerate(fitted)
        ]
        out = out.unionByName(rows.sparkSession.createDataFrame(got, schema))
    return out


def predict_multilabel(
    rows: DataFrame,
    weights: DataFrame,
    keys: list[str],
    id_col: str = "row_id",
    vec_col: str = "embedding",
    mask_col: str = "label_mask",
    encode: tuple[str, int] | None = None,
) -> DataFrame:
    """Confusion counts ``(keys, true_mask, pred_mask, n)`` of every split on the test rows
    (labels predicted in order, so chain weights see the earlier predictions). ``encode=(text_col,
    dim)`` encodes the text in the same Arrow pass."""
    chunks = weight_chunks(weights, keys)
    rows, encode = scored_rows(rows, chunks, id_col, vec_col, mask_col, encode)
    out = None
    for ch in chunks or [[]]:
        part = _predict_multilabel(rows, chosen(weights, keys, ch, chunks), weights, keys, id_col, vec_col, mask_col, encode)
        out = part if out is None else out.unionByName(part)
    return out


def _predict_multilabel(rows, chosen_weights, weights, keys, id_col, vec_col, mask_col, encode):
    from ..operators.encode import hash_vectors, small_batches

    groups: dict = {}
    for r in chosen_weights.toPandas().itertuples(index=False):
        groups.setdefault(tuple(getattr(r, k) for k in keys), []).append(r)
    packed = []
    for gk, rs in groups.items():
        rs.sort(key=lambda r: r.label)
        packed.append((gk, np.array([r.weights for r in rs]), [np.asarray(r.chain) for r in rs], np.array([r.bias for r in rs]),
                       [None if pd.isna(r.constant) else int(r.constant) for r in rs]))
    bc = rows.sparkSession.sparkContext.broadcast(packed)
    key_fields = [weights.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("true_mask", T.LongType()), T.StructField("pred_mask", T.LongType()),
                                        T.StructField("n", T.LongType())])

    def run(batches):
        acc: dict = {}
        stacked = np.vstack([p[1] for p in bc.value]) if bc.value else None
        for pdf in small_batches(batches, encode[0]) if encode else batches:
            if len(pdf) == 0 or stacked is None:
                continue
            if encode:
                X = hash_vectors(pdf[encode[0]].tolist(), encode[1])
            else:
                X = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64)
            true, t_code = np.unique(pdf[mask_col].to_numpy().astype(np.int64), return_inverse=True)
            scores, at = X @ stacked.T, 0  # one product for all splits
            for gk, W, chains, b, const in bc.value:
                S = scores[:, at : at + len(W)] + b
                at += len(W)
                preds = np.zeros(S.shape, dtype=np.int64)
                for j, c in enumerate(chains):
                    if const[j] is not None:
                        preds[:, j] = const[j]
                    else:
                        preds[:, j] = (S[:, j] + (preds[:, : len(c)] @ c if len(c) else 0.0)) > 0
                pred, p_code = np.unique((preds << np.arange(len(W))).sum(axis=1), return_inverse=True)
                counts = np.bincount(t_code * len(pred) + p_code, minlength=len(true) * len(pred))
                for i in np.flatnonzero(counts):
                    k = (gk, int(true[i // len(pred)]), int(pred[i % len(pred)]))
                    acc[k] = acc.get(k, 0) + int(counts[i])
        if acc:
            yield pd.DataFrame([dict(zip(keys, gk), true_mask=t, pred_mask=p, n=c) for (gk, t, p), c in acc.items()],
                               columns=[*keys, "true_mask", "pred_mask", "n"])

    return rows.select(id_col, encode[0] if encode else vec_col, mask_col).mapInPandas(run, schema)
