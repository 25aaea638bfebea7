"""Linear heads of one large training set: partial sums in Spark, exact optima.

Every problem (one label, one class against the others, or the classes of one soft-max) is
minimised by its own L-BFGS, which asks for its objective and gradient at a point
(``heads.lbfgs_steps``). All problems advance in lock-step: one pass over the rows answers what all
unfinished problems ask, so the number of passes is that of the slowest problem, whatever the
number of labels or classes. A task keeps one row of sums (objectives and gradients); with many
tasks these are added up in Spark first. The objectives are those of the per-split solvers in
``heads``, so both give the same optimum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heads import lbfgs_steps
from .losses import mean_vectors

DIRECT_SUMS, DRIVER_BYTES = 64, 1 << 26


@dataclass
class Problem:
    """Target column ``target`` (or class ``target`` of ``classes``); ``earlier``: how many target
    columns before it are features too (classifier chain)."""

    target: int
    earlier: int = 0


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _sums(kind: str, X: np.ndarray, T: np.ndarray, asked: list[tuple[Problem, np.ndarray]]) -> np.ndarray:
    """Objectives (without penalty), then gradients, of the asked points over some rows."""
    d = X.shape[1]
    if kind == "softmax":
        ((_, v),) = asked
        k = T.shape[1]
        Z = X @ v[: k * d].reshape(k, d).T + v[k * d :]
        Z -= Z.max(axis=1, keepdims=True)
        lse = np.log(np.exp(Z).sum(axis=1))
        G = np.exp(Z - lse[:, None]) - T
        return np.concatenate([[float(np.sum(lse - (Z * T).sum(axis=1)))], (G.T @ X).ravel(), G.sum(axis=0)])
    Z = X @ np.stack([x[:d] for _, x in asked]).T + np.array([x[-1] for _, x in asked])
    for a, (p, x) in enumerate(asked):
        if p.earlier:
            Z[:, a] += T[:, : p.earlier] @ x[d:-1]
    t = T[:, [p.target for p, _ in asked]]
    if kind == "logistic":
        losses, R = np.logaddexp(0.0, Z) - t * Z, np.exp(-np.logaddexp(0.0, -Z)) - t
    else:  # squared hinge
        s = np.where(t > 0, 1.0, -1.0)
        act = np.maximum(1.0 - s * Z, 0.0)
        losses, R = act * act, -2.0 * s * act
    GX, grads = R.T @ X, []
    for a, (p, _) in enumerate(asked):
        grads += [GX[a], T[:, : p.earlier].T @ R[:, a], [R[:, a].sum()]]
    return np.concatenate([losses.sum(axis=0), *grads])


def _add(batches):
    total = None
    for b in batches:
        for x in b.column(0):
            x = np.frombuffer(x.as_py(), np.float64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _pass(data: DataFrame, kind: str, asked: list[tuple[Problem, np.ndarray]], classes, parts: int) -> np.ndarray:
    """Sums of all rows: one job. ``data``: the vector, then the target columns (or the label)."""
    sent = data.sparkSession.sparkContext.broadcast((asked, classes))

    def run(batches):
        points, known = sent.value
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            if known is None:
                T = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[1:]], axis=1)
            else:
                T = (b.column(1).to_numpy(zero_copy_only=False)[:, None] == known[None, :]).astype(np.float64)
            part = _sums(kind, _vectors(b.column(0)), T, points)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = data.mapInArrow(run, "sums binary")
    size = 8 * sum(len(x) + 1 for _, x in asked)
    most = max(1, min(DIRECT_SUMS, DRIVER_BYTES // size))
    while parts > most:
        parts = math.isqrt(parts)
        sums = sums.repartition(parts).mapInArrow(_add, "sums binary")
    got = [np.frombuffer(r["sums"], np.float64) for r in sums.collect()]
    sent.unpersist()
    return np.sum(got, axis=0)


def _solve(data: DataFrame, kind: str, problems: list[Problem], starts: list[np.ndarray], d: int, C: float, classes=None) -> tuple[list[np.ndarray], int]:
    """Optima of all problems, and how many passes they took."""
    steps = [lbfgs_steps(x) for x in starts]
    asked = {i: next(g) for i, g in enumerate(steps)}
    found: dict[int, np.ndarray] = {}
    parts, passes = data.rdd.getNumPartitions(), 0
    while asked:
        order = list(asked)
        sums, at = _pass(data, kind, [(problems[i], asked[i]) for i in order], classes, parts), len(order)
        passes += 1
        for a, i in enumerate(order):
            x = asked[i]
            free = np.zeros(len(x), bool)  # intercepts that are not penalised
            if kind == "softmax":
                free[len(classes) * d :] = True
            elif kind == "logistic":
                free[-1] = True
            w = np.where(free, 0.0, x)
            f, g = 0.5 * float(w @ w) + C * float(sums[a]), C * sums[at : at + len(x)] + w
            at += len(x)
            try:
                asked[i] = steps[i].send((f, g))
            except StopIteration as end:
                found[i] = end.value
                del asked[i]
    return [found[i] for i in range(len(problems))], passes


def _cached(df: DataFrame) -> tuple[DataFrame, int]:
    data = df.persist()
    first = data.select(F.size(df.columns[0]).alias("d")).first()
    if first is None:
        data.unpersist()
        raise ValueError("no training rows")
    return data, int(first["d"])


def fit_logreg(train: DataFrame, label_col: str = "label", vec_col: str = "embedding", C: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(classes, W, b)`` of the soft-max logistic regression that ``heads.fit_logreg_np`` fits
    (two classes: the binary form, as ``[-w/2, w/2]``), on any number of rows. Only distinct labels
    and sums reach the driver."""
    data, d = _cached(train.select(vec_col, label_col))
    try:
        classes = np.array(sorted(r[0] for r in data.select(label_col).distinct().collect()))
        k = len(classes)
        if k == 1:
            return classes, np.zeros((1, d)), np.zeros(1)
        if k == 2:
            ((w,), _) = _solve(data, "logistic", [Problem(1)], [np.zeros(d + 1)], d, C, classes)
            return classes, np.vstack([-w[:d] / 2, w[:d] / 2]), np.array([-w[d] / 2, w[d] / 2])
        ((v,), _) = _solve(data, "softmax", [Problem(0)], [np.zeros(k * d + k)], d, C, classes)
        return classes, v[: k * d].reshape(k, d), v[k * d :]
    finally:
        data.unpersist()


def fit_linear_svc(train: DataFrame, label_col: str = "label", vec_col: str = "embedding", C: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(classes, W, b)`` of the squared-hinge SVC with penalised intercept that
    ``heads.fit_linear_svc_np`` fits: one machine for two classes, else one a class, all of them in
    the same passes."""
    data, d = _cached(train.select(vec_col, label_col))
    try:
        classes = np.array(sorted(r[0] for r in data.select(label_col).distinct().collect()))
        which = [1] if len(classes) == 2 else range(len(classes))
        ws, _ = _solve(data, "hinge", [Problem(j) for j in which], [np.zeros(d + 1) for _ in which], d, C, classes)
    finally:
        data.unpersist()
    if len(classes) == 2:
        w = ws[0]
        return classes, np.vstack([-w[:d] / 2, w[:d] / 2]), np.array([-w[d] / 2, w[d] / 2])
    return classes, np.stack(ws)[:, :d], np.stack(ws)[:, d]


def fit_head(head: str, train: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(classes, W, b)`` of the named head, as ``heads.fit_head_np`` fits it."""
    if head == "logistic_regression":
        return fit_logreg(train, label_col, vec_col)
    if head == "LinearSVC":
        return fit_linear_svc(train, label_col, vec_col)
    if head == "centroid":
        got = sorted(mean_vectors(train.select(F.col(label_col).alias("label"), vec_col), ["label"], vec_col, out="w").collect(), key=lambda r: r["label"])
        return np.array([r["label"] for r in got]), np.array([r["w"] for r in got]), np.zeros(len(got))
    raise ValueError(f"unknown head {head!r}")


@dataclass
class LabelHead:
    """Head of one label: ``w`` on the vector, ``chain`` on the earlier labels, or a constant."""

    w: np.ndarray
    chain: np.ndarray
    b: float
    constant: int | None = None


def fit_multilabel(
    train: DataFrame, label_cols: list[str], strategy: str = "one-vs-rest", vec_col: str = "embedding", C: float = 1.0
) -> tuple[list[LabelHead], int]:
    """Binary logistic heads of all labels in one fit, and the passes it took.

    ``classifier-chain``: label j also sees the true labels before it. A constant label column
    is predicted as it is (``multi-output`` raises). Passes do not grow with the labels."""
    if strategy not in ("one-vs-rest", "multi-output", "classifier-chain"):
        raise ValueError(f"unknown multi-label strategy {strategy!r}")
    data, d = _cached(train.select(vec_col, *[F.col(c).cast("double").alias(c) for c in label_cols]))
    try:
        ends = data.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(label_cols) for name, f in (("lo", F.min), ("hi", F.max))]).first()
        live = [j for j in range(len(label_cols)) if ends[f"lo_{j}"] != ends[f"hi_{j}"]]
        if strategy == "multi-output" and len(live) < len(label_cols):
            raise ValueError(f"label column {next(c for j, c in enumerate(label_cols) if j not in live)!r} has one value only")
        problems = [Problem(j, j if strategy == "classifier-chain" else 0) for j in live]
        xs, passes = _solve(data, "logistic", problems, [np.zeros(d + p.earlier + 1) for p in problems], d, C) if live else ([], 0)
    finally:
        data.unpersist()
    heads = [LabelHead(np.zeros(d), np.zeros(0), 0.0, int(ends[f"lo_{j}"])) for j in range(len(label_cols))]
    for p, x in zip(problems, xs, strict=True):
        heads[p.target] = LabelHead(x[:d], x[d:-1], float(x[-1]))
    return heads, passes


def fit_label_centroids(train: DataFrame, label_cols: list[str], strategy: str, vec_col: str = "embedding") -> list[LabelHead]:
    """Class-mean heads of all labels: the mean of the rows with a label less that of the others
    (and so for the earlier labels of a chain)."""
    long = train.select(vec_col, *label_cols, F.posexplode(F.array(*[F.col(c).cast("int") for c in label_cols])).alias("label", "t"))
    known = F.slice(F.array(*[F.col(c).cast("double") for c in label_cols]), F.lit(1), F.col("label") if strategy == "classifier-chain" else F.lit(0))
    long = long.select("label", "t", F.concat(F.col(vec_col).cast("array<double>"), known).alias("x"))
    means = {(r["label"], r["t"]): np.array(r["w"]) for r in mean_vectors(long, ["label", "t"], "x", out="w").collect()}
    heads = []
    for j, c in enumerate(label_cols):
        one, none = means.get((j, 1)), means.get((j, 0))
        if one is None or none is None:
            if strategy == "multi-output":
                raise ValueError(f"label column {c!r} has one value only")
            whole = one if one is not None else none
            d = len(whole) - (j if strategy == "classifier-chain" else 0)
            heads.append(LabelHead(np.zeros(d), np.zeros(0), 0.0, int(one is not None)))
        else:
            w = one - none
            d = len(w) - (j if strategy == "classifier-chain" else 0)
            heads.append(LabelHead(w[:d], w[d:], 0.0))
    return heads


def multilabel_weights(spark, heads: list[LabelHead]) -> DataFrame:
    """Heads as the table that ``grid.predict_multilabel`` reads."""
    rows = [(0, j, h.w.tolist(), h.chain.tolist(), h.b, h.constant) for j, h in enumerate(heads)]
    return spark.createDataFrame(rows, "fit int, label int, weights array<double>, chain array<double>, bias double, constant int")


def class_weights(spark, classes: np.ndarray, W: np.ndarray, b: np.ndarray) -> DataFrame:
    """A single-label head as the table that ``heads.predict`` reads."""
    rows = [(0, c.item(), w.tolist(), float(x)) for c, w, x in zip(classes, W, b, strict=True)]
    return spark.createDataFrame(rows, "fit int, label int, weights array<double>, bias double")


def gradient_sizes(rows: DataFrame, heads: DataFrame, kind: str, C: float = 1.0, vec_col: str = "embedding") -> DataFrame:
    """Certificate of an optimum in DataFrame functions: ``label, n_rows, positives, gradient`` with
    the largest entry of the objective's gradient at the stored weights.

    ``rows``: ``row_id``, the vector, ``labels`` (array of 0/1 by label number). ``heads``: ``label,
    weights, chain, bias`` (bounded: labels x dimensions). ``kind``: ``logistic``, ``hinge`` or
    ``softmax`` (all labels as classes of one)."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    known = F.transform(F.slice("labels", F.lit(1), F.size("chain")), lambda x: x.cast("double"))
    scored = rows.select("row_id", vec_col, "labels").join(F.broadcast(heads), F.lit(True)).withColumn("t", F.element_at("labels", F.col("label") + 1))
    scored = scored.withColumn("z", dot(F.col(vec_col), F.col("weights")) + F.col("bias") + dot(known, F.col("chain")))
    if kind == "softmax":
        total = scored.groupBy("row_id").agg(F.sum(F.exp("z")).alias("e"))
        scored = scored.join(total, "row_id").withColumn("r", F.exp("z") / F.col("e") - F.col("t"))
    elif kind == "logistic":
        scored = scored.withColumn("r", 1 / (1 + F.exp(-F.col("z"))) - F.col("t"))
    else:
        sign = F.when(F.col("t") > 0, 1.0).otherwise(-1.0)
        scored = scored.withColumn("r", -2.0 * sign * F.greatest(F.lit(0.0), 1.0 - sign * F.col("z")))
    bias = F.when(F.lit(kind == "hinge"), F.col("bias")).otherwise(0.0)
    features = F.concat(F.col(vec_col).cast("array<double>"), known, F.array(F.lit(1.0)))
    cells = scored.select("label", "t", "r", F.posexplode(F.arrays_zip(features.alias("x"), F.concat("weights", "chain", F.array(bias)).alias("w"))).alias("k", "c"))
    entry = cells.groupBy("label", "k").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("t").cast("long").alias("positives"), (C * F.sum(F.col("r") * F.col("c.x")) + F.first("c.w")).alias("g")
    )
    return entry.groupBy("label").agg(F.max("n_rows").alias("n_rows"), F.max("positives").alias("positives"), F.max(F.abs("g")).alias("gradient"))
