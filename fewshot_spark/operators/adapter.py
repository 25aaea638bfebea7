"""Embedding adapter: a linear map ``W`` learned on frozen embeddings with the triplet or the
cosine-similarity loss (the stand-in for fine-tuning the sentence encoder).

Each step is one distributed job: ``W`` is broadcast, every partition returns its partial
(loss sum, count, gradient) from ``mapInPandas``; with more than 64 partitions the partials are
first summed in about sqrt(p) tasks (a tree reduction in Spark), so the driver receives at most
max(64, sqrt(p)) d x d arrays per step, and takes the step. The learning rate warms up linearly over the first 10 % of
the steps (rounded up) and then decays linearly to 0. Steps are plain or keep moments of the
gradient (``Steps``), over all examples or one mini-batch at a time. ``W`` starts at the identity for every
fit, so fits are pure functions of their input (the weight reset between splits).

Gradient of ``c = cos(Wx, Wy)`` with ``u = Wx``, ``v = Wy``:
``dc/dW = (v/(|u||v|) - c u/|u|²) xᵀ + (u/(|u||v|) - c v/|v|²) yᵀ``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-8
DIRECT_PARTIALS = 64  # up to this many partial gradients go straight to the driver


def _cos_and_grads(U, V):
    nu = np.maximum(np.linalg.norm(U, axis=1), EPS)
    nv = np.maximum(np.linalg.norm(V, axis=1), EPS)
    c = np.einsum("ij,ij->i", U, V) / (nu * nv)
    gu = V / (nu * nv)[:, None] - (c / nu**2)[:, None] * U
    gv = U / (nu * nv)[:, None] - (c / nv**2)[:, None] * V
    return c, gu, gv


def grad_triplet(W: np.ndarray, A: np.ndarray, P: np.ndarray, N: np.ndarray, margin: float):
    """(loss sum, gradient sum) of the cosine triplet loss under ``W``."""
    UA, UP, UN = A @ W.T, P @ W.T, N @ W.T
    c_ap, g_a1, g_p = _cos_and_grads(UA, UP)
    c_an, g_a2, g_n = _cos_and_grads(UA, UN)
    val = (1 - c_ap) - (1 - c_an) + margin
    act = val > 0
    # loss = c_an - c_ap + margin on active rows; the four outer-product sums as one product
    G = np.concatenate([(g_a2 - g_a1)[act], -g_p[act], g_n[act]]).T @ np.concatenate([A[act], P[act], N[act]])
    return float(np.sum(val[act])), G


def grad_cosine(W: np.ndarray, X: np.ndarray, Y: np.ndarray, t: np.ndarray):
    """(loss sum, gradient sum) of the cosine-similarity loss under ``W``."""
    UX, UY = X @ W.T, Y @ W.T
    c, gx, gy = _cos_and_grads(UX, UY)
    r = c - t
    G = np.concatenate([2 * r[:, None] * gx, 2 * r[:, None] * gy]).T @ np.concatenate([X, Y])
    return float(np.sum(r * r)), G


def lr_at(step: int, steps: int, lr: float) -> float:
    """Linear warm-up over ceil(0.1 * steps) steps, then linear decay to 0."""
    warm = math.ceil(steps * 0.1)
    if step < warm:
        return lr * (step + 1) / warm
    return lr * max(0.0, (steps - step) / max(1, steps - warm))


def _partials(W: np.ndarray, batch: pd.DataFrame, loss: str, margin: float):
    """(loss sum, gradient sum wrt W) of one Arrow batch."""
    if loss == "triplet":
        A = np.vstack(batch["a"].to_numpy()).astype(np.float64)
        P = np.vstack(batch["p"].to_numpy()).astype(np.float64)
        N = np.vstack(batch["n"].to_numpy()).astype(np.float64)
        return grad_triplet(W, A, P, N, margin)
    X = np.vstack(batch["u"].to_numpy()).astype(np.float64)
    Y = np.vstack(batch["v"].to_numpy()).astype(np.float64)
    return grad_cosine(W, X, Y, batch["target"].to_numpy().astype(np.float64))


def _sum_partials(batches):
    """Add the partial (loss, n, gradient) rows of one partition into one row."""
    tot, n, G = 0.0, 0, None
    for b in batches:
        if len(b) == 0:
            continue
        tot += float(b["loss"].sum())
        n += int(b["n"].sum())
        g = np.sum(np.vstack(b["grad"].to_numpy()), axis=0)
        G = g if G is None else G + g
    if n:
        yield pd.DataFrame({"loss": [tot], "n": [n], "grad": [G]})


OPTIMIZERS = ("sgd", "adamw")


class Steps:
    """Takes gradient steps on ``W`` from the identity over ``steps`` steps with warm-up and decay.

    ``sgd``: plain steps. ``adamw``: bias-corrected first and second moments (0.9, 0.999) and
    decay of ``W - I`` decoupled from the gradient (the identity is the frozen encoder itself)."""

    def __init__(self, d: int, steps: int, lr: float, optimizer: str = "sgd", decay: float = 0.01):
        if optimizer not in OPTIMIZERS:
            raise ValueError(f"optimizer must be one of {OPTIMIZERS}")
        self.W, self.m, self.v = np.eye(d), np.zeros((d, d)), np.zeros((d, d))
        self.steps, self.lr, self.optimizer, self.decay, self.step = steps, lr, optimizer, decay, 0

    def take(self, G: np.ndarray) -> None:
        rate = lr_at(self.step, self.steps, self.lr)
        self.step += 1
        if self.optimizer == "sgd":
            self.W = self.W - rate * G
            return
        self.m, self.v = 0.9 * self.m + 0.1 * G, 0.999 * self.v + 0.001 * G * G
        first, second = self.m / (1 - 0.9**self.step), self.v / (1 - 0.999**self.step)
        self.W = self.W - rate * (first / (np.sqrt(second) + EPS) + self.decay * (self.W - np.eye(len(self.W))))


_SUMS = T.StructType([
    T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("grad", T.ArrayType(T.DoubleType())),
])


def _summed(data: DataFrame, W: np.ndarray, loss: str, margin: float, n_parts: int) -> tuple[float, int, np.ndarray]:
    """Mean loss, number and mean gradient of all examples of ``data`` under ``W``: one job."""
    d = len(W)
    bw = data.sparkSession.sparkContext.broadcast(W)

    def part(batches):
        Wl = bw.value
        tot, n, G = 0.0, 0, np.zeros_like(Wl)
        for b in batches:
            if len(b) == 0:
                continue
            l, g = _partials(Wl, b, loss, margin)
            tot += l
            n += len(b)
            G += g
        if n:
            yield pd.DataFrame({"loss": [tot], "n": [n], "grad": [G.ravel()]})

    partials = data.mapInPandas(part, _SUMS)
    most = max(1, min(DIRECT_PARTIALS, (1 << 26) // (8 * d * d)))
    while n_parts > most:  # sum in Spark until the driver gets at most 64 MB of partials
        n_parts = math.isqrt(n_parts)
        partials = partials.repartition(n_parts).mapInPandas(_sum_partials, _SUMS)
    parts = partials.collect()
    bw.unpersist()
    n = sum(r["n"] for r in parts)
    G = sum((np.asarray(r["grad"]) for r in parts), np.zeros(d * d)).reshape(d, d) / max(n, 1)
    return sum(r["loss"] for r in parts) / max(n, 1), n, G


def fit_adapter(
    examples: DataFrame,
    loss: str = "triplet",
    steps: int = 20,
    lr: float = 2.0,
    margin: float = 0.25,
    partitions: int | None = None,
    optimizer: str = "sgd",
) -> tuple[np.ndarray, list[float]]:
    """Learn ``W`` by gradient steps; returns ``(W, [mean loss before each step])``.

    ``examples`` holds ``a, p, n`` arrays (triplet) or ``u, v, target`` (cosine). With a column
    ``batch_id`` (0 to steps - 1) each step sees its own mini-batch, in that order; without, all
    examples. They are persisted once (sorted by batch, so a step skips the cached blocks of the
    others), coalesced to ``partitions`` where given; each step has one partial per partition.
    """
    if loss not in ("triplet", "cosine"):
        raise ValueError("loss is 'triplet' or 'cosine'")
    batched = "batch_id" in examples.columns
    cols = ["a", "p", "n"] if loss == "triplet" else ["u", "v", "target"]
    data = examples.select(*cols, *(["batch_id"] if batched else []))
    if partitions:
        data = data.coalesce(partitions)
    data = (data.sortWithinPartitions("batch_id") if batched else data).persist()
    try:
        first = data.select(F.size(cols[0]).alias("d")).first()
        if first is None:
            raise ValueError("no training examples")
        n_parts = data.rdd.getNumPartitions()
        run, history = Steps(int(first["d"]), steps, lr, optimizer), []
        for step in range(steps):
            batch = data.where(F.col("batch_id") == step) if batched else data
            mean, n, G = _summed(batch.select(*cols), run.W, loss, margin, n_parts)
            if n:
                history.append(mean)
                run.take(G)
    finally:
        data.unpersist()
    return run.W, history


def adapter_loss(examples: DataFrame, W: np.ndarray, loss: str = "triplet", margin: float = 0.25) -> float:
    """Mean loss of the examples under ``W`` (one job)."""
    cols = ["a", "p", "n"] if loss == "triplet" else ["u", "v", "target"]
    sc = examples.sparkSession.sparkContext
    bw = sc.broadcast(W)

    def part(batches):
        tot, n = 0.0, 0
        for b in batches:
            if len(b):
                l, _ = _partials(bw.value, b, loss, margin)
                tot += l
                n += len(b)
        yield pd.DataFrame({"loss": [tot], "n": [n]})

    rows = examples.select(*cols).mapInPandas(part, "loss double, n long").collect()
    bw.unpersist()
    n = sum(r["n"] for r in rows)
    return sum(r["loss"] for r in rows) / max(n, 1)


def apply_adapter(df: DataFrame, W: np.ndarray, vec_col: str = "embedding", out: str | None = None) -> DataFrame:
    """``out = W · vec`` for every row (Arrow batches, W broadcast)."""
    out = out or vec_col
    sc = df.sparkSession.sparkContext
    bw = sc.broadcast(W)
    fields = [f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))]

    def run(batches):
        Wl = bw.value
        for b in batches:
            if len(b) == 0:
                continue
            X = np.vstack(b[vec_col].to_numpy()).astype(np.float64)
            b = b.copy()
            b[out] = list(X @ Wl.T)
            yield b[[f.name for f in fields]]

    return df.mapInPandas(run, T.StructType(fields))
