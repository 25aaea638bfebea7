"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every word has a sparse random index vector; its word vector adds up the index
vectors of its neighbours (two to either side) over the whole corpus. Words are hashed to
``BUCKETS`` rows, so the matrix has a fixed size (``BUCKETS`` x ``DIMS``), which is what the
driver gets and tasks are sent. Each task adds up its own texts and returns its matrix in blocks;
Spark adds blocks up in two steps (salted, then whole), in integers.

A document's features are the mean and the deviation of its words' vectors, the mean of their
index vectors, the mean product of neighbouring words' vectors of both kinds, and its length. The network (tanh hidden layer, logistic output) is trained with
numpy on a bounded sample of labelled rows; a held-back fifth of it calibrates the temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import free_name
from .words import word_hashes

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
BLOCK = 64
WORDS, LONG = 25_000, 200_000  # words a task holds the vectors of at a time, and of one long text
MAX_LABELLED = 20_000
SEED = 11


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIMS), np.int8)
    at = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:BUCKETS], at, rng.integers(0, 2, at.shape, dtype=np.int8) * 2 - 1, 1)
    return out


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


def _contexts(batches):
    """Add up the neighbours' index vectors of a task's words; rows: (block, sums)."""
    index = _index_vectors()
    sums = np.zeros((BUCKETS, DIMS), np.int64)
    for b in batches:
        for _, _, h, counts in word_hashes(b.column(0)):
            if not len(h):
                continue
            # texts are parted by REACH empty words (the zero row), so none sees its neighbour's words
            at = np.repeat(np.cumsum(counts), REACH)
            w = np.insert(_buckets(h), at, BUCKETS)
            for i in range(0, len(w), WORDS):
                lo, hi = max(0, i - REACH), min(len(w), i + WORDS + REACH)
                vec = index[w[lo:hi]].astype(np.int16)
                ctx = np.zeros_like(vec)
                for k in range(1, REACH + 1):
                    ctx[k:] += vec[:-k]
                    ctx[:-k] += vec[k:]
                own = slice(i - lo, i - lo + min(WORDS, len(w) - i))
                word, ctx = w[lo:hi][own], ctx[own]
                for d in range(DIMS):
                    sums[:, d] += np.bincount(word, weights=ctx[:, d], minlength=BUCKETS + 1)[:BUCKETS].astype(np.int64)
    live = sums.reshape(-1, BLOCK * DIMS)
    rows = np.flatnonzero(live.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array([live[r].tobytes() for r in rows], pa.binary())], ["block", "sums"]
    )


def _add(keys: list[str]):
    def run(key, table):
        total = np.zeros(BLOCK * DIMS, np.int64)
        for x in table["sums"]:
            total += np.frombuffer(x.as_py(), np.int64)
        cols = {k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key, strict=True)}
        return pa.table({**cols, "sums": pa.array([total.tobytes()], pa.binary())})

    return run


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors by bucket, from all texts of ``docs``; a bucket without words is zero."""
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_contexts, "block int, sums binary")
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)).cast("int"))
    some = parts.groupBy("block", "salt").applyInArrow(_add(["block", "salt"]), "block int, salt int, sums binary")
    rows = some.groupBy("block").applyInArrow(_add(["block"]), "block int, sums binary").collect()
    out = np.zeros((BUCKETS, DIMS))
    for r in rows:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.int64).reshape(BLOCK, DIMS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def _parts(ends: np.ndarray):
    """Ranges of about ``WORDS`` words, cut between texts; a text of more words is cut every ``LONG``."""
    s = 0
    while len(ends) and s < ends[-1]:
        last = int(np.searchsorted(ends, s + WORDS, "right")) - 1
        whole = last >= 0 and ends[last] > s
        e = int(ends[last]) if whole else int(min(ends[np.searchsorted(ends, s, "right")], s + LONG))
        yield s, e
        s = e


def _features(column, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), 3 * DIMS + 4), np.float32)
    for i, j, h, counts in word_hashes(column):
        n = np.maximum(counts, 1)[:, None]
        sums, pairs = np.zeros((3, j - i, DIMS)), np.zeros((2, j - i))
        w = _buckets(h)
        owner = np.repeat(np.arange(j - i), counts)
        for s, e in _parts(np.cumsum(counts)):
            part, own = w[s:e], owner[s:e]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            v, plain = vectors[part], index[part].astype(np.float32)
            for k, x in enumerate((v, v * v, plain)):
                np.add.at(sums[k], own[first], np.add.reduceat(x, first, axis=0))
            same = own[1:] == own[:-1]
            for k, x in enumerate((v, plain)):
                pairs[k] += np.bincount(own[1:][same], weights=(x[1:] * x[:-1]).sum(1)[same], minlength=j - i)
        mean = sums[0] / n
        out[i:j, :DIMS] = mean
        out[i:j, DIMS : 2 * DIMS] = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
        out[i:j, 2 * DIMS : 3 * DIMS] = sums[2] / n
        out[i:j, -4:-2] = (pairs / n[:, 0]).T
        out[i:j, -2] = np.log1p(counts)
        out[i:j, -1] = counts == 0
    return out


def _with_features(vectors: np.ndarray):
    def run(batches):
        index = _index_vectors()
        for b in batches:
            f = _features(b.column(0), vectors, index)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tobytes() for x in f], pa.binary())], ["h", "label", "f"])

    return run


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, f: np.ndarray) -> np.ndarray:
        x = (f - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(f) / self.temperature, -30, 30)))


def train_network(f: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on the logistic loss, fixed seed; every fifth row is held back for the temperature."""
    f, y = f.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 4
    mean, scale = f[~held].mean(0), f[~held].std(0) + 1e-6
    d = f.shape[1]
    p = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    x, t = (f[~held] - mean) / scale, y[~held]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            h = np.tanh(x[at] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[at]) / len(at)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [x[at].T @ back + decay * p[0], back.sum(0), h.T @ err + decay * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        z, t = net.logits(f[held]), y[held]

        def loss(temp):
            return np.logaddexp(0, -np.where(t == 1, z, -z) / temp).mean()

        net.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    constant: float = 0.5


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Word vectors from all ``docs``; the network from at most ``max_rows`` labelled rows (those
    with the smallest hash of their id; the bound keeps what the driver gets fixed).

    Labels other than 0 and 1, null ids, and ids with both labels are not learned from. With
    fewer than 10 labelled rows or one class only, the score is a constant (smoothed share)."""
    vectors = word_vectors(docs, text_col)
    good = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id is not null and label in (0, 1)")
    good = good.groupBy("l_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    h = F.xxhash64("l_id")
    some = good.withColumn("h", h).orderBy("h").limit(max_rows).select("l_id", "h", "label")
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("d_id") == F.col("l_id"))
    got = rows.select("text", "h", "label").mapInArrow(_with_features(vectors), "h long, label int, f binary")
    got = got.orderBy("h", "f").limit(max_rows).toArrow()
    y = got["label"].to_numpy()
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return Model(vectors, None, float((y.sum() + 1) / (len(y) + 2)))
    f = np.stack([np.frombuffer(x.as_py(), np.float32) for x in got["f"]])
    return Model(vectors, train_network(f, y))


def _score(model: Model):
    def run(batches):
        index = _index_vectors()
        for b in batches:
            s = np.full(b.num_rows, model.constant) if model.network is None else model.network.probabilities(_features(b.column(0), model.vectors, index))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], ["row", "quality_score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row of ``docs`` and ``quality_score`` (0 to
    1), from the whole text and nothing else. Null and empty texts are scored by their all-zero
    features; repeated rows get equal scores; no rows give no rows. Where the kept columns hold a
    ``quality_score``, the new last column is ``quality_score_`` (underscores until it is free)."""
    row = F.struct(*(docs.columns if keep is None else keep)).alias("row")
    src = docs.select(F.col(text_col).alias("text"), row)
    done = src.mapInArrow(_score(model), f"row {src.schema['row'].dataType.simpleString()}, quality_score double")
    names = src.schema["row"].dataType.names
    return done.select("row.*", F.col("quality_score").alias(free_name(names, "quality_score")))
