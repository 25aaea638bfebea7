"""Linear classification heads over embeddings, and prediction.

Two execution shapes, chosen by the size of what one fit sees:

* many small splits (the few-shot grid): ``fit_heads_per_split`` runs one numpy fit per split
  inside ``groupBy(split).applyInPandas``; a split holds at most k x classes rows, so
  every group fits one task and all splits train in parallel;
* one large training set: ``operators.large`` (the same objectives, sums made in Spark), or MLlib
  estimators (``mllib_*``).

Objectives (no scikit-learn on the box; these follow its documented defaults):
* logistic regression: multinomial soft-max, ``0.5 |W|^2 + C Σ log-loss``, C = 1, intercept
  not penalised, L-BFGS until every gradient entry is at most ``GRADIENT_TOL``;
* linear SVC: one-vs-rest squared hinge, ``0.5 |w|^2 + C Σ max(0, 1 - y w·x)^2`` with the
  intercept as a penalised constant feature;
* nearest centroid (``fit_centroids``): class-mean weights, used where a relational oracle must
  reproduce the predictions exactly.

``predict`` scores rows against broadcast weights in Arrow batches (``mapInPandas``); the
weights table is collected only after a size check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .losses import mean_vectors

MAX_BROADCAST_WEIGHTS = 50_000_000  # doubles (400 MB)


# ---- numpy solvers (run inside tasks) -------------------------------------------------------


GRADIENT_TOL = 1e-5


def _line_search(x, f, gd, d, c1: float = 1e-4, c2: float = 0.9):
    """Step along ``d`` that meets the sufficient-decrease and the curvature condition (bisection).
    Near the optimum the decrease drowns in rounding, so there the slope alone decides."""
    lo, hi, step = 0.0, np.inf, 1.0
    noise = 1e-13 * max(1.0, abs(f))
    for _ in range(60):
        x_new = x + step * d
        f_new, g_new = yield x_new
        slope = float(g_new @ d)
        if f_new > f + c1 * step * gd + noise or (f_new > f - noise and slope > -c2 * gd):
            hi = step
        elif slope < c2 * gd:
            lo = step
        else:
            break
        step = (lo + hi) / 2 if np.isfinite(hi) else 2 * step
    return x_new, f_new, g_new


def lbfgs_steps(x0: np.ndarray, max_iter: int = 2000, m: int = 10, tol: float = GRADIENT_TOL):
    """L-BFGS as a generator: it yields points, is sent ``(value, gradient)`` there, and returns
    the optimum. It ends when no gradient entry exceeds ``tol`` (an objective that stalls is no
    reason to end). Whoever drives it decides where the sums are made."""
    x = x0.astype(np.float64).copy()
    f, g = yield x
    s_hist: list[np.ndarray] = []
    y_hist: list[np.ndarray] = []
    for _ in range(max_iter):
        if np.max(np.abs(g)) < tol:
            break
        q = g.copy()
        alphas = []
        for s, y in zip(reversed(s_hist), reversed(y_hist)):
            rho = 1.0 / float(y @ s)
            a = rho * float(s @ q)
            alphas.append((rho, a))
            q -= a * y
        if y_hist:
            q *= float(s_hist[-1] @ y_hist[-1]) / float(y_hist[-1] @ y_hist[-1])
        for (s, y), (rho, a) in zip(zip(s_hist, y_hist), reversed(alphas)):
            b = rho * float(y @ q)
            q += s * (a - b)
        d = -q
        gd = float(g @ d)
        if gd >= 0:
            d, gd = -g, -float(g @ g)
        x_new, f_new, g_new = yield from _line_search(x, f, gd, d)
        s, y = x_new - x, g_new - g
        if float(s @ y) > 1e-16 * float(y @ y):
            s_hist.append(s)
            y_hist.append(y)
            if len(s_hist) > m:
                s_hist.pop(0)
                y_hist.pop(0)
        x, f, g = x_new, f_new, g_new
    return x


def lbfgs(fun, x0: np.ndarray, max_iter: int = 2000, m: int = 10, tol: float = GRADIENT_TOL) -> np.ndarray:
    """Minimise ``fun(x) -> (value, grad)`` by ``lbfgs_steps``."""
    steps = lbfgs_steps(x0, max_iter, m, tol)
    x = next(steps)
    while True:
        try:
            x = steps.send(fun(x))
        except StopIteration as end:
            return end.value


def fit_logreg_np(X: np.ndarray, y: np.ndarray, classes: np.ndarray, C: float = 1.0, max_iter: int = 2000):
    """Soft-max logistic regression; returns ``(W [k x d], b [k])``. Two classes use the binary
    (one weight vector) form, returned as ``[-w/2, w/2]`` so arg-max equals the binary rule."""
    n, d = X.shape
    k = len(classes)
    idx = np.searchsorted(classes, y)
    if k == 1:
        return np.zeros((1, d)), np.zeros(1)
    if k == 2:
        t = (idx == 1).astype(np.float64)

        def fun(w):
            z = X @ w[:d] + w[d]
            loss = np.sum(np.logaddexp(0.0, z) - t * z)
            p = np.exp(-np.logaddexp(0.0, -z))  # sigmoid without overflow
            g = np.empty(d + 1)
            g[:d] = C * (X.T @ (p - t)) + w[:d]
            g[d] = C * np.sum(p - t)
            return 0.5 * float(w[:d] @ w[:d]) + C * loss, g

        w = lbfgs(fun, np.zeros(d + 1), max_iter)
        W = np.vstack([-w[:d] / 2, w[:d] / 2])
        return W, np.array([-w[d] / 2, w[d] / 2])
    Y = np.zeros((n, k))
    Y[np.arange(n), idx] = 1.0

    def fun(v):
        W = v[: k * d].reshape(k, d)
        b = v[k * d:]
        Z = X @ W.T + b
        Z -= Z.max(axis=1, keepdims=True)
        lse = np.log(np.exp(Z).sum(axis=1))
        loss = float(np.sum(lse - (Z * Y).sum(axis=1)))
        P = np.exp(Z - lse[:, None])
        G = P - Y
        gW = C * (G.T @ X) + W
        gb = C * G.sum(axis=0)
        return 0.5 * float(np.sum(W * W)) + C * loss, np.concatenate([gW.ravel(), gb])

    v = lbfgs(fun, np.zeros(k * d + k), max_iter)
    return v[: k * d].reshape(k, d), v[k * d:]


def fit_linear_svc_np(X: np.ndarray, y: np.ndarray, classes: np.ndarray, C: float = 1.0, max_iter: int = 2000):
    """One-vs-rest squared-hinge linear SVC; two classes use one binary machine."""
    n, d = X.shape
    Xb = np.hstack([X, np.ones((n, 1))])

    def binary(t):
        s = np.where(t, 1.0, -1.0)

        def fun(w):
            margin = 1.0 - s * (Xb @ w)
            act = np.maximum(margin, 0.0)
            return 0.5 * float(w @ w) + C * float(act @ act), w - 2.0 * C * (Xb.T @ (s * act))

        return lbfgs(fun, np.zeros(d + 1), max_iter)

    if len(classes) == 2:
        w = binary(y == classes[1])
        return np.vstack([-w[:d] / 2, w[:d] / 2]), np.array([-w[d] / 2, w[d] / 2])
    ws = np.vstack([binary(y == c) for c in classes])
    return ws[:, :d], ws[:, d]


def fit_binary_np(X: np.ndarray, t: np.ndarray, C: float = 1.0, constant: str = "predict") -> tuple[np.ndarray, float]:
    """One binary logistic regression ``(w, b)``; a constant target column predicts that constant
    (``constant='predict'``) or raises (``'raise'``)."""
    if t.min() == t.max():
        if constant == "raise":
            raise ValueError("a label column has one value only")
        return np.zeros(X.shape[1]), (1e6 if t[0] == 1 else -1e6)
    W, b = fit_logreg_np(X, t.astype(np.int64), np.array([0, 1]), C)
    return (W[1] - W[0]), float(b[1] - b[0])


def fit_head_np(head: str, X: np.ndarray, y: np.ndarray, classes: np.ndarray, C: float = 1.0):
    """``(W [k x d], b [k])`` of the named head."""
    if head == "logistic_regression":
        return fit_logreg_np(X, y, classes, C)
    if head == "LinearSVC":
        return fit_linear_svc_np(X, y, classes, C)
    if head == "centroid":
        return np.vstack([X[y == c].mean(axis=0) for c in classes]), np.zeros(len(classes))
    raise ValueError(f"unknown head {head!r}")


# ---- split-parallel fits (T10) ---------------------------------------------------------------


def fit_heads_per_split(
    train: DataFrame,
    keys: list[str],
    head: str = "logistic_regression",
    label_col: str = "label",
    vec_col: str = "embedding",
    C: float = 1.0,
) -> DataFrame:
    """One fit per split, all splits in parallel: ``(keys, label, weights ARRAY<DOUBLE>, bias)``.

    A split's rows are one group: bound them beforehand (``grid.bounded_rows``) or use the MLlib
    heads for one large set. Splits are spread over as many partitions as there are cores."""
    key_fields = [train.schema[k] for k in keys]
    schema = T.StructType(key_fields + [
        T.StructField("label", train.schema[label_col].dataType),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("bias", T.DoubleType()),
    ])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64)
        y = pdf[label_col].to_numpy()
        classes = np.unique(y)
        W, b = fit_head_np(head, X, y, classes, C)
        out = {k: [pdf[k].iloc[0]] * len(classes) for k in keys}
        out["label"] = classes
        out["weights"] = [row for row in W]
        out["bias"] = b
        return pd.DataFrame(out)

    n = max(train.sparkSession.sparkContext.defaultParallelism, 1)
    return train.select(*keys, label_col, vec_col).repartition(n, *keys).groupBy(*keys).applyInPandas(fit, schema)


def fit_centroids(train: DataFrame, keys: list[str], label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Class-mean weights ``(keys, label, weights, bias = 0)``, all in SQL."""
    cents = mean_vectors(train.select(*keys, F.col(label_col).alias("label"), vec_col), [*keys, "label"], vec_col, out="weights")
    return cents.withColumn("bias", F.lit(0.0))


# ---- prediction (T11) -----------------------------------------------------------------------


def _pack(weights: DataFrame, keys: list[str]):
    """Weights of some splits as numpy arrays (collected through Arrow), by split in label order."""
    pdf = weights.select(*keys, "label", "weights", "bias").toPandas()
    out = []
    for gk, rs in pdf.sort_values("label", kind="stable").groupby(keys, sort=False, dropna=False):
        out.append((gk if isinstance(gk, tuple) else (gk,), rs["label"].to_numpy(), np.vstack(rs["weights"].to_numpy()).astype(np.float64),
                    rs["bias"].to_numpy(np.float64)))
    return out


def chosen(weights: DataFrame, keys: list[str], chunk: list[tuple], chunks: list) -> DataFrame:
    """The weights of one chunk of splits."""
    if len(chunks) <= 1:
        return weights
    schema = T.StructType([weights.schema[k] for k in keys])
    return weights.join(F.broadcast(weights.sparkSession.createDataFrame(chunk, schema)), keys, "left_semi")


def scored_rows(rows: DataFrame, chunks: list, id_col: str, vec_col: str, label_col: str | None, encode):
    """``rows`` to score and how to encode them on the way. With several chunks the vectors are
    written once (``checkpoint``), so no chunk encodes the texts again."""
    if len(chunks) <= 1 or not encode:
        return rows, encode
    from .encode import hash_vectors, small_batches

    cols = [id_col, *([label_col] if label_col else [])]
    schema = T.StructType([*[rows.schema[c] for c in cols], T.StructField(vec_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in small_batches(batches, encode[0]):
            yield pdf[cols].assign(**{vec_col: list(hash_vectors(pdf[encode[0]].tolist(), encode[1]))})

    return rows.select(*cols, encode[0]).mapInPandas(run, schema).checkpoint(), None


def weight_chunks(weights: DataFrame, keys: list[str], bound: int | None = None) -> list[list[tuple]]:
    """Split keys packed into chunks whose weights (classes x dim doubles) each fit ``bound``
    (default ``MAX_BROADCAST_WEIGHTS``); a larger split is a chunk of its own. One small
    aggregation: one row per split."""
    bound = MAX_BROADCAST_WEIGHTS if bound is None else bound
    sizes = weights.groupBy(*keys).agg(F.sum(F.size("weights")).alias("_cells")).collect()
    chunks: list[list[tuple]] = []
    cur: list[tuple] = []
    used = 0
    for r in sorted(sizes, key=lambda r: tuple(r[k] for k in keys)):
        c = int(r["_cells"])
        if cur and used + c > bound:
            chunks.append(cur)
            cur, used = [], 0
        cur.append(tuple(r[k] for k in keys))
        used += c
    if cur:
        chunks.append(cur)
    return chunks


def _argmax(scores: np.ndarray) -> np.ndarray:
    """Arg-max with ties to the lowest class (scores rounded to 9 digits first)."""
    return np.argmax(np.round(scores, 9), axis=1)


def predict(
    rows: DataFrame,
    weights: DataFrame,
    keys: list[str],
    id_col: str = "row_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    aggregate: bool = False,
    encode: tuple[str, int] | None = None,
) -> DataFrame:
    """Score every row with the weights of every split (keys) and take the arg-max class.

    ``encode=(text_col, dim)`` encodes the text with the hashed encoder inside the same Arrow
    pass instead of reading ``vec_col``, so no vector column is ever materialised for the test
    table.

    ``aggregate=False``: ``(keys, row_id, y_true, y_pred)``; ``aggregate=True``: confusion counts
    ``(keys, y_true, y_pred, n)`` summed inside each task, so the output is splits x classes^2 per
    task rather than splits x rows. The test table is never shuffled. The weights are broadcast
    when they fit ``MAX_BROADCAST_WEIGHTS`` doubles; beyond that the splits are scored in chunks
    that each fit, and texts are encoded once for all chunks.
    """
    chunks = weight_chunks(weights, keys)
    rows, encode = scored_rows(rows, chunks, id_col, vec_col, label_col, encode)
    out = None
    for ch in chunks or [[]]:
        packed = _pack(chosen(weights, keys, ch, chunks), keys)
        part = _predict_packed(rows, packed, weights, keys, id_col, vec_col, label_col, aggregate, encode)
        out = part if out is None else out.unionByName(part)
    return out


def _predict_packed(rows: DataFrame, packed: list, weights: DataFrame, keys: list[str], id_col: str, vec_col: str,
                    label_col: str | None, aggregate: bool, encode: tuple[str, int] | None = None) -> DataFrame:
    from .encode import hash_vectors, small_batches

    sc = rows.sparkSession.sparkContext
    bc = sc.broadcast(packed)
    key_fields = [weights.schema[k] for k in keys]
    label_type = weights.schema["label"].dataType
    true_type = rows.schema[label_col].dataType if label_col else label_type
    if aggregate:
        schema = T.StructType(key_fields + [T.StructField("y_true", true_type), T.StructField("y_pred", label_type),
                                            T.StructField("n", T.LongType())])
    else:
        schema = T.StructType(key_fields + [rows.schema[id_col], T.StructField("y_true", true_type),
                                            T.StructField("y_pred", label_type)])
    cols = [id_col, encode[0] if encode else vec_col] + ([label_col] if label_col else [])

    def run(batches):
        groups = bc.value
        stacked = np.vstack([g[2] for g in groups]) if groups else None
        acc: dict = {}
        for pdf in small_batches(batches, encode[0]) if encode else batches:
            if len(pdf) == 0:
                continue
            if encode:
                X = hash_vectors(pdf[encode[0]].tolist(), encode[1])
            else:
                X = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64)
            y = pdf[label_col].to_numpy() if label_col else np.zeros(len(pdf))
            if not groups:
                continue
            scores, at = X @ stacked.T, 0  # one product for all splits
            true, t_code = np.unique(y, return_inverse=True)
            for gk, labels, W, b in groups:
                best = _argmax(scores[:, at : at + len(W)] + b)
                at += len(W)
                if aggregate:
                    counts = np.bincount(t_code * len(labels) + best, minlength=len(true) * len(labels))
                    for i in np.flatnonzero(counts):
                        k = (gk, true[i // len(labels)], labels[i % len(labels)])
                        acc[k] = acc.get(k, 0) + int(counts[i])
                else:
                    pred = labels[best]
                    out = {k: [v] * len(pdf) for k, v in zip(keys, gk)}
                    out[id_col] = pdf[id_col].to_numpy()
                    out["y_true"] = y
                    out["y_pred"] = pred
                    yield pd.DataFrame(out)
        if aggregate and acc:
            recs = [dict(zip(keys, gk), y_true=t, y_pred=p, n=c) for (gk, t, p), c in acc.items()]
            yield pd.DataFrame(recs, columns=[*keys, "y_true", "y_pred", "n"])

    return rows.select(*cols).mapInPandas(run, schema)


# ---- one large training set (MLlib) ---------------------------------------------------------


def _vectors(df: DataFrame, vec_col: str):
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(vec_col)))


def mllib_logreg(train: DataFrame, label_col: str = "label", vec_col: str = "embedding", C: float = 1.0, max_iter: int = 100):
    """MLlib LR with scikit-learn's scaling: ``regParam = 1 / (n C)``, no standardisation."""
    from pyspark.ml.classification import LogisticRegression

    data = _vectors(train, vec_col).withColumn("_y", F.col(label_col).cast("double"))
    n = data.count()
    lr = LogisticRegression(featuresCol="features", labelCol="_y", regParam=1.0 / (n * C), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter)
    return lr.fit(data)


def mllib_linear_svc(train: DataFrame, label_col: str = "label", vec_col: str = "embedding", C: float = 1.0, max_iter: int = 100):
    """MLlib LinearSVC (hinge loss); more than two classes go through ``OneVsRest``."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    data = _vectors(train, vec_col).withColumn("_y", F.col(label_col).cast("double"))
    n = data.count()
    k = data.select("_y").distinct().count()
    svc = LinearSVC(featuresCol="features", labelCol="_y", regParam=1.0 / (n * C), maxIter=max_iter, standardization=False)
    if k <= 2:
        return svc.fit(data)
    return OneVsRest(classifier=svc, featuresCol="features", labelCol="_y").fit(data)


def mllib_predict(model, rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    out = model.transform(_vectors(rows, vec_col))
    return out.withColumn("y_pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def mllib_multilabel(
    train: DataFrame,
    label_cols: list[str],
    strategy: str = "one-vs-rest",
    vec_col: str = "embedding",
    C: float = 1.0,
    max_iter: int = 100,
):
    """Multi-label heads on one large set: one binary LR per label.

    ``one-vs-rest``: a constant label column yields a constant predictor; ``multi-output``: a
    constant column raises; ``classifier-chain``: label j also sees labels < j (true labels in
    fit, predicted ones in predict). Returns a list of (label, kind, model_or_constant).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if strategy not in ("one-vs-rest", "multi-output", "classifier-chain"):
        raise ValueError(f"unknown multi-label strategy {strategy!r}")
    base = _vectors(train, vec_col).persist()
    n = base.count()
    stats = base.agg(*[F.min(c).alias(f"min_{c}") for c in label_cols], *[F.max(c).alias(f"max_{c}") for c in label_cols]).first()
    models = []
    for j, c in enumerate(label_cols):
        lo, hi = stats[f"min_{c}"], stats[f"max_{c}"]
        if lo == hi:
            if strategy == "multi-output":
                raise ValueError(f"label column {c!r} has one value only")
            models.append((c, "constant", int(lo)))
            continue
        feats = "features"
        data = base
        if strategy == "classifier-chain" and j:
            feats = f"_f{j}"
            data = VectorAssembler(inputCols=["features", *label_cols[:j]], outputCol=feats).transform(base)
        lr = LogisticRegression(featuresCol=feats, labelCol="_y", regParam=1.0 / (n * C), elasticNetParam=0.0,
                                standardization=False, maxIter=max_iter)
        models.append((c, "model", lr.fit(data.withColumn("_y", F.col(c).cast("double")))))
    base.unpersist()
    return models


def mllib_multilabel_predict(models, rows: DataFrame, strategy: str, vec_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """Apply ``mllib_multilabel`` models: adds ``pred_<label>`` columns and ``pred_mask``."""
    from pyspark.ml.feature import VectorAssembler

    cur = _vectors(rows, vec_col)
    label_cols = [c for c, _, _ in models]
    for j, (c, kind, m) in enumerate(models):
        if kind == "constant":
            cur = cur.withColumn(f"pred_{c}", F.lit(m))
            continue
        feats = "features"
        if strategy == "classifier-chain" and j:
            feats = f"_f{j}"
            cur = VectorAssembler(inputCols=["features", *[f"pred_{p}" for p in label_cols[:j]]], outputCol=feats).transform(cur)
        cur = m.setFeaturesCol(feats).setPredictionCol(f"_p{j}").setRawPredictionCol(f"_r{j}").setProbabilityCol(f"_q{j}").transform(cur)
        cur = cur.withColumn(f"pred_{c}", F.col(f"_p{j}").cast("int")).drop(f"_p{j}", f"_r{j}", f"_q{j}", *([feats] if feats != "features" else []))
    mask = F.lit(0).cast("bigint")
    for i, c in enumerate(label_cols):
        mask = mask + F.col(f"pred_{c}").cast("bigint") * F.lit(1 << i)
    return cur.withColumn("pred_mask", mask).drop("features")
