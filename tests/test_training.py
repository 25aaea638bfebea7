"""Adapter, heads and encoders: losses fall, heads beat the majority class, the two encoder
forms agree, multi-label head rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fewshot_spark.operators import adapter as AD
from fewshot_spark.operators import encode as E
from fewshot_spark.operators import examples as X
from fewshot_spark.operators import heads as HD
from fewshot_spark.operators import losses as L
from fewshot_spark.operators import metrics as V
from fewshot_spark.operators import sampling as M
from fewshot_spark.sources import readers as R

SPLIT = ["sample_size", "seed_idx"]


def test_encoders_agree(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    extra = spark.createDataFrame([(-1, ""), (-2, None), (-3, "  \t\n "), (-4, "Ärger ÄRGER ärger word")], "row_id long, text string")
    src = docs.unionByName(extra)
    a = E.encode_hash(src, method="map")
    b = E.encode_hash(src, method="sql")
    assert a.count() == b.count() == docs.count() + 4
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    zero = {r.row_id: r.embedding for r in a.where("row_id < 0").collect()}
    assert all(v == 0.0 for v in zero[-1]) and all(v == 0.0 for v in zero[-3])
    assert abs(sum(x * x for x in zero[-4]) - 1.0) < 1e-5


def test_truncation(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)))], "row_id long, text string")
    full = E.encode_hash(df, dim=64).first().embedding
    cut = E.encode_hash(df, dim=64, max_tokens=256).first().embedding
    cut_sql = E.encode_hash(df, dim=64, max_tokens=256, method="sql").first().embedding
    assert cut == cut_sql and cut != full


def test_l2_normalize_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    out = [r.n for r in df.select(E.l2_normalize("v").alias("n")).collect()]
    assert out == [[0.0, 0.0], [0.6, 0.8]]


def _em_triplets(spark, iters=3):
    rows = R.embeddings_labelled(spark, SF01).withColumn("dataset", F.lit("e"))
    laid = X.lay_out(rows.select("dataset", "row_id", "label"), ["dataset"], "label")
    trip = X.negative_sample(X.repeat_iterations(laid, iters), laid, ["dataset"], 0, out_text=None)
    cents = L.mean_vectors(rows, ["label"], out="a")
    vecs = rows.select("row_id", "embedding")
    return (trip.select("row_id", "label", "neg_row_id").join(F.broadcast(cents), "label")
            .join(vecs.withColumnRenamed("embedding", "p"), "row_id")
            .join(vecs.select(F.col("row_id").alias("neg_row_id"), F.col("embedding").alias("n")), "neg_row_id"))


def test_adapter_loss_falls_and_partition_invariant(spark):
    ex = _em_triplets(spark).select("a", "p", "n").persist()
    W, hist = AD.fit_adapter(ex, "triplet", steps=6, lr=2.0, partitions=4)
    after = AD.adapter_loss(ex, W, "triplet")
    assert after < hist[0]
    W2, _ = AD.fit_adapter(ex.repartition(2), "triplet", steps=6, lr=2.0)
    assert np.allclose(W, W2, atol=1e-9)
    # the loss of the identity map equals the SQL triplet loss
    sql = L.triplet_loss(ex.withColumn("g", F.lit(1)), ["g"], "a", "p", "n").first()["loss"]
    assert hist[0] == pytest.approx(sql, abs=1e-6)


def test_cosine_adapter_loss_falls(spark):
    rows = R.embeddings_labelled(spark, SF01).withColumn("dataset", F.lit("e"))
    laid = X.lay_out(rows.select("dataset", "row_id", "label"), ["dataset"], "label")
    ex = X.repeat_iterations(laid, 2)
    pos = X.positive_sample(ex, laid, ["dataset"], 0, out_id="o", out_text=None).withColumn("target", F.lit(1.0))
    neg = X.negative_sample(ex, laid, ["dataset"], 0, out_id="o", out_text=None).withColumn("target", F.lit(0.0))
    vecs = rows.select("row_id", "embedding")
    pairs = pos.select("row_id", "o", "target").unionByName(neg.select("row_id", "o", "target"))
    data = pairs.join(vecs.withColumnRenamed("embedding", "u"), "row_id").join(
        vecs.select(F.col("row_id").alias("o"), F.col("embedding").alias("v")), "o").persist()
    W, hist = AD.fit_adapter(data, "cosine", steps=5, lr=1.0, partitions=4)
    assert AD.adapter_loss(data, W, "cosine") < hist[0]


def test_split_heads_beat_majority(spark):
    rows = R.embeddings_labelled(spark, SF01)
    train = M.fewshot_grid(rows, [32], [0, 1])
    for head in ("logistic_regression", "LinearSVC", "centroid"):
        w = HD.fit_heads_per_split(train, SPLIT, head)
        conf = HD.predict(rows, w, SPLIT, aggregate=True)
        s = V.summary(conf, SPLIT, n_col="n").collect()
        majority = rows.groupBy("label").count().agg(F.max("count")).first()[0] / rows.count()
        assert all(r["accuracy"] > majority for r in s), (head, s)


def test_predict_aggregate_equals_rows(spark):
    rows = R.embeddings_labelled(spark, SF01)
    w = HD.fit_centroids(M.fewshot_grid(rows, [8, 16], [0]), SPLIT)
    a = V.summary(HD.predict(rows, w, SPLIT, aggregate=True), SPLIT, n_col="n")
    b = V.summary(HD.predict(rows, w, SPLIT), SPLIT)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_logreg_np_separable():
    rng = np.random.default_rng(0)
    X0 = rng.normal(size=(40, 5)) + 3
    X1 = rng.normal(size=(40, 5)) - 3
    X = np.vstack([X0, X1])
    y = np.array([0] * 40 + [1] * 40)
    W, b = HD.fit_logreg_np(X, y, np.array([0, 1]))
    assert (np.argmax(X @ W.T + b, axis=1) == y).mean() == 1.0
    y3 = np.array([0] * 27 + [1] * 27 + [2] * 26)
    W3, b3 = HD.fit_logreg_np(X, y3, np.array([0, 1, 2]))
    assert W3.shape == (3, 5)


def test_multilabel_heads(spark):
    base = R.documents_multilabel(spark, SF01)
    enc = E.encode_hash(base.select("row_id", "text"), dim=64)
    data = base.join(enc, "row_id").withColumn("const", F.lit(1))
    models = HD.mllib_multilabel(data, ["quality", "toxic", "const"], "one-vs-rest", max_iter=20)
    assert models[2][1] == "constant"
    pred = HD.mllib_multilabel_predict(models, data, "one-vs-rest")
    assert pred.where("pred_const <> 1").count() == 0
    with pytest.raises(ValueError):
        HD.mllib_multilabel(data, ["quality", "const"], "multi-output", max_iter=5)
    chain = HD.mllib_multilabel(data, ["quality", "toxic"], "classifier-chain", max_iter=10)
    out = HD.mllib_multilabel_predict(chain, data, "classifier-chain")
    assert out.where("pred_mask < 0 OR pred_mask > 3").count() == 0


def test_mllib_logreg_and_svc(spark):
    rows = R.embeddings_labelled(spark, SF01)
    train = M.fewshot_sample(rows, 32, 0)
    for fit in (HD.mllib_logreg, HD.mllib_linear_svc):
        m = fit(train, max_iter=20)
        pred = HD.mllib_predict(m, rows).select(F.col("label").alias("y_true"), "y_pred")
        assert V.summary(pred, []).first()["accuracy"] > 0.1


def test_other_encoders(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text").limit(200)
    tf = E.encode_hashing_tf(docs, dim=32).collect()
    assert len(tf) == 200 and all(len(r.embedding) == 32 for r in tf)
    norms = [sum(x * x for x in r.embedding) for r in tf]
    assert all(abs(n - 1.0) < 1e-6 or n == 0.0 for n in norms)
    w2v, model = E.encode_word2vec(docs, dim=8)
    assert w2v.count() == 200 and model.getVectors().count() > 0

    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=float)

    user = {r.row_id: r.embedding for r in E.encode_with_model(docs, factory, 2).collect()}
    one = docs.first()
    assert user[one.row_id] == [float(len(one.text)), float(one.text.count(" "))]


def test_predict_beyond_broadcast_bound(spark, monkeypatch):
    rows = R.embeddings_labelled(spark, SF01)
    w = HD.fit_centroids(M.fewshot_grid(rows, [8, 16], [0, 1]), SPLIT).persist()
    whole = sorted(map(tuple, HD.predict(rows, w, SPLIT, aggregate=True).collect()))
    for bound, n in ((10 * 64 * 2, 2), (1, 4)):  # two splits per chunk; every split over the bound
        monkeypatch.setattr(HD, "MAX_BROADCAST_WEIGHTS", bound)
        assert len(HD.weight_chunks(w, SPLIT)) == n
        assert sorted(map(tuple, HD.predict(rows, w, SPLIT, aggregate=True).collect())) == whole


def test_fits_do_not_depend_on_arrow_batches(spark):
    """Examples and rows that arrive in many small batches give the same heads and records."""
    from fewshot_spark.config import RunConfig
    from fewshot_spark.plans import runs as RN
    from fewshot_spark.sources import catalogue as C

    base = R.documents_multilabel(spark, SF01, six=True)
    parts = M.fraction_split(base, 0.75, 42)
    spec = C.spec("documents_flags6")
    ds = RN.LabelledSet("six", parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split"),
                        list(spec.labels), spec.template, "accuracy", C.FLAGS6)
    cfg = RunConfig(kind="multilabel", loss="TripletLoss", sample_sizes=(4,), seeds_num=2, num_iterations=2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    out = []
    for n in ("10000", "5"):
        spark.conf.set(key, n)
        rec = RN.run_fewshot_multilabel(spark, cfg, [ds], write=False).collect()
        out.append(sorted((r.seed_idx, r.macro_f1, r.metric_value) for r in rec))
        spark.catalog.clearCache()
    spark.conf.unset(key)
    assert out[0] == out[1] and len(out[0]) == 2


def test_fit_row_bound(spark):
    from fewshot_spark.plans import grid as G

    rows = M.fewshot_grid(R.embeddings_labelled(spark, SF01), [16], [0, 1])
    got = G.bounded_rows(rows, SPLIT, 25, 3)
    assert {r["count"] for r in got.groupBy(*SPLIT).count().collect()} == {25}
    assert sorted(r.row_id for r in got.collect()) == sorted(r.row_id for r in G.bounded_rows(rows.repartition(9), SPLIT, 25, 3).collect())
    assert G.bounded_rows(rows, SPLIT, None, 3).count() == rows.count()


def test_fused_encode_predict(spark):
    dl = R.documents_labelled(spark, SF01)
    train = M.fewshot_grid(dl, [8, 16], [0])
    enc = E.encode_hash(dl.select("row_id", "text"), dim=64)
    w = HD.fit_heads_per_split(train.select(*SPLIT, "row_id", "label").join(enc, "row_id"), SPLIT)
    a = HD.predict(dl.select("row_id", "label").join(enc, "row_id"), w, SPLIT, aggregate=True)
    b = HD.predict(dl.select("row_id", "text", "label"), w, SPLIT, aggregate=True, encode=("text", 64))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_adapter_tree_reduction(spark, monkeypatch):
    ex = _em_triplets(spark, iters=1).select("a", "p", "n").persist()
    W1, h1 = AD.fit_adapter(ex, "triplet", steps=3, lr=2.0, partitions=9)
    monkeypatch.setattr(AD, "DIRECT_PARTIALS", 1)  # force the sqrt(p) tree
    W2, h2 = AD.fit_adapter(ex, "triplet", steps=3, lr=2.0, partitions=9)
    assert np.allclose(W1, W2, atol=1e-9) and np.allclose(h1, h2, atol=1e-12)


def test_heads_reach_the_optimum():
    """Every entry of the objective's gradient is at most 1e-4 at the returned weights."""
    rng = np.random.default_rng(3)
    for n, k, d in ((60, 2, 20), (640, 10, 64), (2000, 10, 64), (30, 3, 5)):
        X = rng.standard_normal((n, d))
        X /= np.linalg.norm(X, axis=1, keepdims=True)
        y = rng.integers(0, k, n)
        W, b = HD.fit_logreg_np(X, y, np.arange(k))
        if k == 2:
            w, c = W[1] - W[0], b[1] - b[0]
            p = 1 / (1 + np.exp(-(X @ w + c)))
            g = np.concatenate([X.T @ (p - y) + w, [np.sum(p - y)]])
        else:
            Z = X @ W.T + b
            P = np.exp(Z - Z.max(1, keepdims=True))
            P /= P.sum(1, keepdims=True)
            G = P - np.eye(k)[y]
            g = np.concatenate([(G.T @ X + W).ravel(), G.sum(0)])
        assert np.abs(g).max() < 1e-4
        Ws, bs = HD.fit_linear_svc_np(X, y, np.arange(k))
        t = np.where(y == 1, 1.0, -1.0)
        w = np.append(Ws[1] - Ws[0], bs[1] - bs[0]) if k == 2 else np.append(Ws[1], bs[1])
        Xb = np.hstack([X, np.ones((n, 1))])
        assert np.abs(w - 2 * Xb.T @ (t * np.maximum(1 - t * (Xb @ w), 0))).max() < 1e-4
