"""Fits on partial sums against the per-split solvers, and splits beyond the streaming bound."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewshot_spark.config import RunConfig, settings_key
from fewshot_spark.operators import adapter as AD
from fewshot_spark.operators import heads as HD
from fewshot_spark.operators import large as LG
from fewshot_spark.plans import grid as G
from fewshot_spark.plans import results as RS
from fewshot_spark.plans import runs as RN


def table(spark, X, cols, names):
    rows = [(i, X[i].tolist(), *(int(c[i]) for c in cols)) for i in range(len(X))]
    return spark.createDataFrame(rows, f"row_id long, embedding array<double>, {', '.join(f'{n} int' for n in names)}").repartition(2)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    X = rng.standard_normal((400, 5))
    y = np.argmax(X[:, :3] + rng.standard_normal((400, 3)), axis=1) * 3 + 2  # labels 2, 5, 8
    flags = [(X[:, j] + rng.standard_normal(400) > 0.2).astype(int) for j in range(4)]
    return X, y, flags


@pytest.mark.parametrize("two", [True, False])
def test_single_label_fits_equal_the_split_solvers(spark, data, two):
    X, y, _ = data
    if two:
        X, y = X[y != 5], y[y != 5]
    df = table(spark, X, [y], ["label"])
    classes = np.unique(y)
    for fit, plain in ((LG.fit_logreg, HD.fit_logreg_np), (LG.fit_linear_svc, HD.fit_linear_svc_np)):
        got, (W, b) = fit(df), plain(X, y, classes)
        assert got[0].tolist() == classes.tolist()
        assert np.abs(got[1] - W).max() < 1e-5 and np.abs(got[2] - b).max() < 1e-5


@pytest.mark.parametrize("strategy", ["one-vs-rest", "multi-output", "classifier-chain"])
def test_all_labels_in_one_fit(spark, data, strategy):
    X, _, flags = data
    names = [f"f{j}" for j in range(4)]
    df = table(spark, X, flags, names)
    heads, passes = LG.fit_multilabel(df, names, strategy)
    for j, h in enumerate(heads):
        feats = np.hstack([X, np.stack(flags[:j], axis=1)]) if strategy == "classifier-chain" and j else X
        w, b = HD.fit_binary_np(feats, flags[j])
        assert np.abs(np.concatenate([h.w, h.chain]) - w).max() < 1e-5 and abs(h.b - b) < 1e-5
    if strategy == "one-vs-rest":
        one = [LG.fit_multilabel(df, [n], strategy)[1] for n in names[:2]]
        assert passes < 2 * max(one)


def test_constant_labels(spark, data):
    X, _, flags = data
    df = table(spark, X, [flags[0], np.ones(len(X)), np.zeros(len(X))], ["a", "ones", "zeros"])
    heads, _ = LG.fit_multilabel(df, ["a", "ones", "zeros"])
    assert [h.constant for h in heads] == [None, 1, 0]
    with pytest.raises(ValueError, match="ones"):
        LG.fit_multilabel(df, ["a", "ones"], "multi-output")
    assert [h.constant for h in LG.fit_multilabel(df, ["ones"])[0]] == [1]
    with pytest.raises(ValueError):
        LG.fit_logreg(df.limit(0).withColumn("label", F.lit(1)))


def test_sums_are_added_in_spark_beyond_the_bound(spark, data, monkeypatch):
    X, y, _ = data
    monkeypatch.setattr(LG, "DIRECT_SUMS", 2)
    df = table(spark, X, [y], ["label"]).repartition(11)
    _, W, b = LG.fit_linear_svc(df)
    want, c = HD.fit_linear_svc_np(X, y, np.unique(y))
    assert np.abs(W - want).max() < 1e-5 and np.abs(b - c).max() < 1e-5


def test_certificate_sees_the_gradient(spark, data):
    X, y, flags = data
    df = table(spark, X, flags[:2], ["a", "b"])
    rows = df.select("row_id", "embedding", F.array("a", "b").alias("labels"))
    heads = LG.multilabel_weights(spark, LG.fit_multilabel(df, ["a", "b"], "classifier-chain")[0])
    got = LG.gradient_sizes(rows, heads, "logistic").collect()
    assert {(r.label, r.n_rows, r.positives) for r in got} == {(j, 400, int(flags[j].sum())) for j in (0, 1)}
    assert max(r.gradient for r in got) < 2 * HD.GRADIENT_TOL
    moved = heads.withColumn("bias", F.col("bias") + 0.01)
    assert min(r.gradient for r in LG.gradient_sizes(rows, moved, "logistic").collect()) > 0.01


def split_rows(spark, sizes, d=6, seed=3):
    """Rows, triplet and pair examples (with batch ids) of splits of some sizes, and anchors."""
    rng = np.random.default_rng(seed)
    rows, trip, pairs = [], [], []
    for k, n in enumerate(sizes):
        X, y = rng.standard_normal((n, d)), np.arange(n) % 3
        X[:, 0] += y
        rows += [(k, i, int(y[i]), int(y[i] > 0), int(i % 4 == 0), X[i].tolist()) for i in range(n)]
        for e in range(3 * n):
            i, j = int(rng.integers(n)), int(rng.integers(n))
            trip.append((k, e // 40, e, i, j, int(y[i])))
            pairs.append((k, e // 40, e, i, j, float(y[i] == y[j])))
    rows = spark.createDataFrame(rows, "split int, row_id long, label int, a int, b int, embedding array<double>")
    trip = spark.createDataFrame(trip, "split int, batch_id int, e int, row_id long, other_row_id long, anchor_key int")
    pairs = spark.createDataFrame(pairs, "split int, batch_id int, e int, row_id long, other_row_id long, target double")
    return rows, trip, pairs, {k: rng.standard_normal(d) for k in range(3)}


def weights_of(df):
    return {(r.split, r.label): np.array([*r.weights, *(r.chain if "chain" in df.columns else []), r.bias]) for r in df.collect()}


@pytest.mark.parametrize("optimizer", ["sgd", "adamw"])
@pytest.mark.parametrize("loss", ["triplet", "cosine"])
def test_large_splits_train_like_streamed_ones(spark, loss, optimizer):
    rows, trip, pairs, anchors = split_rows(spark, [30, 90])
    ex = trip if loss == "triplet" else pairs
    one = {"loss": loss, "lr": 0.05, "optimizer": optimizer}
    streamed = weights_of(G.train_splits(rows, ex, ["split"], anchors, **one))
    routed = weights_of(G.train_splits(rows, ex, ["split"], anchors, stream_rows=50, **one))
    assert set(streamed) == set(routed) == {(s, c) for s in (0, 1) for c in range(3)}
    for k, w in streamed.items():
        assert np.abs(w - routed[k]).max() < 1e-4 * max(1, np.abs(w).max()) if k[0] else (w == routed[k]).all()


@pytest.mark.parametrize("head", ["logistic_regression", "LinearSVC", "centroid"])
def test_large_heads_equal_streamed_heads(spark, head):
    rows, trip, _, anchors = split_rows(spark, [80])
    streamed, routed = (weights_of(G.train_splits(rows, trip, ["split"], anchors, head=head, use_adapter=False, stream_rows=n)) for n in (None, 10))
    assert max(np.abs(w - routed[k]).max() for k, w in streamed.items()) < 1e-5


@pytest.mark.parametrize("strategy,head", [("one-vs-rest", "logistic_regression"), ("classifier-chain", "logistic_regression"), ("classifier-chain", "centroid")])
def test_large_multilabel_splits_equal_streamed_ones(spark, strategy, head):
    rows, trip, _, anchors = split_rows(spark, [20, 70])
    one = {"strategy": strategy, "head": head, "lr": 0.05}
    streamed, routed = (weights_of(G.train_splits_multilabel(rows, trip, ["split"], ["a", "b"], anchors, stream_rows=n, **one)) for n in (None, 40))
    assert set(streamed) == set(routed)
    assert max(np.abs(w - routed[k]).max() for k, w in streamed.items()) < 1e-4


def test_examples_without_batches_get_a_bounded_number_of_steps(spark):
    rows, trip, _, anchors = split_rows(spark, [60])
    ex = G.with_batch_key(trip.drop("batch_id").withColumnRenamed("e", "iteration"), ["split"], 0, ["iteration", "row_id"])
    got = weights_of(G.train_splits(rows, ex, ["split"], anchors, stream_rows=10, max_steps=3, lr=0.05))
    again = weights_of(G.train_splits(rows.repartition(7), ex.repartition(5), ["split"], anchors, stream_rows=10, max_steps=3, lr=0.05))
    assert set(got) == {(0, c) for c in range(3)} and max(np.abs(w - again[k]).max() for k, w in got.items()) < 1e-4


def test_adamw_steps_equal_brute_force():
    rng = np.random.default_rng(1)
    run, W, m, v = AD.Steps(4, 10, 0.1, "adamw", 0.02), np.eye(4), 0, 0
    for t in range(10):
        g = rng.standard_normal((4, 4))
        run.take(g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        W = W - AD.lr_at(t, 10, 0.1) * (m / (1 - 0.9 ** (t + 1)) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8) + 0.02 * (W - np.eye(4)))
    assert np.allclose(run.W, W, atol=1e-12)


def test_no_task_holds_a_large_split(spark):
    """The relabel run over all rows has no window over the train table and no task per split."""
    rows, _, _, _ = split_rows(spark, [500])
    plan = G.bounded_rows(rows, ["split"], 100, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert G.bounded_rows(rows, ["split"], 100, 3).count() == 100


# resume


def plain(folder, splits_per_commit=9, **other):
    return RunConfig(loss="TripletLoss", classifier="centroid", use_adapter=False, num_iterations=1, sample_sizes=(2, 3), seeds_num=2,
                     results_dir=str(folder), splits_per_commit=splits_per_commit, **other)


def small_set(spark):
    rows = [(i, f"word{i % 7} text{i % 3} {'good' if i % 2 else 'bad'}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    return RN.LabelledSet("toy", df.where("row_id < 30"), df.where("row_id >= 30"), ["bad", "good"], "This is ")


def test_other_settings_run_again_beside_the_old_records(spark, tmp_path):
    ds = small_set(spark)
    first = RN.run_fewshot(spark, plain(tmp_path), [ds])
    assert first.count() == 4 and RN.run_fewshot(spark, plain(tmp_path), [ds]).count() == 0
    assert RN.run_fewshot(spark, plain(tmp_path, encoder_dim=32), [ds]).count() == 4
    stored = RS.read_results(spark, str(tmp_path))
    assert stored.count() == 8 and stored.select("settings").distinct().count() == 2 and stored.select("run_id").distinct().count() == 1
    wider = replace(plain(tmp_path), sample_sizes=(2, 3, 4), checkpoint_intermediates=True)
    assert sorted(r.sample_size for r in RN.run_fewshot(spark, wider, [ds]).collect()) == [4, 4]


def test_every_setting_counts_unless_it_is_named():
    base = RunConfig()
    assert settings_key(replace(base, results_dir="x", sample_sizes=(4,), override_results=True)) == settings_key(base)
    changed = {"adapter_lr": 0.1, "use_adapter": False, "encoder_dim": 8, "draw_seed": 1, "max_seq_length": 9, "max_fit_rows": 5,
               "multi_target_strategy": "multi-output", "on_empty": "raise", "optimizer": "adamw", "stream_rows": 1, "max_large_steps": 2}
    keys = {settings_key(replace(base, **{k: v})) for k, v in changed.items()} | {settings_key(base)}
    assert len(keys) == len(changed) + 1


def test_a_killed_run_keeps_its_finished_pieces(spark, tmp_path, monkeypatch):
    ds, real, calls = small_set(spark), RN._single_records, []

    def dies(*args):
        calls.append(args[-1])
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(*args)

    monkeypatch.setattr(RN, "_single_records", dies)
    with pytest.raises(RuntimeError, match="killed"):
        RN.run_fewshot(spark, plain(tmp_path, 1), [ds])
    monkeypatch.setattr(RN, "_single_records", real)
    assert RS.read_results(spark, str(tmp_path)).count() == 2
    assert RN.run_fewshot(spark, plain(tmp_path), [ds]).count() == 2
    assert RS.read_results(spark, str(tmp_path)).count() == 4
