"""Metrics against hand-computed values, including the empty and missing-class cases."""

from __future__ import annotations

import math

import pytest

from fewshot_spark.operators import metrics as V


def _pred(spark, pairs):
    return spark.createDataFrame([(t, p) for t, p in pairs], "y_true int, y_pred int")


def _f1s(pairs):
    classes = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    out = {}
    for c in classes:
        tp = sum(1 for t, p in pairs if t == c and p == c)
        sup = sum(1 for t, _ in pairs if t == c)
        prd = sum(1 for _, p in pairs if p == c)
        out[c] = (2 * tp / (sup + prd), sup)
    return out


def _mcc(pairs):
    classes = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    s = len(pairs)
    c = sum(1 for t, p in pairs if t == p)
    tk = [sum(1 for t, _ in pairs if t == k) for k in classes]
    pk = [sum(1 for _, p in pairs if p == k) for k in classes]
    den = (s * s - sum(x * x for x in pk)) * (s * s - sum(x * x for x in tk))
    return 0.0 if den <= 0 else (c * s - sum(a * b for a, b in zip(pk, tk))) / math.sqrt(den)


CASES = [
    [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)],
    [(0, 0), (0, 0), (1, 0)],          # class 1 never predicted
    [(0, 0), (0, 3), (1, 1)],          # class 3 predicted, never true
    [(5, 5), (5, 5)],                  # one class: MCC undefined -> 0
]


@pytest.mark.parametrize("pairs", CASES)
def test_summary(spark, pairs):
    r = V.summary(_pred(spark, pairs), []).first()
    f1s = _f1s(pairs)
    n = len(pairs)
    acc = sum(1 for t, p in pairs if t == p) / n
    assert r["n"] == n
    assert r["accuracy"] == pytest.approx(acc)
    assert r["macro_f1"] == pytest.approx(sum(v for v, _ in f1s.values()) / len(f1s))
    assert r["micro_f1"] == pytest.approx(acc)
    assert r["weighted_f1"] == pytest.approx(sum(v * s for v, s in f1s.values()) / n)
    assert r["mcc"] == pytest.approx(_mcc(pairs))


def test_per_class_and_counts_input(spark):
    pairs = CASES[0]
    pc = {r["label"]: r["f1"] for r in V.f1_per_class(_pred(spark, pairs), []).collect()}
    assert pc == pytest.approx({k: v for k, (v, _) in _f1s(pairs).items()})
    agg = V.confusion(_pred(spark, pairs), []).withColumnRenamed("n", "cnt")
    r1 = V.summary(agg, [], n_col="cnt").first()
    r2 = V.summary(_pred(spark, pairs), []).first()
    assert r1 == r2


def test_multilabel(spark):
    rows = [(0b11, 0b01), (0b01, 0b01), (0b10, 0b00), (0b00, 0b00)]
    df = spark.createDataFrame(rows, "true_mask long, pred_mask long")
    s = V.multilabel_summary(df, [], 3).first()
    # label 0: tp 2, sup 2, pred 2 -> 1.0; label 1: tp 0, sup 2, pred 0 -> 0; label 2: none -> 0 (or 1)
    assert s["accuracy"] == pytest.approx(2 / 4)
    assert s["macro_f1"] == pytest.approx((1.0 + 0.0 + 0.0) / 3)
    assert s["micro_f1"] == pytest.approx(2 * 2 / (4 + 2))
    assert s["weighted_f1"] == pytest.approx((1.0 * 2 + 0.0 * 2) / 4)
    z = V.multilabel_summary(df, [], 3, zero_division=1.0).first()
    assert z["macro_f1"] == pytest.approx((1.0 + 0.0 + 1.0) / 3)
    empty = spark.createDataFrame([(0, 0), (0, 0)], "true_mask long, pred_mask long")
    e = V.multilabel_summary(empty, [], 2).first()
    assert e["micro_f1"] == 0.0 and e["macro_f1"] == 0.0 and e["accuracy"] == 1.0
    assert V.multilabel_summary(empty, [], 2, zero_division=1.0).first()["micro_f1"] == 1.0


def test_result_record_names_by_id(spark):
    pairs = [(0, 0), (2, 2), (2, 0)]  # class 1 absent from truth and predictions
    pred = _pred(spark, pairs)
    rec = V.result_record(V.summary(pred, []).selectExpr("1 AS k", "*"), V.f1_per_class(pred, []).selectExpr("1 AS k", "*"),
                          ["k"], "accuracy", ["a", "b", "c"]).first()
    assert set(rec["per_class"]) == {"a", "c"}
    assert rec["per_class"]["a"] == pytest.approx(2 * 1 / (1 + 2))
    assert rec["metric"] == "accuracy" and rec["metric_value"] == pytest.approx(2 / 3)
