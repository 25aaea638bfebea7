"""Classification metrics from a prediction table ``(split keys, y_true, y_pred)``.

Everything starts from confusion counts per split, so the only shuffle carries at most
classes^2 rows per split and map task (partial aggregation), however many predictions there are.
The class set of a split is the union of true and predicted labels (as in scikit-learn);
values are rounded to 9 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .label_sets import either, holds, is_words, label_ids

DIGITS = 9


def confusion(pred: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", n_col: str | None = None) -> DataFrame:
    """Confusion counts; ``n_col`` names a count column when the input is already aggregated."""
    n = F.count(F.lit(1)) if n_col is None else F.sum(n_col)
    return pred.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(n.cast("bigint").alias("n"))


def class_counts(pred: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", n_col: str | None = None) -> DataFrame:
    """Per (split, class): ``tp``, ``support`` (true count), ``predicted`` (predicted count)."""
    conf = confusion(pred, keys, y_true, y_pred, n_col)
    tp = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), tp.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )).alias("_c")
    return conf.select(*keys, sides).groupBy(*keys, F.col("_c.label").alias("label")).agg(
        F.sum("_c.tp").alias("tp"), F.sum("_c.support").alias("support"), F.sum("_c.predicted").alias("predicted")
    )


def f1_per_class(pred: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", n_col: str | None = None) -> DataFrame:
    """``f1 = 2 tp / (support + predicted)`` per class of true ∪ predicted."""
    cc = class_counts(pred, keys, y_true, y_pred, n_col)
    return cc.withColumn("f1", F.round(F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("predicted")), DIGITS))


def summary(pred: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", n_col: str | None = None) -> DataFrame:
    """One row per split: ``n, accuracy, macro_f1, micro_f1, weighted_f1, mcc``.

    MCC is the multi-class form ``(c s - Σ p_k t_k) / sqrt((s² - Σ p_k²)(s² - Σ t_k²))`` in DOUBLE,
    0 when the denominator is 0.
    """
    cc = class_counts(pred, keys, y_true, y_pred, n_col).withColumn(
        "_f1", F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("predicted"))
    )
    s = F.sum("support").cast("double")
    c = F.sum("tp").cast("double")
    agg = cc.groupBy(*keys).agg(
        s.alias("_s"), c.alias("_c"),
        F.avg("_f1").alias("_macro"),
        (F.sum(F.col("_f1") * F.col("support")) / s).alias("_weighted"),
        F.sum(F.col("predicted").cast("double") * F.col("support")).alias("_pt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("_pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"),
        F.sum(F.col("support").cast("double") + F.col("predicted")).alias("_tp_den"),
    )
    den = (F.col("_s") * F.col("_s") - F.col("_pp")) * (F.col("_s") * F.col("_s") - F.col("_tt"))
    mcc = F.when(den > 0, (F.col("_c") * F.col("_s") - F.col("_pt")) / F.sqrt(den)).otherwise(F.lit(0.0))
    return agg.select(
        *keys,
        F.col("_s").cast("bigint").alias("n"),
        F.round(F.col("_c") / F.col("_s"), DIGITS).alias("accuracy"),
        F.round("_macro", DIGITS).alias("macro_f1"),
        F.round(F.lit(2.0) * F.col("_c") / F.col("_tp_den"), DIGITS).alias("micro_f1"),
        F.round("_weighted", DIGITS).alias("weighted_f1"),
        F.round(mcc, DIGITS).alias("mcc"),
    )


def multilabel_counts(pred: DataFrame, keys: list[str], n_labels: int, true_mask: str = "true_mask", pred_mask: str = "pred_mask",
                      n_col: str | None = None) -> DataFrame:
    """Per (split, label): ``tp``, ``support``, ``predicted`` from bitmasks, one pass over the rows
    (3·L sums per split), then one row per label. Label sets as words are counted by label."""
    if is_words(pred, true_mask):
        return _word_counts(pred, keys, n_labels, true_mask, pred_mask, n_col)
    t, p = F.col(true_mask), F.col(pred_mask)

    w = F.lit(1) if n_col is None else F.col(n_col)

    def bit(x, i):
        return F.shiftright(x, i).bitwiseAND(F.lit(1)) * w

    aggs = []
    for i in range(n_labels):
        aggs += [
            F.sum(bit(t.bitwiseAND(p), i)).alias(f"tp{i}"),
            F.sum(bit(t, i)).alias(f"t{i}"),
            F.sum(bit(p, i)).alias(f"p{i}"),
        ]
    wide = pred.groupBy(*keys).agg(*aggs, F.sum(w).alias("_rows"),
                                   F.sum((t == p).cast("int") * w).alias("_exact"))
    per = F.explode(F.array(*[
        F.struct(F.lit(i).alias("label"), F.col(f"tp{i}").cast("bigint").alias("tp"),
                 F.col(f"t{i}").cast("bigint").alias("support"), F.col(f"p{i}").cast("bigint").alias("predicted"))
        for i in range(n_labels)
    ])).alias("_l")
    return wide.select(*keys, "_rows", "_exact", per).select(*keys, "_rows", "_exact", "_l.*")


def _word_counts(pred: DataFrame, keys: list[str], n_labels: int, true_set: str, pred_set: str, n_col: str | None) -> DataFrame:
    """``multilabel_counts`` of words: only set labels are exploded, and added up before the shuffle."""
    w = F.lit(1) if n_col is None else F.col(n_col)
    t, p = F.col(true_set), F.col(pred_set)
    rows = pred.groupBy(*keys).agg(F.sum(w).alias("_rows"), F.sum((t == p).cast("int") * w).alias("_exact"))
    every = rows.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))))
    seen = pred.select(*keys, t.alias("_t"), p.alias("_p"), w.alias("_w"), F.explode(label_ids(either(t, p))).alias("label"))
    in_t, in_p = holds(F.col("_t"), F.col("label")).cast("int"), holds(F.col("_p"), F.col("label")).cast("int")
    sums = seen.groupBy(*keys, "label").agg(
        F.sum(in_t * in_p * F.col("_w")).alias("tp"), F.sum(in_t * F.col("_w")).alias("support"), F.sum(in_p * F.col("_w")).alias("predicted"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "support", "predicted")]
    return every.join(sums, [*keys, "label"], "left").select(*keys, "_rows", "_exact", "label", *counts)


def multilabel_f1_per_label(pred: DataFrame, keys: list[str], n_labels: int, zero_division: float = 0.0,
                            true_mask: str = "true_mask", pred_mask: str = "pred_mask", n_col: str | None = None) -> DataFrame:
    cc = multilabel_counts(pred, keys, n_labels, true_mask, pred_mask, n_col)
    den = F.col("support") + F.col("predicted")
    f1 = F.when(den > 0, F.lit(2.0) * F.col("tp") / den).otherwise(F.lit(float(zero_division)))
    return cc.select(*keys, "label", "tp", "support", "predicted", F.round(f1, DIGITS).alias("f1"))


def multilabel_summary(pred: DataFrame, keys: list[str], n_labels: int, zero_division: float = 0.0,
                       true_mask: str = "true_mask", pred_mask: str = "pred_mask", n_col: str | None = None) -> DataFrame:
    """One row per split: subset ``accuracy`` and macro / micro / weighted F1 over all L labels."""
    cc = multilabel_counts(pred, keys, n_labels, true_mask, pred_mask, n_col)
    den = F.col("support") + F.col("predicted")
    f1 = F.when(den > 0, F.lit(2.0) * F.col("tp") / den).otherwise(F.lit(float(zero_division)))
    agg = cc.withColumn("_f1", f1).groupBy(*keys).agg(
        F.first("_rows").alias("_rows"), F.first("_exact").alias("_exact"),
        F.avg("_f1").alias("_macro"),
        F.sum("tp").cast("double").alias("_tp"), F.sum(den).cast("double").alias("_den"),
        F.sum(F.col("_f1") * F.col("support")).alias("_wsum"), F.sum("support").cast("double").alias("_sup"),
    )
    micro = F.when(F.col("_den") > 0, F.lit(2.0) * F.col("_tp") / F.col("_den")).otherwise(F.lit(float(zero_division)))
    weighted = F.when(F.col("_sup") > 0, F.col("_wsum") / F.col("_sup")).otherwise(F.lit(0.0))
    return agg.select(
        *keys,
        F.col("_rows").cast("bigint").alias("n"),
        F.round(F.col("_exact") / F.col("_rows"), DIGITS).alias("accuracy"),
        F.round("_macro", DIGITS).alias("macro_f1"),
        F.round(micro, DIGITS).alias("micro_f1"),
        F.round(weighted, DIGITS).alias("weighted_f1"),
    )


def result_record(summary_df: DataFrame, per_class: DataFrame, keys: list[str], metric: str,
                  names: list[str] | None = None, label_col: str = "label", f1_col: str = "f1") -> DataFrame:
    """One row per split: ``macro_f1, micro_f1, weighted_f1, metric, metric_value`` and
    ``per_class MAP<STRING, DOUBLE>`` (class name -> F1; names joined by id, never by position)."""
    metric_col = {"accuracy": "accuracy", "matthews_correlation": "mcc"}.get(metric)
    if metric_col is None or metric_col not in summary_df.columns:
        raise ValueError(f"no metric {metric!r} in this summary")
    if names is not None:
        m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
        name = F.coalesce(F.try_element_at(m, F.col(label_col)), F.col(label_col).cast("string"))
    else:
        name = F.col(label_col).cast("string")
    pc = per_class.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, F.col(f1_col)))).alias("per_class"))
    return summary_df.join(pc, keys, "left").select(
        *keys, "macro_f1", "micro_f1", "weighted_f1", F.lit(metric).alias("metric"),
        F.col(metric_col).alias("metric_value"), "per_class",
    )
