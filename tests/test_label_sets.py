"""Label sets of any size, partners drawn without pairing label sets, uniform derangements."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fewshot_spark.operators import examples as X
from fewshot_spark.operators import label_sets as LS
from fewshot_spark.operators import metrics as V
from fewshot_spark.operators import prepare as P
from fewshot_spark.operators import sampling as M
from fewshot_spark.operators import variants as VA
from fewshot_spark.sources import readers as R


def _sets(n_rows: int, n_labels: int, seed: int, most: int = 5) -> dict[int, set[int]]:
    rng = random.Random(seed)
    # label 0 and 1 are in most sets; some rows have none, some share a label with all
    out = {i: {x for x in (0, 1) if rng.random() < 0.6} | set(rng.sample(range(2, n_labels), rng.randint(0, most))) for i in range(n_rows)}
    out[0], out[1] = set(), set(range(n_labels))
    return out


def _frame(spark, sets: dict[int, set[int]], n_labels: int):
    df = spark.createDataFrame([("s", i, sorted(v)) for i, v in sets.items()], "dataset string, row_id long, labels array<int>")
    return df.withColumn("label_words", LS.label_words(F.col("labels"), n_labels))


def test_words_hold_every_label(spark):
    sets = _sets(60, 150, 1)
    sets[2], sets[3] = {0, 59, 60, 119, 120, 149}, {59}
    df = _frame(spark, sets, 150)
    other = LS.label_words(F.array(F.lit(59), F.lit(149), F.lit(149)), 150)
    w = F.col("label_words")
    got = df.select("row_id", F.size(w).alias("n_words"), LS.label_ids(w).alias("ids"), LS.n_set(w).alias("n"), LS.is_empty(w).alias("none"),
                    LS.disjoint(w, other).alias("free"), LS.holds(w, F.lit(120)).alias("has"),
                    LS.label_ids(LS.both(w, other)).alias("both"), LS.label_ids(LS.either(w, other)).alias("either")).collect()
    for r in got:
        s = sets[r.row_id]
        assert r.n_words == 3 and r.ids == sorted(s) and r.n == len(s) and r.none == (not s) and r.has == (120 in s)
        assert r.free == (not s & {59, 149}) and r.both == sorted(s & {59, 149}) and r.either == sorted(s | {59, 149})


@pytest.mark.parametrize("n_labels,draws", [(12, 1), (70, 1), (70, 8)])
def test_partners_are_disjoint_and_complete(spark, n_labels, draws):
    sets = _sets(250, n_labels, n_labels + draws)
    rows = _frame(spark, sets, n_labels)
    got = LS.disjoint_partners(X.repeat_iterations(rows, 2), rows, ["dataset"], 3, draws=draws).collect()
    assert all(not sets[r.row_id] & sets[r.neg_row_id] for r in got)
    want = {(i, it) for i, s in sets.items() for it in (0, 1) if any(not s & o for o in sets.values())}
    assert Counter((r.row_id, r.iteration) for r in got) == Counter(want)


@pytest.mark.parametrize("draws", [1, 8])
def test_partners_are_uniform(spark, draws):
    """Label 0 to 8 leave some hot, some not; the admissible rows of one example are drawn alike."""
    sets = {0: {0, 9}, 1: {9}, 2: {9, 10}, 3: {0}, 4: {1}, 5: {2, 11}, 6: {3}, 7: set(), 8: {4, 10}, 9: {4, 10}}
    sets |= {10 + i: {0, i % 9} for i in range(30)}
    rows = _frame(spark, sets, 12)
    ex = X.repeat_iterations(rows.where("row_id = 0"), 4000)
    got = Counter(r.neg_row_id for r in LS.disjoint_partners(ex, rows, ["dataset"], 7, draws=draws).collect())
    free = {i for i, s in sets.items() if not s & sets[0]}
    assert set(got) == free and sum(got.values()) == 4000
    mean = 4000 / len(free)
    assert sum((n - mean) ** 2 / mean for n in got.values()) < 35  # chi-square, 6 degrees of freedom


def test_partners_odd_input(spark):
    rows = _frame(spark, {1: {0}, 2: {1}, 3: {0, 1}}, 2)
    odd = rows.unionByName(spark.createDataFrame([("s", 9, None), ("s", None, [1])], "dataset string, row_id long, labels array<int>")
                           .withColumn("label_words", LS.label_words(F.col("labels"), 2)))
    ex = X.repeat_iterations(odd.where("row_id is not null"), 3)
    got = {(r.row_id, r.neg_row_id) for r in LS.disjoint_partners(ex, odd, ["dataset"], 0).collect()}
    assert got == {(1, 2), (2, 1)}
    with pytest.raises(ValueError, match="no disjoint-label partner"):
        LS.disjoint_partners(ex, odd, ["dataset"], 0, on_empty="raise")
    none = odd.where("false")
    assert LS.disjoint_partners(X.repeat_iterations(none, 2), none, ["dataset"], 0).count() == 0
    no_keys = LS.disjoint_partners(X.repeat_iterations(rows, 2), rows, [], 0)
    assert {(r.row_id, r.neg_row_id) for r in no_keys.collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("n_labels", [28, 70])
def test_exact_partners_keep_no_pairs_of_sets(spark, monkeypatch, n_labels):
    """The exact way keeps a row per asked set and block, and finds the same partners however the
    sets are cut into blocks and the asks into pieces."""
    sets = _sets(300, n_labels, 11, 9)
    rows = _frame(spark, sets, n_labels)
    kept, got, bins = [], [], LS._bins

    def counted(parts, keys, part):
        if part != "_pat":
            kept.append(parts.count())
        return bins(parts, keys, part)

    monkeypatch.setattr(LS, "_bins", counted)
    for bits, asks in ((LS.BLOCK_BITS, LS.ASKS_PER_TASK), (3, 7)):
        monkeypatch.setattr(LS, "BLOCK_BITS", bits)
        monkeypatch.setattr(LS, "ASKS_PER_TASK", asks)
        found = LS.disjoint_partners(X.repeat_iterations(rows, 2), rows, ["dataset"], 1, draws=1).collect()
        got.append(sorted((r.row_id, r.iteration, r.neg_row_id) for r in found))
    distinct = {frozenset(s) for s in sets.values()}
    pairs = sum(not a & b for a in distinct for b in distinct)
    assert 0 < kept[0] <= len(distinct) < pairs / 3
    assert got[0] == got[1] and all(not sets[a] & sets[b] for a, _, b in got[0])


def test_draws_need_no_cross_join(spark):
    """Neither the hints of a small table nor a constant split key may turn a join into a product."""
    sets = _sets(300, 28, 5)
    rows = _frame(spark, sets, 28)
    out = LS.disjoint_partners(X.repeat_iterations(rows, 2), rows, ["dataset"], 1, draws=1)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_many_flags_from_reader_to_examples(spark):
    n = 70
    sets = _sets(80, n, 11, most=3)
    names = [f"f{i}" for i in range(n)]
    flat = spark.createDataFrame([(i, f"text {i}", *[int(j in s) for j in range(n)]) for i, s in sets.items()],
                                 "row_id long, text string, " + ", ".join(f"{c} int" for c in names))
    rows = R.read_multilabel(flat, names, "text", "row_id")
    assert LS.is_words(rows, "label_mask")
    assert P.filter_has_label(rows).count() == sum(bool(s) for s in sets.values())
    split = M.fewshot_sample_multilabel(rows, names, 2, 0).withColumn("dataset", F.lit("s"))
    drawn = {r.row_id for r in split.collect()}
    assert drawn and all(sets[i] for i in drawn)
    trip = X.gen_triplets_multilabel(split, "about ", names, names, 2, 0, ["dataset"], on_empty="skip").collect()
    assert trip and all(not sets[r.row_id] & sets[r.neg_row_id] for r in trip)
    assert all(r.anchor == "about " + ", ".join(f"f{j}" for j in sorted(sets[r.row_id])) for r in trip)
    assert all(r.negative == f"text {r.neg_row_id}" for r in trip)
    pairs = X.gen_pairs_multilabel(split, names, 2, 0, ["dataset"]).collect()
    free = {i for i in drawn if any(not sets[i] & sets[o] for o in drawn)}
    assert {r.row_id for r in pairs} == free
    for r in pairs:
        shared = sets[r.row_id] & sets[r.other_row_id]
        assert (r.label_id in shared) if r.target == 1.0 else not shared
    assert sum(r.target == 1.0 for r in pairs) == sum(2 * len(sets[i]) for i in free)


def test_word_metrics_equal_mask_metrics(spark):
    a, b = _sets(90, 40, 2), _sets(90, 40, 3)
    rows = [(i % 2, sorted(a[i]), sorted(b[i] | (a[i] if i % 3 else set())), sum(1 << x for x in a[i]),
             sum(1 << x for x in b[i] | (a[i] if i % 3 else set()))) for i in a]
    df = spark.createDataFrame(rows, "k int, t array<int>, p array<int>, true_mask long, pred_mask long")
    words = df.select("k", LS.label_words(F.col("t"), 40).alias("true_mask"), LS.label_words(F.col("p"), 40).alias("pred_mask"))
    for zero in (0.0, 1.0):
        one = {tuple(r) for r in V.multilabel_summary(df, ["k"], 40, zero).collect()}
        two = {tuple(r) for r in V.multilabel_summary(words, ["k"], 40, zero).collect()}
        assert one == two and len(one) == 2
        per = [{tuple(r) for r in V.multilabel_f1_per_label(d, ["k"], 40, zero).collect()} for d in (df, words)]
        assert per[0] == per[1] and len(per[0]) == 80


def test_masks_take_the_draws_when_told(spark):
    sets = _sets(120, 62, 9)
    rows = spark.createDataFrame([("s", i, f"t{i}", sum(1 << x for x in s)) for i, s in sets.items()],
                                 "dataset string, row_id long, text string, label_mask long")
    got = X.disjoint_negative(X.repeat_iterations(rows, 2), rows, ["dataset"], 0, method="draws").collect()
    assert {r.row_id for r in got} == {i for i, s in sets.items() if any(not s & o for o in sets.values())}
    assert all(not sets[r.row_id] & sets[r.neg_row_id] and r.negative == f"t{r.neg_row_id}" for r in got)


def test_derangements_are_uniform(spark):
    """All 9 derangements of 4 names occur, about equally often; 2 names swap; 1 name raises."""
    groups = 1800
    labels = spark.range(groups).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("label_id")).withColumn(
        "label_name", F.concat(F.lit("n"), F.col("label_id").cast("string")))
    shown = VA.derange_labels(labels, ["g"], 3).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("label_id", "shown_name"))).alias("s")).collect()
    seen = Counter(tuple(int(x.shown_name[1:]) for x in r.s) for r in shown)
    assert sum(seen.values()) == groups and len(seen) == 9
    assert all(sorted(p) == [0, 1, 2, 3] and all(i != x for i, x in enumerate(p)) for p in seen)
    assert sum((n - groups / 9) ** 2 / (groups / 9) for n in seen.values()) < 30  # 8 degrees of freedom
    two = VA.derange_labels(labels.where("g = 0 and label_id < 2"), ["g"], 0).collect()
    assert {r.label_id: r.shown_name for r in two} == {0: "n1", 1: "n0"}
    with pytest.raises(ValueError, match="single label"):
        VA.derange_labels(labels.where("label_id = 0"), ["g"], 0)
    # without a single try left every group takes the cycle, and no name stays
    assert VA.derange_labels(labels.where("g < 5"), ["g"], 0, tries=1).where("label_name = shown_name or shown_name is null").count() == 0
