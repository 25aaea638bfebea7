"""What a task or a shuffle holds does not grow with batches, texts, words or draws."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF001
from fewshot_spark.llm import quality as QU
from fewshot_spark.operators import cooccurrence as CO
from fewshot_spark.operators import encode as E
from fewshot_spark.operators import label_sets as LS
from fewshot_spark.plans import queries as _  # noqa: F401
from fewshot_spark.plans import q_models as Q
from fewshot_spark.session import BATCH_BYTES, prepare_session


def _brute(text, dim, max_tokens=None):
    v = np.zeros(dim)
    toks = [t for t in E._SPLIT.split((text or "").lower()) if t][:max_tokens]
    for t, n in Counter(toks).items():
        h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
        v[h(t) % dim] += n * (1 - 2 * (h("s:" + t) % 2))
    return np.round(v / np.linalg.norm(v), 6) if v.any() else v


def test_hash_vectors_of_long_texts_and_small_slices(monkeypatch):
    monkeypatch.setattr(E, "SLICE_CHARS", 7)
    monkeypatch.setattr(E, "SLICE_ROWS", 2)
    texts = ["", None, "one", " a\tb\r\nc  a ", "ΟΔΟΣ ΟΔΟΣ Straße x " * 5, "word" * 9, "x y z " * 40, None, None]
    for most in (None, 3):
        assert np.array_equal(E.hash_vectors(texts, 16, most), np.stack([_brute(t, 16, most) for t in texts]))
    cut = list(E.small_batches([pd.DataFrame({"t": texts}), pd.DataFrame({"t": []})], "t"))
    assert [t for b in cut for t in b["t"]] == texts and max(map(len, cut)) == 2


def test_hash_vectors_hold_a_bounded_part_of_the_tokens():
    text = " ".join(str(i) for i in range(900_000))
    tracemalloc.start()
    E.hash_vectors([text, text], 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6


def test_batches_of_texts_and_vectors_are_bounded(spark):
    rows = spark.range(9_000, numPartitions=1).select(
        F.col("id").alias("row_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 600).alias("text"))
    vectors = rows.select("row_id", F.array_repeat(F.col("row_id").cast("double"), 256).alias("text"))
    for df in (rows, vectors):
        def size(batches):
            for b in batches:
                yield pd.DataFrame({"n": [len(b)], "size": [sum(len(x) * (1 if isinstance(x, str) else 8) for x in b["text"])]})

        got = df.mapInPandas(size, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 9_000 and sum(r["size"] for r in got) > 4 * BATCH_BYTES
        assert max(r["size"] for r in got) < 1.2 * BATCH_BYTES


def test_batches_that_heads_sum_up_are_bounded(spark):
    """The Arrow form (``large._pass``) on vectors that a Python step made, as the heads of all rows read them."""
    texts = spark.range(6_000, numPartitions=1).select(F.col("id").alias("row_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows]), "size": pa.array([8 * len(b.column(0).flatten())])})

    got = E.encode_hash(texts, dim=256).select("embedding").mapInArrow(size, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 6_000 and sum(r["size"] for r in got) == 6_000 * 256 * 8
    assert max(r["size"] for r in got) < 1.2 * BATCH_BYTES


def test_a_session_keeps_its_own_bound_of_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1m")
        prepare_session(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_pairs_of_words_do_not_depend_on_how_words_are_sent(spark, monkeypatch):
    texts = ["a b c a", "b c d", None, "", "a a a rare", "c d b a b"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = CO.word_counts(docs, 2)
    got = []
    for most in (CO.BROADCAST_WORDS, 0):
        monkeypatch.setattr(CO, "BROADCAST_WORDS", most)
        got.append(sorted(map(tuple, CO.ppmi(CO.cooccurrence_counts(docs, words, 2)).collect())))
    assert got[0] == got[1] and not any("rare" in r[:2] for r in got[0])


def test_partners_do_not_depend_on_how_patterns_are_sent(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [i % 7, 7 + i % 3]) for i in range(60)], "row_id long, labels array<int>").select(
        "row_id", LS.label_words(F.col("labels"), 10).alias("label_words"), F.lit(0).alias("iteration"))
    for draws in (1, 2, 4):
        got = []
        for most in (LS.SENT_SPLITS, 0):
            monkeypatch.setattr(LS, "SENT_SPLITS", most)
            got.append(sorted((r.row_id, r.neg_row_id) for r in LS.disjoint_partners(rows, rows, [], 3, draws=draws).collect()))
        assert got[0] == got[1] and len(got[0]) == 60
        assert all(a % 7 != b % 7 and a % 3 != b % 3 for a, b in got[0])


def test_cosine_loss_sorts_no_pairs_with_vectors(spark, monkeypatch):
    monkeypatch.setattr(Q, "SENT_VECTORS", 0)
    plan = Q.q_cosine_similarity_loss(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_parts_of_words_end_with_texts(monkeypatch):
    monkeypatch.setattr(QU, "WORDS", 4)
    monkeypatch.setattr(QU, "LONG", 6)
    assert list(QU._parts(np.cumsum([3, 0, 1, 5, 14, 2]))) == [(0, 4), (4, 9), (9, 15), (15, 21), (21, 25)]
    assert list(QU._parts(np.cumsum([0, 0]))) == [] and list(QU._parts(np.zeros(0, np.int64))) == []
