"""Co-occurrence counts, PPMI and its factors against brute force in numpy."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF001
from fewshot_spark.operators import cooccurrence as CO

SCHEMA = "row_id long, text string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    return [*made, None, "", "  ", "w1", "w1 w1 W1", made[0], made[0]]


def brute(texts, window, min_count):
    docs = [(t or "").lower().split() for t in texts]
    n_tokens = Counter(w for d in docs for w in d)
    known = {w for w, n in n_tokens.items() if n >= min_count}
    met = Counter((d[i], d[j]) for d in docs for i in range(len(d)) for j in range(len(d))
                  if i != j and abs(i - j) <= window and d[i] in known and d[j] in known)
    tot = Counter()
    for (a, _), n in met.items():
        tot[a] += n
    total = sum(tot.values())
    score = {(a, b): max(0.0, math.log(n * total / (tot[a] * tot[b]))) for (a, b), n in met.items()}
    return {w: n for w, n in n_tokens.items() if w in known}, met, score


def test_counts_and_ppmi(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    n_tokens, met, score = brute(texts, 3, 4)
    words = CO.word_counts(docs, 4)
    assert {r.word: r.n_tokens for r in words.collect()} == n_tokens
    rows = CO.ppmi(CO.cooccurrence_counts(docs, words, 3)).collect()
    assert len(rows) == len(met)
    for r in rows:
        assert r.n == met[r.word, r.context]
        assert r.ppmi == pytest.approx(score[r.word, r.context], abs=1e-12)


def test_factors_equal_the_dense_svd(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    n_tokens, _, score = brute(texts, 3, 4)
    wv = CO.fit_word_vectors(docs, dim=6, window=3, min_count=4, oversample=40, power=3)
    assert wv.words == sorted(n_tokens, key=lambda w: (-n_tokens[w], w))
    M = np.array([[score.get((a, b), 0.0) for b in wv.words] for a in wv.words])
    U, s, _ = np.linalg.svd(M)
    assert np.allclose(wv.sigma, s[:6], atol=1e-8)
    assert np.allclose(wv.vectors @ wv.vectors.T, (U[:, :6] * s[:6]) @ U[:, :6].T, atol=1e-6)
    W = wv.weighted()
    for r in wv.encode(docs).collect():
        v = sum((W[wv.words.index(w)] for w in (texts[r.row_id] or "").lower().split() if w in n_tokens), np.zeros(6))
        n = np.linalg.norm(v)
        assert np.allclose(r.embedding, v / n if n else v, atol=2e-6)


def test_rows_over_many_batches_and_a_cut_vocabulary(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    whole = CO.fit_word_vectors(docs, dim=4, window=3, min_count=4, max_words=10, oversample=6)
    assert len(whole.words) == 10
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        again = CO.fit_word_vectors(docs, dim=4, window=3, min_count=4, max_words=10, oversample=6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(whole.vectors, again.vectors, atol=1e-9)


def test_nothing_and_few_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    wv = CO.fit_word_vectors(none, dim=4)
    assert wv.words == [] and wv.encode(none).count() == 0
    few = spark.createDataFrame([(1, "a b a b"), (2, "c"), (None, None)], SCHEMA)
    wv = CO.fit_word_vectors(few, dim=4, min_count=1)
    got = {r.row_id: r.embedding for r in wv.encode(few).collect()}
    assert set(got) == {1, 2, None} and got[None] == [0.0] * 4 and all(len(v) == 4 for v in got.values())
    assert CO.cooccurrence_counts(few, CO.word_counts(few, 1), 9).where("word = 'c'").count() == 0


def test_encoder_of_a_table(spark):
    rows = E.queries()["encode_words"](spark, SF001).collect()
    norm = Counter()
    for r in rows:
        norm[r.row_id] += r.value**2
    assert len(norm) > 150 and all(abs(v - 1) < 1e-3 for v in norm.values())
