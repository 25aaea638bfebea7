"""Ranked search against brute force: scores, ties, reads in small steps, odd inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
from fewshot_spark.llm import ranked
from fewshot_spark.session import read_table

SF001 = "/root/testdata/sf0.001"
_RUN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return _RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k=10):
    """``docs``: (id, text) rows; ``items``: (id, text) rows."""
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    tfs = [Counter(w) for _, w in held]
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, query in asked.items():
        scored = []
        for (i, w), tf in zip(held, tfs, strict=True):
            m = 25 + (75 * len(w) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, q in query.items() if t in tf)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(map(str, ((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF001, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF001, "benchmark").collect()]
    assert rows_of(E.queries()["op13_ranked_search"](spark, SF001)) == brute_search(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_reads_stop_only_when_all_is_resolved(seed, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_READ", 1)
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 300, 12
    doc = np.repeat(np.arange(n_docs), 20)
    hits = rng.choice(n_terms, len(doc), p=(1 / np.arange(1, n_terms + 1)) / (1 / np.arange(1, n_terms + 1)).sum())
    if seed % 2:  # many equal documents
        hits = np.tile(hits[: 20 * 30], 10)
    norm = 100 + (rng.integers(0, 3, n_docs) if seed % 3 else np.zeros(n_docs, np.int64))
    lists = ranked.Lists(hits, doc, norm, n_terms)
    tie = rng.permutation(n_docs)
    weights = rng.integers(0, 9, n_terms)
    tf = np.zeros((n_docs, n_terms), np.int64)
    np.add.at(tf, (doc, hits), 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[:, None])
    for k in (1, 10, 400):
        item = [(t, int(weights[t]) * q) for t, q in ((0, 1), (3, 2), (5, 1), (11, 4), (7, 1))]
        score = sum(w * impact[:, t] for t, w in item)
        want = [(d, int(score[d])) for d in np.lexsort((tie, -score)) if score[d] > 0][:k]
        assert lists.best(item, k, tie) == want


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(ranked, "SLICE", 7)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "Z", "é", "日本", " ", ".", "_", "9", "\x7f", "x" * 20]) for _ in range(rng.randrange(30)))
        assert [t.decode() for part in ranked.terms(text.encode()) for t in part] == terms_of(text)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(700_000))
    docs = [(1, None), (2, ""), (3, " .,- "), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha beta"), (None, "alpha gamma"), (6, "ÉTÉ été"), (7, long), (8, "w17 " * 50)]
    items = [(1, "alpha"), (1, "alpha"), (1, "gamma"), (2, None), (3, "?!"), (None, "w17 été"), (4, "absent"), (5, "beta beta alpha")]
    df = spark.createDataFrame([(*d, "r", 1, 2) for d in docs], "doc_id long, text string, item_id string, rank int, score int").repartition(3)
    ask = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    assert rows_of(ranked.search(df, ask, 3)) == brute_search(docs, items, 3)
    assert ranked.search(df.limit(0), ask).count() == 0 and ranked.search(df, ask.limit(0)).count() == 0


def test_blocks_of_items_and_documents(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(12)))) for i in range(200)]
    items = [(i, " ".join(rng.choices("abcdefghx", k=4))) for i in range(25)]
    monkeypatch.setattr(ranked, "BLOCK_PAIRS", 30)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(ranked.search(df, spark.createDataFrame(items, "item_id long, text string"))) == brute_search(docs, items)
