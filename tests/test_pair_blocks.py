"""Counts of pairs of words as compact blocks: size on disk, and equality with brute force."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fewshot_spark.operators import cooccurrence as CO
from fewshot_spark.operators import pair_blocks as PB


def brute(texts, words, window):
    met = Counter()
    for t in texts:
        t = t or []
        for i, x in enumerate(t):
            for y in t[i + 1 : i + 1 + window]:
                if x in words and y in words:
                    met[x, y] += 1
                    met[y, x] += 1
    return met


def kept_bytes(spark):
    at = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return sum(p.stat().st_size for p in at.rglob("*") if p.is_file())


def test_kept_counts_take_few_bytes_a_pair(spark):
    """Blocks; a row of two numbers and a count is larger by far."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(" ".join(f"w{int(3_000 * rng.random() ** 2)}" for _ in range(400)),) for _ in range(300)], "text string")
    words = CO.word_counts(docs, 1).checkpoint()
    before = kept_bytes(spark)
    counts = CO.cooccurrence_counts(docs, words, 4)
    kept = kept_bytes(spark) - before
    pairs = counts.where("word <= context").count()
    assert pairs > 100_000 and kept < 6 * pairs, (kept, pairs)


def test_blocks_give_their_keys_back():
    rng = np.random.default_rng(1)
    for bits, most in ((3, 1), (21, 300), (21, 1 << 40), (30, 2)):
        keys = np.unique(rng.integers(0, 1 << (bits + 9), 5_000))
        n = rng.integers(1, most + 1, len(keys))
        for k, m in ((keys, n), (keys[:1], n[:1])):
            x, y = PB.unpacked(PB.packed(k, m, bits), bits)
            assert np.array_equal(x, k) and np.array_equal(y, m)


@pytest.mark.parametrize("most", (3, 1 << 45))
def test_sums_of_counts(most):
    rng = np.random.default_rng(2)
    keys, n = rng.integers(0, 1 << 20, 3_000) % 400, rng.integers(1, most, 3_000)
    want = Counter()
    for k, m in zip(keys.tolist(), n.tolist(), strict=True):
        want[k] += m
    x, y = PB.summed(keys, n)
    assert x.tolist() == sorted(want) and y.tolist() == [want[k] for k in sorted(want)]
    none = PB.summed(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(none[0]) == len(none[1]) == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(PB, "_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    found = PB.WordNumbers(pa.array(["ab", "c", "cd", "é", "ef"])).find(pa.array(["ef", "ab", "xx", "é", "", "longer", "cd", "c", "zz"]))
    assert found.tolist() == [4, 0, -1, 3, -1, -1, 2, 1, -1]
    assert PB.WordNumbers(pa.array([], pa.string())).find(pa.array(["a"])).tolist() == [-1]


@pytest.mark.parametrize("buckets", (1, 3, 50))
def test_counts_over_runs_buckets_and_blocks(monkeypatch, buckets):
    """Runs end within texts, buckets are summed up in parts, blocks are cut within rows."""
    rng = random.Random(buckets)
    texts = [[rng.choice("aaaabbcdefghxyz") for _ in range(rng.randrange(30))] for _ in range(40)] + [None, [], ["a"], ["a", "a", "a"]]
    words = list("abcdefgh")
    at, known = PB.Layout(len(words), buckets), PB.WordNumbers(pa.array(words))
    lists = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 3], pa.list_(pa.string()))], ["t"]) for k in range(0, len(texts), 3)]
    want = brute(texts, set(words), 4)
    for tokens, held, block in ((7, 5, 3), (1 << 20, 1 << 23, 1 << 20)):
        monkeypatch.setattr(PB, "RUN_TOKENS", tokens)
        monkeypatch.setattr(PB, "HELD_PAIRS", held)
        monkeypatch.setattr(PB, "BLOCK_PAIRS", block)
        blocks = pa.Table.from_batches(PB.count_texts(lists, known, 4, at)).sort_by("bucket")
        merged = list(PB.merge_buckets(blocks.to_batches(max_chunksize=4), at))
        got, totals = Counter(), Counter()
        for x, y, n in PB.cells(merged, at):
            for i, j, m in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
                assert (words[i], words[j]) not in got
                got[words[i], words[j]] = m
        for b in PB.row_totals(merged, at):
            totals.update(dict(zip((words[i] for i in b["i"].to_pylist()), b["n"].to_pylist(), strict=True)))
        assert got == want
        assert totals == Counter({w: n for w in words if (n := sum(m for (x, _), m in want.items() if x == w))})


@pytest.mark.parametrize("sent", (True, False))
def test_keys_and_totals(spark, monkeypatch, sent):
    texts = ["a b c a", "b c d", None, "", "a a a rare", "c d b a b", "É é e"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = CO.word_counts(docs, 2).withColumn("i", F.xxhash64("word")).checkpoint()
    words = words.union(words.limit(2)).union(spark.createDataFrame([(None, 9, 7)], "word string, n_tokens long, i long"))
    name = {r.i: r.word for r in words.where("word is not null").collect()}
    if not sent:
        monkeypatch.setattr(CO, "BROADCAST_WORDS", 0)
        monkeypatch.setattr(CO, "JOINED_WORDS", 0)
    by_word = CO.cooccurrence_counts(docs, words.select("word"), 2)
    by_key = CO.cooccurrence_counts(docs, words, 2, key="i", totals=True)
    met = {(r.word, r.context): r.n for r in by_word.collect()}
    assert met == dict(brute([(t or "").lower().split() for t in texts], set("abcdé"), 2))
    assert {(name[r.word], name[r.context]): r.n for r in by_key.collect()} == met
    assert ("n_all" in by_key.columns) == sent
    want = {(r.word, r.context): r.ppmi for r in CO.ppmi(by_word).collect()}
    got = {(name[r.word], name[r.context]): r.ppmi for r in CO.ppmi(by_key).collect()}
    assert got == pytest.approx(want, abs=1e-12) and max(want.values()) > 0


def test_no_words_no_texts(spark):
    none = spark.createDataFrame([], "text string")
    some = spark.createDataFrame([("a b a",)], "text string")
    words = CO.word_counts(some, 1)
    assert CO.ppmi(CO.cooccurrence_counts(some, words.where("false"), 2, totals=True)).count() == 0
    assert CO.ppmi(CO.cooccurrence_counts(none, words, 2, totals=True)).count() == 0
    assert CO.cooccurrence_counts(some, words.select("word").where("false"), 2).count() == 0
