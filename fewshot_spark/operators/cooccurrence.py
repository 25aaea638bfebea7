"""Word vectors from co-occurrence counts: an encoder trained on the corpus itself.

Two words co-occur when they stand at most ``window`` tokens apart in one text. Their counts give
positive pointwise mutual information, and a randomised truncated SVD of that matrix gives the
word vectors; a text is the mean of its words' vectors, rare words weighing more.

* Counting is one aggregation with map-side sums: a task numbers the words of about a million tokens,
  pairs them by position and sorts the pairs; no join of tokens is needed. Unordered pairs are
  shuffled and kept once, in compact blocks (``pair_blocks``), and mirrored whenever they are read.
* The factorised vocabulary is the ``max_words`` most frequent words, which bounds everything the
  driver holds or broadcasts (``max_words`` x (``dim`` + ``oversample``) doubles). The cells of the
  matrix stay in Spark, laid out by row once; each product with a block of vectors is one narrow
  pass over them, and the passes number ``power + 2`` whatever the corpus.

Null and empty texts have no tokens: they add no counts, and their vector is zero, as is that of
a text without a known word.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare_session
from . import pair_blocks as PB
from .encode import small_batches, token_pieces, tokens

BROADCAST_WORDS = 4_000_000  # words sent to all tasks at most (about 35 bytes each)
JOINED_WORDS = 1_000_000  # words whose totals a broadcast join takes at most (about 100 MB)
BUCKET_MET, TASK_MET = 1 << 22, 1 << 25  # pairs of positions that a bucket and a task sum up, as most words are known
UNKNOWN_BUCKETS = 256  # where words come without their counts


def word_counts(docs: DataFrame, min_count: int = 5, text_col: str = "text") -> DataFrame:
    """``(word, n_tokens)`` of every word that stands at least ``min_count`` times in the texts."""
    words = docs.select(F.explode(tokens(text_col)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_tokens")).where(F.col("n_tokens") >= min_count)


def cooccurrence_counts(docs: DataFrame, words: DataFrame, window: int = 4, text_col: str = "text",
                        key: str = "word", totals: bool = False) -> DataFrame:
    """``(word, context, n)``: ordered pairs of positions at most ``window`` apart, both words in
    ``words`` (distances count all tokens). The table is symmetric; a word is its own context twice
    for each unordered pair of its places.

    ``key`` is the column of ``words`` that stands for a word in the result, one value for each word
    (short numbers make all later steps cheaper). Words that come with their ``n_tokens`` are
    numbered by falling count, and the buckets follow the number of tokens.

    Up to ``BROADCAST_WORDS`` words are sent to all tasks: pairs with another word go before the
    shuffle, which carries blocks of counts. More words are filtered after the counts, and all pairs
    of words are shuffled. With ``totals``, and words that can be sent, ``n_word``, ``n_context`` and
    ``n_all`` follow: the sums of ``n`` over the word, the context and the whole table."""
    spark = docs.sparkSession
    toks = docs.select(tokens(text_col).alias("_t"))
    cols = dict.fromkeys(["word", key, *(["n_tokens"] if "n_tokens" in words.columns else [])])
    known = words.where(F.col("word").isNotNull()).select(*cols).dropDuplicates(["word"]).checkpoint()
    size = known.count()
    if size > BROADCAST_WORDS:
        return _counts_of_many(toks, known, int(window), key)
    table = known.toArrow().combine_chunks()
    place, met, buckets = np.arange(size), None, UNKNOWN_BUCKETS
    if "n_tokens" in cols:
        n = table["n_tokens"].to_numpy()
        place, met = np.argsort(-n, kind="stable"), int(n.sum()) * int(window)
        buckets = max(1, -(-met // BUCKET_MET))
    table = table.take(pa.array(place))
    at = PB.Layout(size, buckets)
    column = lambda name: pa.concat_arrays(table[name].chunks) if size else pa.array([], table[name].type)
    sent = spark.sparkContext.broadcast(PB.WordNumbers(column("word")))
    blocks = toks.mapInArrow(lambda batches: PB.count_texts(batches, sent.value, int(window), at), "bucket int, block binary")
    tasks = max(spark.sparkContext.defaultParallelism, -(-(met or 0) // TASK_MET))
    blocks = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    blocks = blocks.mapInArrow(lambda batches: PB.merge_buckets(batches, at), "bucket int, block binary").checkpoint()
    keys, total = spark.sparkContext.broadcast(column(key)), None
    if totals:
        sums = blocks.mapInArrow(lambda batches: PB.row_totals(batches, at), "i long, n long").toArrow()
        total = np.zeros(size, np.int64)
        total[sums["i"].to_numpy()] = sums["n"].to_numpy()
        whole, total = int(total.sum()), spark.sparkContext.broadcast(total)

    def rows(batches):
        for x, y, n in PB.cells(batches, at):
            found = [keys.value.take(pa.array(x)), keys.value.take(pa.array(y)), pa.array(n)]
            names = ["word", "context", "n"]
            if totals:
                found, names = [*found, pa.array(total.value[x]), pa.array(total.value[y])], [*names, "n_word", "n_context"]
            yield pa.RecordBatch.from_arrays(found, names)

    kind = known.schema[key].dataType
    schema = T.StructType([T.StructField("word", kind), T.StructField("context", kind), *(
        T.StructField(c, T.LongType()) for c in ("n", *(("n_word", "n_context") if totals else ())))])
    res = blocks.mapInArrow(rows, schema)
    return res.withColumn("n_all", F.lit(whole).cast("long")) if totals else res


def _counts_of_many(toks: DataFrame, known: DataFrame, window: int, key: str) -> DataFrame:
    """``cooccurrence_counts`` of more words than all tasks can hold: pairs of words, joined after the counts."""
    apart = toks.select("_t", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("_k"))
    n = F.greatest(F.size("_t") - F.col("_k"), F.lit(0))
    met = apart.select(F.explode(F.arrays_zip(
        F.slice("_t", F.lit(1), n).alias("x"), F.slice("_t", F.col("_k") + 1, n).alias("y"))).alias("p")).select("p.x", "p.y")
    half = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        half = half.join(known.select(F.col("word").alias(side), F.col(key).alias(f"_{side}")), side).drop(side).withColumnRenamed(f"_{side}", side)
    half = half.checkpoint()
    cell = lambda x, y, m: F.struct(F.col(x).alias("word"), F.col(y).alias("context"), m.alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(cell("a", "b", F.col("n") * 2))).otherwise(
        F.array(cell("a", "b", F.col("n")), cell("b", "a", F.col("n"))))
    return half.select(F.inline(both))


def ppmi(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """Add ``ppmi = max(0, ln(n * N / (n_word * n_context)) - ln(shift))`` to ``(word, context, n)``;
    N and the words' totals are those of ``counts``, which is read twice unless it has them already
    (``cooccurrence_counts`` with ``totals``)."""
    if {"n_word", "n_context", "n_all"} <= set(counts.columns):
        res, total = counts.withColumnsRenamed({"n_word": "_w", "n_context": "_c"}), F.col("n_all").cast("double")
    else:
        totals = counts.groupBy("word").agg(F.sum("n").alias("_n")).checkpoint()
        size = totals.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("words")).first()
        total, sent = F.lit(float(size["n"] or 0)), F.broadcast if size["words"] <= JOINED_WORDS else (lambda df: df)
        res = counts.join(sent(totals.withColumnRenamed("_n", "_w")), "word").join(
            sent(totals.select(F.col("word").alias("context"), F.col("_n").alias("_c"))), "context")
    ratio = F.col("n").cast("double") * total / (F.col("_w").cast("double") * F.col("_c").cast("double"))
    return res.select("word", "context", "n", F.greatest(F.log(ratio) - F.lit(math.log(shift)), F.lit(0.0)).alias("ppmi"))


def _times(cells: DataFrame, X: np.ndarray) -> np.ndarray:
    """The symmetric matrix of ``cells`` (i, j, v; each row i whole and sorted in one partition)
    times X, row by row: a task keeps one running row and returns finished ones."""
    sent = cells.sparkSession.sparkContext.broadcast(X)

    def run(batches):
        X, at, held = sent.value, None, None
        for b in batches:
            if not b.num_rows:
                continue
            i, j, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            sums, rows = np.add.reduceat(v[:, None] * X[j], first, axis=0), i[first]
            if at is not None:
                if rows[0] == at:
                    sums[0] += held
                else:
                    yield _packed([at], [held])
            if len(rows) > 1:
                yield _packed(rows[:-1], sums[:-1])
            at, held = rows[-1], sums[-1]
        if at is not None:
            yield _packed([at], [held])

    out = np.zeros_like(X)
    for r in cells.mapInArrow(run, "i int, x binary").collect():  # max_words rows at most
        out[r["i"]] = np.frombuffer(r["x"])
    sent.unpersist()
    return out


def _packed(rows, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["i", "x"])


def truncated_svd(cells: DataFrame, size: int, dim: int, oversample: int = 16, power: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(U, s)``, the leading ``dim`` left singular vectors (size x dim) and values of a symmetric
    matrix, by randomised subspace iteration with ``power + 2`` passes over its cells. Columns beyond
    the rank are zero; the largest entry of a column is positive."""
    U, s = np.zeros((size, dim)), np.zeros(dim)
    width = min(size, dim + oversample)
    if not width:
        return U, s
    Q = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(power + 1):
        Q = np.linalg.qr(_times(cells, Q))[0]
    B = Q.T @ _times(cells, Q)
    values, E = np.linalg.eigh((B + B.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    order = order[np.abs(values[order]) > 1e-9 * max(1.0, np.abs(values).max())]
    V = Q @ E[:, order]
    U[:, : len(order)] = V * np.where(V[np.abs(V).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    s[: len(order)] = np.abs(values[order])
    return U, s


@dataclass
class WordVectors:
    """Words by falling count, their corpus counts, and one vector each."""

    words: list[str]
    counts: np.ndarray
    vectors: np.ndarray
    sigma: np.ndarray
    weight: float = 1e-3

    def weighted(self) -> np.ndarray:
        """Vectors about their corpus mean, times ``weight / (weight + share of the word)``."""
        if not len(self.words):
            return self.vectors
        share = self.counts / self.counts.sum()
        return (self.vectors - share @ self.vectors) * (self.weight / (self.weight + share))[:, None]

    def encode(self, df: DataFrame, id_col: str = "row_id", text_col: str = "text", out: str = "embedding") -> DataFrame:
        """``(id_col, out)``: the unit sum of the weighted vectors of a text's words, to 6 digits.
        Works as ``RunConfig.encoder``; no shuffle. The vectors are broadcast (bounded by the fit)."""
        dim = self.vectors.shape[1]
        sent = df.sparkSession.sparkContext.broadcast((self.words, self.weighted()))
        schema = T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches):
            words, W = sent.value
            place = {w: i for i, w in enumerate(words)}
            for pdf in small_batches(batches, text_col):
                V = np.zeros((len(pdf), dim))
                for k, text in enumerate(pdf[text_col]):
                    found = Counter(place[w] for ws in token_pieces(text) for w in ws if w in place)
                    if found:
                        ids = np.sort(np.fromiter(found, np.int64, len(found)))
                        V[k] = np.array([found[i] for i in ids.tolist()]) @ W[ids]
                norm = np.linalg.norm(V, axis=1, keepdims=True)
                V = np.divide(V, norm, out=np.zeros_like(V), where=norm > 0)
                yield pdf[[id_col]].assign(**{out: list(np.round(V, 6))})

        return df.select(id_col, text_col).mapInPandas(run, schema)


def fit_word_vectors(docs: DataFrame, dim: int = 128, window: int = 4, min_count: int = 5, max_words: int = 50_000,
                     text_col: str = "text", shift: float = 1.0, oversample: int = 16, power: int = 2, seed: int = 0) -> WordVectors:
    """Word vectors ``U * sqrt(s)`` of the PPMI matrix of the ``max_words`` most frequent words (ties
    by the word), counted over all texts. Fewer words than ``dim`` leave zero columns."""
    spark = docs.sparkSession
    prepare_session(spark)
    top = word_counts(docs, min_count, text_col).orderBy(F.desc("n_tokens"), "word").limit(max_words).collect()
    words, counts = [r["word"] for r in top], np.array([r["n_tokens"] for r in top], np.float64)
    if not words:
        return WordVectors([], counts, np.zeros((0, dim)), np.zeros(dim))
    ids = spark.createDataFrame([(r["word"], i, r["n_tokens"]) for i, r in enumerate(top)], "word string, i int, n_tokens long")
    met = cooccurrence_counts(docs, ids, window, text_col, key="i", totals=True)
    scored = ppmi(met, shift).where(F.col("ppmi") > 0)
    cells = scored.select(F.col("word").alias("i"), F.col("context").alias("j"), F.col("ppmi").alias("v"))
    cells = cells.repartition("i").sortWithinPartitions("i", "j").checkpoint()
    U, s = truncated_svd(cells, len(words), dim, oversample, power, seed)
    return WordVectors(words, counts, U * np.sqrt(s), s)
