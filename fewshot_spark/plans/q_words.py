"""Queries: co-occurrence word vectors and the encoder made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cooccurrence as CO
from ..session import read_table
from .q_models import TOKENS_SQL, _long
from .registry import register

WINDOW, MIN_COUNT, DIM = 4, 5, 64

_MET_SQL = " UNION ALL ".join(f"SELECT tk[i] AS a, tk[i + {k}] AS b FROM placed WHERE i + {k} <= len(tk)" for k in range(1, WINDOW + 1))


@register(
    "ppmi_counts",
    f"""
    WITH tk AS (SELECT {TOKENS_SQL.format(t='text')} AS tk FROM documents),
    placed AS (SELECT tk, unnest(range(1, len(tk) + 1)) AS i FROM tk),
    wd AS (SELECT tk[i] AS word, count(*) AS n_tokens FROM placed GROUP BY 1 HAVING count(*) >= {MIN_COUNT}),
    met AS ({_MET_SQL}),
    half AS (SELECT a, b, count(*) AS n FROM met WHERE a IN (SELECT word FROM wd) AND b IN (SELECT word FROM wd) GROUP BY ALL),
    cell AS (SELECT word, context, sum(n) AS n FROM (SELECT a AS word, b AS context, n FROM half
             UNION ALL SELECT b, a, n FROM half) GROUP BY ALL),
    tot AS (SELECT word, sum(n) AS n FROM cell GROUP BY 1),
    p AS (SELECT c.word, c.n, greatest(ln(c.n::DOUBLE * (SELECT sum(n) FROM tot)::DOUBLE / (w.n::DOUBLE * x.n::DOUBLE)), 0.0) AS ppmi
          FROM cell c JOIN tot w ON w.word = c.word JOIN tot x ON x.word = c.context)
    SELECT p.word, any_value(wd.n_tokens)::BIGINT AS n_tokens, count(*)::BIGINT AS n_contexts, sum(p.n)::BIGINT AS n,
           sum(p.n * p.n)::BIGINT AS n_squares, round(sum(ppmi), 6) AS ppmi_sum, round(max(ppmi), 6) AS ppmi_max
    FROM p JOIN wd ON wd.word = p.word GROUP BY p.word
    """,
)
def q_ppmi_counts(spark, sf):
    """Co-occurrence counts and positive pointwise mutual information over all documents, summed up
    for each word that stands at least five times."""
    docs = read_table(spark, sf, "documents").select("text")
    words = CO.word_counts(docs, MIN_COUNT).withColumn("i", F.monotonically_increasing_id()).checkpoint()
    scored = CO.ppmi(CO.cooccurrence_counts(docs, words, WINDOW, key="i", totals=True))
    per = scored.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_contexts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n_squares"),
        F.round(F.sum("ppmi"), 6).alias("ppmi_sum"), F.round(F.max("ppmi"), 6).alias("ppmi_max"))
    return per.withColumnRenamed("word", "i").join(words, "i").select("word", *per.columns[1:], "n_tokens")


@register("encode_words")
def q_encode_words(spark, sf):
    """Every whole document encoded by word vectors fitted on all documents (long form)."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return _long(CO.fit_word_vectors(docs, DIM, WINDOW, MIN_COUNT).encode(docs), "row_id")
