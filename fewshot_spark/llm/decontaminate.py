"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions.

The small side is sketched, the large side is asked. Items are partitioned by size (powers of two
of their distinct shingles); a partition's items are indexed by their bottom-k MinHash sketch,
where k is one more than the shingles an item of the partition's largest size may lack at the
threshold. A document that contains enough of an item lacks fewer than k of its shingles, so it
holds at least one of the sketch: no leak is lost, however long the document. A document's
distinct shingles are probed in its scan stage against the index; only hits go on. Hits are
confirmed by the exact containment on full shingle sets. Items of fewer words than a shingle are
indexed by their own width, and documents are probed with the widths that the items have (at most
five numbers, which the driver gets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import sized



def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingle_hashes(w: Column, width: int) -> Column:
    """Hashes of all shingles of ``width`` words (a text of fewer words has none)."""
    at = F.sequence(F.lit(1), F.size(w) - (width - 1))
    found = F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, found).otherwise(F.array().cast("array<bigint>"))


def of_widths(w: Column, widths: list[int]) -> Column:
    """Distinct shingle hashes of all ``widths``. The hash chains the words, so shingles of
    different widths do not meet but by a 64-bit accident."""
    return F.array_distinct(F.concat(*[shingle_hashes(w, v) for v in widths]))


def item_index(benchmark: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items' full shingles ``(item_id, n, h)`` and the sketch index ``(item_id, h)``. An item of
    fewer than ``width`` words is one shingle of its own width."""
    src = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    own = F.array().cast("array<bigint>")
    for v in range(1, width):
        own = F.when(F.size("w") == v, shingle_hashes(F.col("w"), v)).otherwise(own)
    own = F.when(F.size("w") >= width, F.array_distinct(shingle_hashes(F.col("w"), width))).otherwise(own)
    full = src.select("item_id", F.explode(own).alias("h")).distinct()
    n = Window.partitionBy("item_id")
    full = full.withColumn("n", F.count(F.lit(1)).over(n)).checkpoint()
    size = F.ceil(F.log2("n")).cast("int")
    lacking = F.floor(F.col("largest") * (100 - percent) / 100).cast("int")
    parts = full.groupBy(size.alias("part")).agg(F.max("n").alias("largest")).withColumn("k", lacking + 1)
    ranked = full.withColumn("part", size).withColumn("rank", F.row_number().over(n.orderBy("h")))
    return full, ranked.join(parts, "part").where("rank <= k").select("item_id", "h")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_key, item_id, item_shingles, shared_shingles, containment`` per leak.

    A leak: at least ``percent`` % of an item's distinct shingles are in the document.
    ``text_key`` (xxhash64 of the text) tells rows with null or repeated ids apart. Items without
    words are never found; an item of fewer than ``width`` words is one shingle of that many
    words, found in every document that holds them in a row. Null and empty documents hold nothing; repeated rows are one;
    rows of one item id are one item; other columns are ignored; an empty table gives no rows."""
    full, index = item_index(benchmark, width, percent, item_col, item_text_col)
    sizes = benchmark.select(F.least(F.size(words(F.col(item_text_col))), F.lit(width)).alias("v")).where("v > 0")
    widths = sorted(r["v"] for r in sizes.distinct().collect()) or [width]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where("text is not null")
    probe = src.select("doc_id", "text_key", words(F.col("text")).alias("w")).select("doc_id", "text_key", F.explode(of_widths(F.col("w"), widths)).alias("h"))
    found = probe.join(sized(index), "h").select("doc_id", "text_key", "item_id").distinct().checkpoint()
    holders = sized(found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct())
    held = src.join(holders, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left_semi")
    held = held.select("doc_id", "text_key", words(F.col("text")).alias("w")).select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.explode(of_widths(F.col("w"), widths)).alias("h")
    )
    shared = held.join(sized(full), "h").join(
        found.withColumnRenamed("item_id", "i"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("item_id") == F.col("i")),
    )
    counts = shared.groupBy("doc_id", "text_key", "item_id").agg(
        F.first("n").alias("item_shingles"), F.count_distinct("h").alias("shared_shingles")
    )
    return counts.where(F.col("shared_shingles") * 100 >= F.col("item_shingles") * percent).withColumn(
        "containment", F.col("shared_shingles") / F.col("item_shingles")
    )


def drop_leaking(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``find_leaks`` names, with their own columns."""
    bad = sized(leaks.select(F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.col(text_col)) == F.col("_leak_key"))
    return docs.join(bad, same, "left_anti")
