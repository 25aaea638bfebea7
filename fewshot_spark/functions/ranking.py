"""Distributed numbering and order statistics over 60-bit hash keys.

* ``number_by_hash``: dense positions 0..n-1 inside groups, ordered by (hash, id). Rows are
  numbered inside (group, top hash bits) sub-groups and shifted by the sizes of the earlier
  sub-groups, so a group holding a third of the table is spread over ``2**bits`` tasks instead
  of one. Because the sub-group is the top bits of the sort key, the result equals a plain
  ``row_number() OVER (PARTITION BY group ORDER BY hash, id) - 1``.
* ``kth_smallest``: the k-th smallest (hash, id) of a table by radix selection: a few
  aggregations into at most 4,096 buckets each, until the bucket holding the answer is small;
  no global sort, no single-task window, the driver only sees bucket counts and one small band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import HASH_BITS

RADIX_BITS = 12
BAND_ROWS = 50_000
GROUP_ROWS_PER_TASK = 200_000


def auto_bits(df: DataFrame, group_cols: list[str]) -> int:
    """Sub-group bits so that no numbering task holds more than ~GROUP_ROWS_PER_TASK rows of one
    group (0 when every group is small). One small aggregation."""
    big = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("m")).first()["m"] or 0
    bits = 0
    while big > GROUP_ROWS_PER_TASK and bits < 12:
        big //= 2
        bits += 1
    return bits


def number_by_hash(
    df: DataFrame,
    group_cols: list[str],
    hash_col: str,
    id_col: str | list[str],
    out: str = "pos",
    bits: int | None = None,
    with_counts: bool = False,
) -> DataFrame:
    """Add ``out`` = 0-based position inside ``group_cols`` ordered by (hash_col, id_col).

    With ``with_counts`` also adds ``group_n`` (rows in the group). ``id_col`` may be a list of
    tie-break columns. ``bits=None`` picks the sub-group bits from the largest group
    (``auto_bits``), so a hot group is spread over several tasks and small groups cost no extra
    shuffle.
    """
    ties = [id_col] if isinstance(id_col, str) else list(id_col)
    if bits is None:
        bits = auto_bits(df, group_cols)
    if bits <= 0:
        w = Window.partitionBy(*group_cols).orderBy(hash_col, *ties)
        res = df.withColumn(out, F.row_number().over(w) - 1)
        if with_counts:
            res = res.withColumn("group_n", F.count(F.lit(1)).over(Window.partitionBy(*group_cols)))
        return res
    sub = "_sub"
    shifted = df.withColumn(sub, F.shiftright(F.col(hash_col), HASH_BITS - bits))
    counts = shifted.groupBy(*group_cols, sub).agg(F.count(F.lit(1)).alias("_n"))
    wc = Window.partitionBy(*group_cols).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0)))
    if with_counts:
        offsets = offsets.withColumn("group_n", F.sum("_n").over(Window.partitionBy(*group_cols)))
    offsets = offsets.drop("_n")
    w = Window.partitionBy(*group_cols, sub).orderBy(hash_col, *ties)
    numbered = shifted.withColumn("_rn", F.row_number().over(w) - 1)
    return (
        numbered.join(offsets, [*group_cols, sub])
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop(sub, "_off", "_rn")
    )


def kth_smallest(df: DataFrame, k: int, hash_col: str = "h", id_col: str = "row_id", total: int | None = None) -> tuple[int, int, int]:
    """Return ``(hash_k, id_k, n)``: the k-th smallest (hash, id) pair (1-based) and the row count.

    ``df`` should be narrow (hash, id) and persisted by the caller; each pass is one aggregation.
    Raises when k is outside [1, n].
    """
    if total is not None and not 1 <= k <= total:
        raise ValueError(f"cannot take {k} rows from a table of {total}")
    cand = df.select(hash_col, id_col)
    need = k
    shift = HASH_BITS - RADIX_BITS
    n_total = total
    while True:
        buckets = (
            cand.groupBy(F.shiftright(F.col(hash_col), shift).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        buckets.sort(key=lambda r: r["b"])
        if n_total is None:
            n_total = sum(r["n"] for r in buckets)
            if not 1 <= k <= n_total:
                raise ValueError(f"cannot take {k} rows from a table of {n_total}")
        seen = 0
        chosen = None
        for r in buckets:
            if seen + r["n"] >= need:
                chosen = r
                break
            seen += r["n"]
        need -= seen
        cand = cand.where(F.shiftright(F.col(hash_col), shift) == F.lit(chosen["b"]))
        if chosen["n"] <= BAND_ROWS or shift == 0:
            break
        shift = max(0, shift - RADIX_BITS)
    row = cand.orderBy(hash_col, id_col).offset(need - 1).limit(1).collect()[0]
    return int(row[hash_col]), int(row[id_col]), int(n_total)


def upto_pair(hash_col: str, id_col: str, h_k: int, id_k: int):
    """Predicate ``(hash, id) <= (h_k, id_k)``."""
    return (F.col(hash_col) < F.lit(h_k)) | ((F.col(hash_col) == F.lit(h_k)) & (F.col(id_col) <= F.lit(id_k)))
