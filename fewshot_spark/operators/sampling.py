"""Few-shot sampling: balanced per-class draws over a whole (sample size x seed) grid in one pass.

Semantics (per split): for every class take ``k`` rows without replacement, or the whole class
when it has at most ``k`` rows. Rows are ranked by ``h60(seed, row_id)`` (ties by row id) inside
(seed, class); a row of rank r belongs to every split whose size is >= r. Splits of one seed are
therefore nested over k, as the seeded per-class permutation of the original experiments is.

Plan shape: the ranking runs on the narrow (row_id, label) columns. ``rank <= max(k)`` over a
``row_number`` window becomes a ``WindowGroupLimit`` before the shuffle, so each map task sends at
most ``max(k)`` rows per (seed, class), however large or skewed a class is. Text and other payload
columns are attached afterwards by row id: a broadcast join when the sample is below a checked row
count, a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..functions.ranking import kth_smallest
from .prepare import label_unpivot

BROADCAST_ROWS = 1_000_000  # sample keys are ~40 bytes a row: at most ~40 MB broadcast
MAX_BROADCAST_IDS = 20_000_000  # distinct sampled ids, 8 bytes each: at most ~160 MB broadcast


def attach_payload(keys: DataFrame, table: DataFrame, id_col: str = "row_id", max_rows: int = BROADCAST_ROWS,
                   max_ids: int | None = None) -> DataFrame:
    """Join the payload columns of ``table`` to the (small) key table by id, without shuffling the
    payload when the sample allows it:

    1. distinct sampled ids up to ``max_ids`` (8 bytes each): the id set is broadcast as a left
       semi join, which Catalyst pushes below the joins of ``table`` into the scan that holds the
       text, so only sampled rows leave that scan stage, whatever ``table`` is joined from;
    2. keys up to ``max_rows`` rows are broadcast too, else the surviving rows are shuffled;
    3. beyond ``max_ids`` both sides are shuffled on the id.
    The key table is narrow; it is counted once more for the size checks. Nothing is cached here.
    """
    max_ids = MAX_BROADCAST_IDS if max_ids is None else max_ids
    n = keys.count()
    payload_cols = [c for c in table.columns if c not in keys.columns or c == id_col]
    payload = table.select(*payload_cols)
    ids = keys.select(id_col).distinct()
    if n <= max_rows or ids.count() <= max_ids:
        payload = payload.join(F.broadcast(ids), id_col, "left_semi")
    return payload.join(F.broadcast(keys), id_col) if n <= max_rows else keys.join(payload, id_col)


def _seed_table(seeds: list[int]):
    return F.explode(
        F.array(*[F.struct(F.lit(i).alias("seed_idx"), F.lit(int(s)).alias("seed")) for i, s in enumerate(seeds)])
    ).alias("_s")


CANDIDATE_FACTOR = 4
CANDIDATE_SLACK = 64
MAX_THRESHOLD_CLASSES = 1_000_000
PREFILTER_MIN_CLASS_ROWS = 1_000_000  # below this the per-task top-k sort is cheap


def _rank_top(draws: DataFrame, class_col: str, id_col: str, kmax: int) -> DataFrame:
    w = Window.partitionBy("seed_idx", class_col).orderBy("_h", id_col)
    return draws.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= kmax)


def _ranked_keys(long: DataFrame, class_col: str, sizes: list[int], seeds: list[int], id_col: str,
                 prefilter: bool = True) -> DataFrame:
    """(id, class, seed_idx, sample_size) of every split.

    With ``prefilter`` (used when the largest class has more than ``PREFILTER_MIN_CLASS_ROWS``
    rows; one small job counts the classes) the draws are first cut at a per-class hash threshold
    set so that about ``4 k + 64`` candidates per (seed, class) are expected (the hash is
    uniform); only those reach the window, so no task sorts a large class. A (seed, class) left
    with fewer candidates than it needs is ranked again without the cut, so the result is exact.
    The threshold table (one row per class) is broadcast after a size check; beyond it the plain
    window is used.
    """
    sizes = sorted({int(s) for s in sizes})
    if not sizes or sizes[0] < 1:
        raise ValueError("sample sizes must be positive")
    kmax = sizes[-1]
    draws = long.select(id_col, class_col, _seed_table(seeds)).select(
        id_col,
        class_col,
        F.col("_s.seed_idx").alias("seed_idx"),
        h60(F.col("_s.seed"), F.col(id_col)).alias("_h"),
    )
    top = None
    if prefilter:
        want = CANDIDATE_FACTOR * kmax + CANDIDATE_SLACK
        full = F.lit(1 << 60).cast("bigint")
        thr = long.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_t", F.when(F.col("_n") <= want, full).otherwise(
                F.floor(F.lit(float(1 << 60)) * F.lit(float(want)) / F.col("_n")).cast("bigint"))
        )
        stats = thr.agg(F.count(F.lit(1)).alias("classes"), F.max("_n").alias("largest")).first()
        if stats["classes"] <= MAX_THRESHOLD_CLASSES and (stats["largest"] or 0) > PREFILTER_MIN_CLASS_ROWS:
            cand = draws.join(F.broadcast(thr.select(class_col, "_t")), class_col).where(F.col("_h") < F.col("_t")).drop("_t")
            have = cand.groupBy("seed_idx", class_col).agg(F.count(F.lit(1)).alias("_c"))
            expected = thr.select(class_col, "_n", F.explode(F.array(*[F.lit(i) for i in range(len(seeds))])).alias("seed_idx"))
            short = (expected.join(have, ["seed_idx", class_col], "left")
                     .where(F.coalesce(F.col("_c"), F.lit(0)) < F.least(F.col("_n"), F.lit(kmax)))
                     .select("seed_idx", class_col))
            # usually empty: the broadcast side is empty and the re-ranking branch is pruned at run time
            good = _rank_top(cand, class_col, id_col, kmax).join(F.broadcast(short), ["seed_idx", class_col], "left_anti")
            redo = _rank_top(draws.join(F.broadcast(short), ["seed_idx", class_col], "left_semi"), class_col, id_col, kmax)
            top = good.unionByName(redo)
    if top is None:
        top = _rank_top(draws, class_col, id_col, kmax)
    size_arr = F.array(*[F.lit(s) for s in sizes])
    return top.select(
        id_col,
        class_col,
        "seed_idx",
        F.explode(F.filter(size_arr, lambda s: s >= F.col("_rank"))).alias("sample_size"),
    )


def fewshot_grid(
    df: DataFrame,
    sizes: list[int],
    seeds: list[int],
    label_col: str = "label",
    id_col: str = "row_id",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All (size, seed) few-shot splits of a single-label table in one pass.

    Output: ``(sample_size INT, seed_idx INT, <df columns>)``; ``seed_idx`` is the position of the
    seed in ``seeds`` (the split key), the seed value drives the draw.
    """
    keys = _ranked_keys(df.select(id_col, label_col), label_col, sizes, seeds, id_col).drop(label_col)
    out = attach_payload(keys, df, id_col, max_broadcast_rows)
    return out.select(
        F.col("sample_size").cast("int"), F.col("seed_idx").cast("int"), *[F.col(c) for c in df.columns]
    )


def fewshot_sample(df: DataFrame, k: int, seed: int, label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    """One balanced split: ``min(k, n_c)`` rows of every class."""
    return fewshot_grid(df, [k], [seed], label_col, id_col).drop("sample_size", "seed_idx")


def fewshot_grid_multilabel(
    df: DataFrame,
    label_cols: list[str],
    sizes: list[int],
    seeds: list[int],
    id_col: str = "row_id",
    text_col: str = "text",
    mask_col: str = "label_mask",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Multi-label splits: per label column, k rows among those with the flag set; the union per
    split is de-duplicated on the whole row (text and label set), keeping the smallest id.

    Rows with no label are never drawn.
    """
    long = label_unpivot(df, [id_col], label_cols)
    keys = _ranked_keys(long, "label_id", sizes, seeds, id_col).select("sample_size", "seed_idx", id_col).distinct()
    rows = attach_payload(keys, df, id_col, max_broadcast_rows)
    group = ["sample_size", "seed_idx", text_col, mask_col]
    rest = [c for c in df.columns if c not in group]
    first = rows.groupBy(*group).agg(F.min(F.struct(id_col, *[c for c in rest if c != id_col])).alias("_first"))
    return first.select(
        F.col("sample_size").cast("int"), F.col("seed_idx").cast("int"),
        *[F.col(c) if c in group else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def fewshot_sample_multilabel(df: DataFrame, label_cols: list[str], k: int, seed: int, id_col: str = "row_id") -> DataFrame:
    return fewshot_grid_multilabel(df, label_cols, [k], [seed], id_col).drop("sample_size", "seed_idx")


def sample_exact(df: DataFrame, n: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows without replacement (the n smallest ``h60(seed, id)``); n > rows raises.

    The n-th draw is found by radix selection (``kth_smallest``); the sample is then a filter, so
    there is no global sort and nothing is merged in one task.
    """
    if n == 0:
        return df.where(F.lit(False))
    if n < 0:
        raise ValueError("sample size must be >= 0")
    hashed = df.select(id_col, h60(F.lit(int(seed)), F.col(id_col)).alias("_h")).persist()
    try:
        h_k, id_k, _ = kth_smallest(hashed, n, "_h", id_col)
    finally:
        hashed.unpersist()
    return df.where(_upto(seed, id_col, h_k, id_k))


def _upto(seed: int, id_col: str, h_k: int, id_k: int):
    h = h60(F.lit(int(seed)), F.col(id_col))
    return (h < F.lit(h_k)) | ((h == F.lit(h_k)) & (F.col(id_col) <= F.lit(id_k)))


def fraction_split(df: DataFrame, frac: float, seed: int, id_col: str = "row_id", out: str = "split") -> DataFrame:
    """Exact disjoint cover: ``round(frac * n)`` rows (half to even) are ``'train'``, the rest ``'test'``."""
    hashed = df.select(id_col, h60(F.lit(int(seed)), F.col(id_col)).alias("_h")).persist()
    try:
        n = hashed.count()
        k = round(frac * n)
        if k == 0:
            return df.withColumn(out, F.lit("test"))
        h_k, id_k, _ = kth_smallest(hashed, k, "_h", id_col, total=n)
    finally:
        hashed.unpersist()
    return df.withColumn(out, F.when(_upto(seed, id_col, h_k, id_k), F.lit("train")).otherwise(F.lit("test")))
