"""Label sets of any size, and random partners that share no label without pairing label sets.

A label set is ``array<bigint>``: word ``i div 60`` holds label ``i`` at bit ``i % 60``, so any
number of labels fits and sets are compared word by word in built-in functions.

``disjoint_partners`` draws, for each example, a uniform row of its split that shares no label:

1. The ``HOT`` most frequent labels of a split cut its rows into at most ``2**HOT`` patterns. The
   rows of all patterns disjoint with an example's pattern are counted by a sum over subsets, so
   a draw never meets a row that shares a hot label.
2. ``draws`` seeded positions among those rows are fetched by an equi-join, and the first row that
   shares none of the other labels either is the partner. The first two draws come one by one, the
   later ones together, each only for the examples that have no partner yet.
3. Examples without one draw exactly, by rank among the rows of all disjoint sets. The distinct
   label sets are cut, in their order, into blocks; the examples' distinct sets meet each block
   that they may share no label with, and only the number of disjoint rows per (set, block) is
   kept. The rank names the block, and a second pass over that block names the set. The
   comparisons grow with (examples' sets) x (sets), but no pair of sets is ever stored or shuffled.

Each step is uniform over the admissible rows, so the whole is. No step compares rows with rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..functions.ranking import number_by_hash

WORD, HOT, DRAWS = 60, 8, 8
BLOCK_BITS = 13  # at most 2**13 distinct sets in a block
ASKS_PER_TASK = 50_000  # sets or examples that meet a block in one piece
SENT_SPLITS = 8  # splits whose table of patterns (at most 2**17 rows each) is sent to all tasks


# ---- sets as words -------------------------------------------------------------------------


def n_words(n_labels: int) -> int:
    return max(1, -(-n_labels // WORD))


def label_words(labels: Column, n_labels: int) -> Column:
    """Words of an ``array<int>`` of label ids (repeats and order do not matter; null gives null)."""

    def word(w):
        bits = F.transform(
            F.filter(F.array_distinct(labels), lambda x: F.floor(x / WORD) == w),
            lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % WORD).cast("int")),
        )
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))

    return F.transform(F.sequence(F.lit(0), F.lit(n_words(n_labels) - 1)), word)


def flag_words(label_cols: list[str]) -> Column:
    """Words of 0/1 (or boolean) flag columns; a null flag counts as not set."""
    words = []
    for at in range(0, max(1, len(label_cols)), WORD):
        word = F.lit(0).cast("bigint")
        for i, c in enumerate(label_cols[at : at + WORD]):
            word = word + F.when(F.col(c).cast("int") == 1, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        words.append(word)
    return F.array(*words)


def both(a: Column, b: Column) -> Column:
    """Labels of both sets."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    """Labels of either set."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def is_empty(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def disjoint(a: Column, b: Column) -> Column:
    return is_empty(both(a, b))


def n_set(a: Column) -> Column:
    """Number of labels in the set."""
    return F.aggregate(F.transform(a, lambda x: F.bit_count(x).cast("int")), F.lit(0), lambda acc, n: acc + n)


def holds(a: Column, label: Column) -> Column:
    word = F.get(a, F.floor(label / WORD).cast("int"))
    return F.call_function("shiftright", word, (label % WORD).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def label_ids(a: Column) -> Column:
    """The set as a sorted ``array<int>``."""
    every = F.sequence(F.lit(0), F.size(a) * WORD - 1)
    return F.filter(every, lambda i: holds(a, i))


def is_words(df: DataFrame, col: str) -> bool:
    """Whether the column holds words (and not a ``label_mask`` of at most 62 labels)."""
    return df.schema[col].dataType.simpleString() == "array<bigint>"


def has_label(df: DataFrame, col: str) -> Column:
    """Rows with at least one label, for words and for masks."""
    return ~is_empty(F.col(col)) if is_words(df, col) else F.col(col) != 0


# ---- partners with no common label ---------------------------------------------------------


def _hot_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per split the ``HOT`` labels of most rows, the most frequent first (ties by label)."""
    counts = rows.select(*keys, F.explode(label_ids(F.col("_set"))).alias("_label")).groupBy(*keys, "_label").agg(
        F.count(F.lit(1)).alias("_n"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_label"))
    top = counts.withColumn("_rank", order).where(F.col("_rank") <= HOT)
    return top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_label"))), lambda s: s["_label"]).alias("_hot"))


def _placed(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_pat`` (which hot labels the set holds)."""
    out = df.join(hot, keys, "left").withColumn("_hot", F.coalesce("_hot", F.array().cast("array<int>")))
    bits = F.transform("_hot", lambda x, i: F.when(holds(F.col("_set"), x), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return out.withColumn("_pat", F.aggregate(bits, F.lit(0), lambda acc, b: acc + b)).drop("_hot")


def _free_patterns(pat: Column) -> Column:
    """Patterns that share no hot label with ``pat``."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << HOT) - 1)), lambda p: p.bitwiseAND(pat) == 0)


def disjoint_partners(
    ex: DataFrame,
    rows: DataFrame,
    split_keys: list[str],
    seed: int,
    set_col: str = "label_words",
    id_col: str = "row_id",
    out_id: str = "neg_row_id",
    on_empty: str = "skip",
    bits: int | None = None,
    tag: str = "neg",
    draws: int = DRAWS,
) -> DataFrame:
    """``ex`` with ``out_id``: a uniform row of the split whose label set shares no label with the
    example's. ``ex`` has the split keys, ``iteration``, ``id_col`` and ``set_col``; ids are unique
    in a split. Examples with no such row fail (``on_empty='raise'``) or are left out (``'skip'``).
    Unlabelled rows share a label with none. Rows with a null set or id are no partners and have none."""
    if on_empty not in ("raise", "skip"):
        raise ValueError("on_empty is 'raise' or 'skip'")
    keys = [f"_k{i}" for i in range(max(1, len(split_keys)))]
    split = [F.col(k).alias(n) for k, n in zip(split_keys, keys)] or [F.lit(0).alias(keys[0])]
    base = rows.select(*split, F.col(id_col).alias("_id"), F.col(set_col).alias("_set")).where("_set is not null and _id is not null").checkpoint()
    hot = _hot_labels(base, keys).checkpoint()
    laid = _placed(base, hot, keys).withColumn("_hp", h60(F.lit("pos"), F.col("_id"))).checkpoint()  # read six times
    # the same example key decides every draw, as in the other partner draws
    part = [F.col(k) for k in (keys if split_keys else [])]

    def draw(*more):
        return h60(F.lit(int(seed)), *part, F.col("_it"), F.col("_id"), F.lit(tag), *more)

    asked = _placed(
        ex.select(*split, F.col("iteration").alias("_it"), F.col(id_col).alias("_id"), F.col(set_col).alias("_set")).where("_set is not null"), hot, keys)
    counts = laid.groupBy(*keys, "_pat").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    # a pattern's admissible rows: those of the patterns that are subsets of its complement
    split_rows = counts.select(*keys).distinct()
    # the table of patterns has a fixed size per split: with few splits every task gets it
    sent = F.broadcast if split_rows.count() <= SENT_SPLITS else (lambda df: df)
    pats = split_rows.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit((1 << HOT) - 1))))
    free = pats.withColumn("_pat", F.explode(_free_patterns(F.col("_a")))).join(counts, [*keys, "_pat"])
    spread, totals = (t.checkpoint() for t in _bins(free, keys, "_pat"))
    there = number_by_hash(laid, [*keys, "_pat"], "_hp", "_id", out="_p", bits=bits).select(
        *keys, "_pat", "_p", F.col("_id").alias("_other"), F.col("_set").alias("_other_set")).checkpoint()

    def shoot(some: DataFrame, draws: list[int]) -> DataFrame:
        shots = (
            some.join(sent(totals), [*keys, "_a"])
            .select(*keys, "_it", "_id", "_set", "_a", "_tot", "_nb", F.explode(F.array(*[F.lit(j) for j in draws])).alias("_j"))
            .withColumn("_r", draw(F.col("_j")) % F.col("_tot"))
            .withColumn("_bin", _bin_of(F.col("_r")))
            .join(sent(spread), [*keys, "_a", "_bin"]).where("_r >= _lo and _r < _hi")
            .select(*keys, "_it", "_id", "_set", "_a", "_j", "_pat", (F.col("_r") - F.col("_lo")).alias("_p"))
        )
        first = F.min(F.when(disjoint(F.col("_set"), F.col("_other_set")), F.struct("_j", "_other")))
        return (
            shots.join(there, [*keys, "_pat", "_p"])
            .groupBy(*keys, "_it", "_id").agg(first.alias("_first"), F.any_value("_set").alias("_set"), F.any_value("_a").alias("_a"))
            .select(*keys, "_it", "_id", "_set", "_a", F.col("_first._other").alias("_other"))
            .checkpoint()
        )

    # most examples have a partner after one or two draws: only the others draw again
    some, rounds = asked.withColumnRenamed("_pat", "_a"), []
    for js in ([0], [1], list(range(2, draws))):
        if js[-1:] and js[-1] < draws:
            rounds.append(shoot(some, js))
            some = rounds[-1].where("_other is null").drop("_other")
    drawn = rounds[-1]
    for r in rounds[:-1]:
        drawn = drawn.unionByName(r.where("_other is not null"))
    drawn = drawn.drop("_a")
    rest = drawn.where("_other is null").drop("_other")
    found = drawn.where("_other is not null").drop("_set").unionByName(_exact(rest, laid, keys, draw, bits))
    found = found.select(*[F.col(n).alias(k) for k, n in zip(split_keys, keys)], F.col("_it").alias("iteration"), F.col("_id").alias(id_col), F.col("_other").alias(out_id))
    if on_empty == "raise":
        lacking = ex.join(found, [*split_keys, "iteration", id_col], "left_anti").select(*split_keys, id_col).limit(5).collect()
        if lacking:
            raise ValueError(f"row(s) with no disjoint-label partner: {[r.asDict() for r in lacking]}")
    return ex.join(found, [*split_keys, "iteration", id_col]).select(*ex.columns, out_id)


def _bin_of(rank: Column) -> Column:
    return F.call_function("div", rank * F.col("_nb"), F.col("_tot"))


def _bins(parts: DataFrame, keys: list[str], part: str) -> tuple[DataFrame, DataFrame]:
    """Parts ``(_a, part, _n)`` laid end to end per ``_a`` and cut into as many equal bins as there
    are parts, so that a rank finds its part by an equi-join on its bin: a part lies in few bins, a
    bin in few parts. Returns the parts by bin, and ``_tot`` and ``_nb`` per ``_a``."""
    own = Window.partitionBy(*keys, "_a")
    ranked = (
        parts.withColumn("_hi", F.sum("_n").over(own.orderBy(part)))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("_tot", F.sum("_n").over(own))
        .withColumn("_nb", F.count(F.lit(1)).over(own))
    )
    spread = ranked.select(*keys, "_a", part, "_lo", "_hi", F.explode(F.sequence(_bin_of(F.col("_lo")), _bin_of(F.col("_hi") - 1))).alias("_bin"))
    return spread, parts.groupBy(*keys, "_a").agg(F.sum("_n").alias("_tot"), F.count(F.lit(1)).alias("_nb"))


def _blocks(laid: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct label sets ``(keys, _blk, _s, _n rows)`` in blocks numbered in the order of the sets,
    and per block the labels that all its sets hold (``_common``)."""
    known = laid.where(~F.exists("_set", lambda x: x.isNull()))  # a word of null is disjoint with none
    sets = known.groupBy(*keys, F.col("_set").alias("_s")).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    parts = max(1, -(-sets.count() >> BLOCK_BITS))
    sets = sets.repartitionByRange(parts, *keys, "_s").sortWithinPartitions(*keys, "_s")
    # ids rise along the sorted partitions, whose first ids are multiples of 2**33
    sets = sets.withColumn("_blk", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)).checkpoint()
    words = sets.select(*keys, "_blk", F.posexplode("_s").alias("_w", "_c")).groupBy(*keys, "_blk", "_w").agg(F.bit_and("_c").alias("_c"))
    common = words.groupBy(*keys, "_blk").agg(F.transform(F.sort_array(F.collect_list(F.struct("_w", "_c"))), lambda s: s["_c"]).alias("_common"))
    return sets, common


def _free(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sets of ``a`` share no label with which of ``b`` (one row a set, one column a word)."""
    free = (a[:, 0, None] & b[None, :, 0]) == 0
    for w in range(1, a.shape[1]):
        free &= (a[:, w, None] & b[None, :, w]) == 0
    return free


def _count_free(sets: np.ndarray, n: np.ndarray, part: pa.RecordBatch):
    """``_n``: rows of the block's sets that are disjoint with the asked set; sets with none go."""
    asks = _matrix(part.column("_s"))
    total = np.zeros(len(asks), np.int64)
    for lo in range(0, len(sets), 512):
        some, weights = sets[lo : lo + 512], n[lo : lo + 512].astype(np.float64)
        near = np.flatnonzero(((asks & np.bitwise_and.reduce(some, axis=0)) == 0).all(axis=1))
        for at in range(0, len(near), 2048):
            i = near[at : at + 2048]
            total[i] += (_free(asks[i], some) @ weights).astype(np.int64)
    keep = pa.array(total > 0)
    return part.column("_pass").filter(keep), part.column("_s").filter(keep), pa.array(total[total > 0])


def _pick_free(sets: np.ndarray, n: np.ndarray, part: pa.RecordBatch):
    """``_s``: the set that holds the row of rank ``_n`` among the rows of the block's sets that are
    disjoint with the asked set (asked sets come in order); ``_n``: its rank in that set."""
    asks, ranks = _matrix(part.column("_s")), part.column("_n").to_numpy()
    new = np.r_[True, (asks[1:] != asks[:-1]).any(axis=1)]
    which, distinct = np.cumsum(new) - 1, asks[new]
    col, left = np.zeros(len(asks), np.int64), np.zeros(len(asks), np.int64)
    step = max(1, (1 << 20) // len(sets))
    for lo in range(0, len(distinct), step):
        upto = np.cumsum(np.where(_free(distinct[lo : lo + step], sets), n, 0), axis=1)
        base = np.r_[0, np.cumsum(upto[:, -1])[:-1]]
        i = np.flatnonzero((which >= lo) & (which < lo + step))
        row = which[i] - lo
        col[i] = np.searchsorted((upto + base[:, None]).ravel(), base[row] + ranks[i], "right") - row * len(sets)
        left[i] = ranks[i] - (upto[row, col[i]] - n[col[i]])
    found = pa.ListArray.from_arrays(np.arange(0, sets.shape[1] * len(asks) + 1, sets.shape[1], dtype=np.int32), pa.array(sets[col].ravel()))
    return part.column("_pass"), found, pa.array(left)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _meet(asks: DataFrame, blocks: DataFrame, keys: list[str], passed: list[str], kernel) -> DataFrame:
    """``kernel`` over the asks ``(keys, _blk, _s, _n, passed)`` and the sets of their block:
    ``(passed, _s, _n)``. A task streams the asks of a piece past one block, which it holds."""
    pieces = asks.groupBy(*keys, "_blk").agg(F.ceil(F.count(F.lit(1)) / ASKS_PER_TASK).alias("_parts"))
    units = pieces.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    units = units.withColumn("_unit", F.monotonically_increasing_id()).checkpoint()
    dealt = asks.join(F.broadcast(units.where("_part = 0").drop("_part", "_unit")), [*keys, "_blk"])
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("_s", "_n", *passed), "_parts")).join(F.broadcast(units.drop("_parts")), [*keys, "_blk", "_part"])
    dealt = dealt.select("_unit", F.lit(1).alias("_kind"), "_s", "_n", F.struct(*passed).alias("_pass"))
    held = blocks.join(F.broadcast(units), [*keys, "_blk"]).select(
        "_unit", F.lit(0).alias("_kind"), "_s", "_n", F.lit(None).cast(dealt.schema["_pass"].dataType).alias("_pass"))
    spread = held.unionByName(dealt).repartition(4 * max(asks.sparkSession.sparkContext.defaultParallelism, 1), "_unit")

    def run(batches):
        unit, sets, n = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            at, kind = b.column("_unit").to_numpy(), b.column("_kind").to_numpy()
            cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1]), True])
            for s, e in zip(cut[:-1], cut[1:]):
                part = b.slice(s, e - s)
                if at[s] != unit:
                    unit, sets, n = at[s], [], []
                if kind[s] == 0:
                    sets.append(_matrix(part.column("_s")))
                    n.append(part.column("_n").to_numpy())
                else:
                    sets, n = [np.concatenate(sets)], [np.concatenate(n)]
                    yield pa.RecordBatch.from_arrays(list(kernel(sets[0], n[0], part)), ["_pass", "_s", "_n"])

    schema = dealt.select("_pass", "_s", "_n").schema
    return spread.sortWithinPartitions("_unit", "_kind", "_s").mapInArrow(run, schema).select("_pass.*", "_s", "_n")


def _exact(rest: DataFrame, laid: DataFrame, keys: list[str], draw, bits: int | None) -> DataFrame:
    """Partners of the examples whose draws all shared a label, by rank among all admissible rows."""
    rest = rest.checkpoint()  # read twice
    blocks, common = _blocks(laid, keys)
    asks = rest.select(*keys, F.col("_set").alias("_s")).distinct().join(F.broadcast(common), keys).where(disjoint(F.col("_s"), F.col("_common")))
    asks = asks.select(*keys, "_blk", "_s", F.lit(0).cast("bigint").alias("_n"))
    counted = _meet(asks, blocks, keys, [*keys, "_blk"], _count_free).withColumnRenamed("_s", "_a").checkpoint()
    spread, totals = _bins(counted, keys, "_blk")
    ranks = rest.withColumnRenamed("_set", "_a").join(totals, [*keys, "_a"]).withColumn("_r", draw(F.lit("rest")) % F.col("_tot"))
    ranks = ranks.select(*keys, "_it", "_id", "_a", "_r", _bin_of(F.col("_r")).alias("_bin"))
    hit = ranks.join(spread, [*keys, "_a", "_bin"]).where("_r >= _lo and _r < _hi").select(
        *keys, "_blk", "_it", "_id", F.col("_a").alias("_s"), (F.col("_r") - F.col("_lo")).alias("_n")).checkpoint()
    hit = _meet(hit, blocks, keys, [*keys, "_it", "_id"], _pick_free).withColumnsRenamed({"_s": "_b", "_n": "_p"})
    there = number_by_hash(laid, [*keys, "_set"], "_hp", "_id", out="_p", bits=bits).select(
        *keys, F.col("_set").alias("_b"), "_p", F.col("_id").alias("_other"))
    return hit.join(there, [*keys, "_b", "_p"]).select(*keys, "_it", "_id", "_other")
