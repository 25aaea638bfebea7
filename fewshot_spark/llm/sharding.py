"""Resharding by minimum-cost flow.

Rows lie in old shards of uneven size; new capacities are given in bytes. The flow network has an
edge from every old to every new shard, at cost 0 per byte for staying and 1 for moving, so its
cheapest flow moves the fewest bytes. Each old shard's rows have a fixed order (large size classes
first, equal texts side by side); the flow cuts that order into consecutive blocks, the first of
which stays. Prefix sums are taken over fixed buckets of that order, so no task holds a shard.
Only shard totals (shards x 1 rows) and the flow's edges (at most shards old + new) pass the
driver. ``rewrite`` then writes only the shards that gave or took rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUB, SALT = 16, 32
TASK_BYTES = 64 << 20


def _stay_or_move(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Primal-dual flow for costs 0 (stay) and 1 (move): all residual paths of cost 0 are saturated
    first, which are the shards' own edges; then every path from what is left to what is free costs
    1, through the one hub that all moves share, so a single sweep over both sides is a blocking
    flow of that level. No residual path is cheaper, so the flow is optimal. Linear in the shards."""
    flow = {(k, k): min(a, b) for k, (a, b) in enumerate(zip(supply, capacity, strict=False)) if min(a, b)}
    left = [[k, n - flow.get((k, k), 0)] for k, n in enumerate(supply)]
    free = [[k, n - flow.get((k, k), 0)] for k, n in enumerate(capacity)]
    left, free = [x for x in left if x[1]], [x for x in free if x[1]]
    t = 0
    for s, n in left:
        while n:
            step = min(n, free[t][1])
            flow[s, free[t][0]] = step
            n -= step
            free[t][1] -= step
            t += not free[t][1]
    return dict(sorted(flow.items()))


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Cheapest integer flow from supplies to capacities. Without ``cost`` a byte costs 0 in its own
    shard and 1 elsewhere (two levels of shortest paths, linear in the shards); with ``cost(old, new)``
    successive shortest paths are used, meant for tens of shards.

    ``sum(capacity)`` must not be below ``sum(supply)``. Returns the bytes per (old, new) edge."""
    if sum(capacity) < sum(supply):
        raise ValueError("capacities are below the supply")
    if cost is None:
        return _stay_or_move(supply, capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    olds, news = range(len(supply)), range(len(capacity))
    while any(left):
        dist = {("o", s): (0, None) for s in olds if left[s]}
        changed = True
        while changed:  # Bellman-Ford on the residual network
            changed = False
            for s in olds:
                if ("o", s) in dist:
                    for t in news:
                        d = dist[("o", s)][0] + cost(s, t)
                        if d < dist.get(("n", t), (float("inf"),))[0]:
                            dist[("n", t)], changed = (d, ("o", s)), True
            for (s, t), f in flow.items():
                if f and ("n", t) in dist:
                    d = dist[("n", t)][0] - cost(s, t)
                    if d < dist.get(("o", s), (float("inf"),))[0]:
                        dist[("o", s)], changed = (d, ("n", t)), True
        end = min((n for n in dist if n[0] == "n" and room[n[1]]), key=lambda n: (dist[n][0], n[1]))
        path = [end]
        while dist[path[-1]][1] is not None:
            path.append(dist[path[-1]][1])
        path.reverse()
        step = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "n":
                step = min(step, flow[(b[1], a[1])])
        for a, b in zip(path, path[1:], strict=False):
            edge = (a[1], b[1]) if a[0] == "o" else (b[1], a[1])
            flow[edge] = flow.get(edge, 0) + (step if a[0] == "o" else -step)
        left[path[0][1]] -= step
        room[end[1]] -= step
    return {e: f for e, f in sorted(flow.items()) if f}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def reshard(
    rows: DataFrame,
    shards: int,
    capacities: list[int] | None = None,
    id_col: str = "doc_id",
    size_col: str = "size",
    group_col: str = "text_crc32",
    shard_col: str = "old_shard",
) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` for every row of ``rows``.

    ``old_shard`` counts from 0 and may have more or fewer values than ``shards``. Without
    ``capacities`` (bytes per new shard) all are equal, to one byte. A block's end is rounded to
    the nearest row, so a shard differs from its capacity by at most half a row per cut. ``slot``
    is gapless from 0 in each new shard. Null ids and repeated rows are placed like any other;
    sizes must be positive. No rows give no rows."""
    src = rows.select(
        F.col(id_col).alias("doc_id"), F.col(size_col).cast("long").alias("size"),
        F.col(group_col).alias("text_crc32"), F.col(shard_col).cast("int").alias("old_shard"),
    )
    src = (
        src.withColumn("b1", -F.floor(F.log2("size")).cast("int"))
        .withColumn("b2", F.pmod(F.xxhash64("text_crc32"), F.lit(SUB)).cast("int"))
        .withColumn("b3", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALT)).cast("int"))
        .checkpoint()
    )
    bucket = ["old_shard", "b1", "b2", "b3"]
    sums = src.groupBy(*bucket).agg(F.sum("size").alias("bytes"))
    totals = {r[0]: r[1] for r in sums.groupBy("old_shard").agg(F.sum("bytes")).collect()}
    n_old = max([shards - 1, *totals]) + 1
    supply = [totals.get(k, 0) for k in range(n_old)]
    want = capacities or equal_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, want)
    cuts = []
    for s in range(n_old):
        at = 0
        for t in sorted((t for o, t in flow if o == s), key=lambda t: (t != s, t)):
            cuts.append((s, t, at, at + flow[(s, t)]))
            at += flow[(s, t)]
    plan = rows.sparkSession.createDataFrame(cuts, "old_shard int, shard int, lo long, hi long")
    order = Window.partitionBy("old_shard").orderBy("b1", "b2", "b3").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).drop("bytes")
    inside = Window.partitionBy(*bucket).orderBy(F.desc("size"), "text_crc32", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        src.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, bucket)
        .withColumn("mid", F.col("before") + F.col("upto") - F.floor((F.col("size") + 1) / 2))
        .join(F.broadcast(plan).withColumnRenamed("old_shard", "p_old"), (F.col("old_shard") == F.col("p_old")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")))
        .select("doc_id", "size", "text_crc32", "old_shard", "shard", "b1", "b2", "b3")
        .checkpoint()
    )
    own = ["shard", *bucket]
    counts = placed.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    inside = Window.partitionBy(*own).orderBy(F.desc("size"), "text_crc32", "doc_id")
    return (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(counts, own)
        .select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))
    )


def rewrite(spark: SparkSession, old: DataFrame, placed: DataFrame, root: str, generation: int, paths: dict[int, str] | None = None) -> dict[int, str]:
    """Write the shards that gave or took rows below ``root`` and return each shard's folder.

    ``old`` has the whole rows with ``doc_id`` and ``old_shard``; ``placed`` is ``reshard``'s
    result; ``paths`` the folders of the present shards. A shard without moves keeps its folder and
    none of its files is read; one that has no folder yet is written. New folders are written
    beside the old ones, so a job lost midway leaves the old generation whole; the caller switches
    once this returns.

    Ids may be null or repeated: each row takes the place of one planned row of its id and old
    shard and, where ``old`` has the columns ``size`` and ``text_crc32`` (they are not written), of
    the same size and text, numbered among equals. Without these, rows of one id in one old shard
    may trade places; none is lost. Rows and plan meet in one shuffle of the whole rows, in tasks
    of about 64 MB, each of which writes a file per shard, ordered by ``slot``."""
    have = paths or {}
    pairs = placed.groupBy("old_shard", "shard").agg(F.sum("size")).collect()
    moves = {x for o, t, _ in pairs if o != t for x in (o, t)}
    affected = sorted(moves | {o for o, _, _ in pairs if o not in have})
    out = f"{root.rstrip('/')}/generation={generation}"
    if affected:
        own = [c for c in ("size", "text_crc32") if c in old.columns]
        key = F.struct("doc_id", "old_shard", *[F.col(c).cast("long").alias(c) for c in own]).alias("key")
        payload = [c for c in old.columns if c not in ("old_shard", *own)]
        rows = old.where(F.col("old_shard").isin(affected)).select(key, F.struct(*payload).alias("row"), F.xxhash64(*payload).alias("nth"))
        plan = placed.where(F.col("old_shard").isin(affected)).select(key, "shard", "slot", F.col("slot").alias("nth"))
        tasks = max(1, -(-sum(r[2] for r in pairs if r[0] in affected) // TASK_BYTES))
        both = rows.unionByName(plan, allowMissingColumns=True).withColumn("planned", F.col("row").isNull()).repartition(tasks, "key")
        both = both.withColumn("n", F.row_number().over(Window.partitionBy("key", "planned").orderBy("nth", "shard")))
        met = Window.partitionBy("key", "n")
        both = both.withColumn("place", F.max(F.when(F.col("planned"), F.struct("shard", "slot"))).over(met)).where("not planned")
        place = F.when(F.col("place").isNull(), F.raise_error(F.lit("a row of old is not in placed"))).otherwise(F.col("place.shard"))
        part = both.select("row.*", place.cast("int").alias("shard"), F.col("place.slot").alias("slot"))
        part.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(out)
    return {**have, **{s: f"{out}/shard={s}" for s in affected}}
