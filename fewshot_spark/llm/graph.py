"""Connected components and block cells as Spark jobs.

``components``: alternating large-star and small-star steps. Each round is a partial aggregation
(minimum neighbour) and an equi-join on the node, written with ``checkpoint()`` to the shared
folder; the driver sees two numbers per round. Hub nodes are joined, not collected, so a node
with a third of all links is split by the adaptive skew join.

``blocks``, ``to_cells``: rows of one group are dealt to blocks of bounded size by a hash, and every pair of
blocks becomes a cell; a group's pairs are then all met within cells of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A join side of a few narrow columns: broadcast where a count shows at most ``most`` rows,
    else left to an ordinary (shuffled, skew-split) join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node id
    reachable. Self links and repeated links are harmless; nulls are ignored; no rows give none."""
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def blocks(df: DataFrame, group: list[str], member: str, size: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """Rows of groups of two or more members, with ``n_blocks`` of the group and the row's ``block``.
    A group up to ``size`` rows is one block; a larger one has n blocks, n(n+1)/2 cells of block
    pairs, and each row goes to the n cells of its block (``to_cells``). With ``weight``, a group
    whose weights add up to more than ``most`` has as many blocks as that sum needs."""
    w = Window.partitionBy(*group)
    parts = F.col("_n") / F.lit(size)
    if weight:
        parts = F.least(F.greatest(parts, F.sum(weight).over(w) / F.lit(most)), F.col("_n"))
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("n_blocks")).cast("int")
    return (
        df.withColumn("_n", F.count(F.lit(1)).over(w))
        .where("_n > 1")
        .withColumn("n_blocks", F.ceil(parts).cast("int"))
        .withColumn("block", mine)
        .drop("_n")
    )


def to_cells(df: DataFrame, group: list[str]) -> DataFrame:
    """Deal rows with ``block`` and ``n_blocks`` to their cells; each partition holds whole cells,
    sorted by ``group``, ``cell_i``, ``cell_j``."""
    keys = [*group, "cell_i", "cell_j"]
    return (
        df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("cell_i", F.least("block", "_other"))
        .withColumn("cell_j", F.greatest("block", "_other"))
        .drop("_other")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )


def whole_groups(batches, keys: list[str]):
    """From Arrow batches sorted by ``keys`` yield ``(table, [(start, end), ...])``: complete groups."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not len(table):
            continue
        change = np.zeros(len(table), bool)
        change[0] = True
        for k in keys:
            v = table[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table, list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    if held is not None and len(held):
        yield held, [(0, len(held))]


def clusters(n: int, near) -> list[int]:
    """Connected clusters of ``range(n)``: ``near(i, rest)`` tells which of ``rest`` touch ``i``.
    Returns the first member of each one's cluster."""
    import numpy as np

    first, rest = [-1] * n, np.arange(n)
    while len(rest):
        root = int(rest[0])
        first[root], rest, queue = root, rest[1:], [root]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            for x in rest[hit].tolist():
                first[x] = root
                queue.append(x)
            rest = rest[~hit]
    return first
