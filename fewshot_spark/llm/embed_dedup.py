"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random orthogonal directions. Two unit vectors at
the cosine threshold differ by sqrt(2 - 2 cos) in length, so their difference on a direction is
about normal with that deviation. A query's window on a projection is centred on it, ``WIDTH``
deviations to either side; a vector inside collides. A pair is a candidate if it lies in the wider
windows (``LEAD`` deviations) of all ``SORTED`` leading projections and collides on enough of all:
the needed count is the largest one that a pair at the threshold still reaches with probability
0.99999 (``needed_count``). A pair at the threshold misses a leading window with a chance of 2.1e-5
each, so it is found with probability 0.9999 in all; closer pairs more surely (``joint_recall``).

The leading projections are cut into strips two of their windows wide; a vector is a member of the one
cell it lies in, and a query in the cells its windows touch (at most 2 per projection), so each
ordered pair meets in exactly one cell. Inside a cell, members are sorted by the first projection
and a query only sees its window. Cells are dealt to bounded blocks; a cell returns a link count
per query and a spanning forest of the links, never its pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, whole_groups

PROJECTIONS, SORTED, WIDTH, LEAD, BLOCK = 24, 4, 3.5, 4.25, 2000


def needed_count(window: float, deviation: float, projections: int, recall: float = 0.99999) -> int:
    """Largest collision count that a pair at the threshold reaches with at least ``recall``."""
    p = math.erf(window / deviation / math.sqrt(2))
    tail, k = 0.0, projections
    while k > 0:
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
        k -= 1
    return 0


def joint_recall(recall: float = 0.99999) -> float:
    """Least chance that a pair at the threshold passes the leading windows and the count."""
    return 1 - SORTED * math.erfc(LEAD / math.sqrt(2)) - (1 - recall)


@functools.lru_cache(maxsize=8)
def directions(dims: int) -> np.ndarray:
    """Rows: projections of a fixed seed, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(dims)
    rows = []
    while sum(map(len, rows)) < PROJECTIONS:
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        rows.append((q * np.sign(np.diag(r))).T * math.sqrt(dims))
    return np.concatenate(rows)[:PROJECTIONS]


def _matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _projected(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ directions(x.shape[1]).T


def _cells(window: float):
    """Names of the cells of every vector: its own (member) and those its windows touch (query)."""

    def run(batches):
        for b in batches:
            length = b.column(2).value_lengths().to_numpy()
            keys, groups = b.column(0).to_numpy(), b.column(1).to_pylist()
            out: list[tuple] = []
            for dims in np.unique(length).tolist():
                at = np.flatnonzero(length == dims)
                lead = _projected(_matrix(b.column(2).take(pa.array(at))))[:, :SORTED]
                low, high = np.floor((lead - window) / (2 * window)), np.floor((lead + window) / (2 * window))
                home = np.floor(lead / (2 * window))
                for i, k in enumerate(at):
                    cells = [()]
                    for a, z in zip(low[i], high[i], strict=True):
                        cells = [(*c, int(p)) for c in cells for p in range(int(a), int(z) + 1)]
                    own = tuple(int(p) for p in home[i])
                    out += [(f"{groups[k]}|{dims}|{c}", int(keys[k]), c == own) for c in cells]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["name", "vkey", "member"]
            )

    return run


def _count(cosine: float, window: float, lead: float, need: int):
    def run(batches):
        for table, groups in whole_groups(batches, ["cell", "mb", "qb"]):
            vkey, weight = table["vkey"].to_numpy(), table["copies"].to_numpy()
            mine, ask = table["is_member"].to_numpy(zero_copy_only=False), table["is_query"].to_numpy(zero_copy_only=False)
            got: list[tuple] = []
            for s, e in groups:
                if e - s < 2 or not mine[s:e].any() or not ask[s:e].any():
                    continue
                x = _matrix(table["v"].slice(s, e - s))
                proj = _projected(x)
                norm = np.linalg.norm(x / (top := np.abs(x).max(1, keepdims=True)), axis=1) * top[:, 0]
                keys, w = vkey[s:e], weight[s:e]
                members = np.flatnonzero(mine[s:e])
                members = members[np.argsort(proj[members, 0], kind="stable")]
                line = proj[members, 0]
                for q in np.flatnonzero(ask[s:e]):
                    a, z = np.searchsorted(line, [proj[q, 0] - lead, proj[q, 0] + lead], "left")
                    near = members[a:z]
                    near = near[keys[near] != keys[q]]
                    gap = np.abs(proj[near] - proj[q])
                    near = near[(gap[:, :SORTED] <= lead).all(1) & ((gap <= window).sum(1) >= need)]
                    if not len(near):
                        continue
                    cos = ((x[near] / norm[near, None]) * (x[q] / norm[q])).sum(1)
                    near = near[cos >= cosine]
                    if len(near):
                        got.append((int(keys[q]), int(w[near].sum()), keys[near]))
            links = _forest(got)
            cols = [[k for k, _, _ in got] + [a for a, _ in links], [n for _, n, _ in got] + [None] * len(links), [None] * len(got) + [b for _, b in links]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "n", "b"])

    return run


def _forest(got: list[tuple]) -> list[tuple[int, int]]:
    """Spanning links of the partners that the queries of one batch of cells found."""
    parent: dict[int, int] = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for key, _, partners in got:
        for other in partners.tolist():
            a, b = root(key), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((key, other))
    return links


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link where labels are equal and not null and the cosine in double precision is at least
    ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    of other lengths or with a null label, link with nothing: 0 links, component = own id, kept.
    Equal vectors of a label are one node with a weight; each of its rows counts the others.
    Rows with a null id count as links and keep a null id. Other columns are ignored. No rows give
    no rows."""
    deviation = math.sqrt(2 - 2 * cosine)
    window, lead = WIDTH * deviation, LEAD * deviation
    need = needed_count(window, deviation, PROJECTIONS)
    plain = vectors.select(vector_col).schema[0].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("vkey", F.when(F.col("label").isNotNull() & F.col("v").isNotNull(), F.xxhash64("label", "v")))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    src = src.withColumn("vkey", F.when(~F.coalesce(bad, F.lit(False)) & (F.size("v") > 0), F.col("vkey")))
    nodes = (
        src.where("vkey is not null")
        .groupBy("vkey")
        .agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .checkpoint()
    )
    placed = nodes.select("vkey", F.col("label").cast("string").alias("label"), "v").mapInArrow(
        _cells(lead), "name string, vkey long, member boolean"
    )
    placed = placed.select(F.xxhash64("name").alias("cell"), "vkey", "member")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("member").alias("any"))
    sizes = sizes.where("rows > 1 and any").select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("nb"))
    block = F.pmod(F.xxhash64("vkey", F.lit(3)), F.col("nb")).cast("int")
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    as_member = F.when(F.col("member"), F.transform(every, lambda k: F.struct(F.col("mine").alias("mb"), k.alias("qb"))))
    as_query = F.transform(every, lambda k: F.struct(k.alias("mb"), F.col("mine").alias("qb")))
    spots = F.array_distinct(F.concat(F.coalesce(as_member, F.array().cast("array<struct<mb:int,qb:int>>")), as_query))
    narrow = placed.join(sizes, "cell").withColumn("mine", block).withColumn("spot", F.explode(spots))
    # cells and blocks are settled on narrow rows; only then do vectors go to their cells, once
    dealt = (
        narrow.join(nodes.select("vkey", "copies", "v"), "vkey")
        .select(
            "cell", "spot.mb", "spot.qb", "vkey", "copies", "v",
            (F.col("member") & (F.col("mine") == F.col("spot.mb"))).alias("is_member"),
            (F.col("mine") == F.col("spot.qb")).alias("is_query"),
        )
        .repartition("cell", "mb", "qb")
        .sortWithinPartitions("cell", "mb", "qb")
    )
    found = dealt.mapInArrow(_count(cosine, window, lead, need), "a long, n long, b long").checkpoint()
    linked = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("vkey"), "component")
    counts = found.where("n is not null").groupBy(F.col("a").alias("vkey")).agg(F.sum("n").alias("others"))
    lowest = linked.join(nodes.select("vkey", "first_id"), "vkey").groupBy("component").agg(F.min("first_id").alias("low"))
    known = (
        nodes.select("vkey", "copies", "first_id")
        .join(counts, "vkey", "left")
        .join(linked.join(lowest, "component").select("vkey", "low"), "vkey", "left")
        .select("vkey", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("low", "first_id").alias("low"))
    )
    return (
        src.select("vec_id", "vkey")
        .join(known, "vkey", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
