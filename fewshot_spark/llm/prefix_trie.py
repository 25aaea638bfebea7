"""Conversation prefix trie from adaptive radix trees over turn ids.

A turn's id is the 16-byte digest of its role and text, so texts are read in the scan stage and
never shuffled. A conversation's key is the ids of its turns one after another, big-endian, so keys
sort turn by turn. Equal keys are counted first: their conversation ids meet in chunks of ids near
each other (4,096 numbers), each one string, so a conversation with very many copies is as many
short rows. Chunks are dealt by key ranges and sorted; a task puts bounded batches of keys into
an adaptive radix tree (``radix``) and returns the nodes that lie whole in a batch. The nodes that
batches share, two paths a batch, are added up in key order from one row a batch.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import sized
from .radix import WIDTH, Merger, Tree

CHUNK_IDS, BATCH_KEYS, BATCH_BYTES = 4096, 32_768, 32 << 20
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _fields(text: str) -> dict[str, str]:
    return dict(x.split() for x in text.split(", "))


_SUMS = "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id binary"
_CLOSED = _fields(f"conv_id long, depth long, parent_conv_id long, parent_digest binary, {_SUMS}")
_SETTLED = _fields(f"digest binary, parent_digest binary, conv_id long, depth long, {_SUMS}")
_OPEN = _fields("depth int, digest binary, length long, members long, low long, children long, leaves long, saved long, ends string, id binary")


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(k, _ARROW[v]) for k, v in fields.items()])


_PATH = pa.list_(pa.struct(list(_schema(_OPEN))))
_PARTS = pa.schema([*_schema(_CLOSED), ("first_key", pa.binary()), ("first", _PATH), ("last", _PATH)])
_PARTS_DDL = f"{_ddl(_CLOSED)}, first_key binary, first array<struct<{_ddl(_OPEN)}>>, last array<struct<{_ddl(_OPEN)}>>"


def turn_id(role: Column, text: Column) -> Column:
    """Digest of a turn as 32 hexadecimal digits; the role's length keeps the two apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order (null first, equal turn numbers by
    digest), as ``(turn, id, length)`` with the text's code points. Rows without a conversation id
    are left out; null role or text is empty; each repeated row is a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    one = F.struct(F.col(turn_col).alias("turn"), turn_id(role, text).alias("id"), F.length(text).alias("length"))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), one.alias("one")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def grafted(convs: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation ``c - c % family`` (none if
    it is absent), then its own after its first h; h is crc32(c as text) % ``most``."""
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    whole = convs.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    begun = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return whole.select("conv_id", F.concat(begun, own).alias("turns"))


def _chunks(convs: DataFrame) -> DataFrame:
    """Equal conversations as chunks: ``key, lens, chunk, n, low, ids``."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keyed = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["length"]).alias("lens"))
    return keyed.groupBy("key", F.floor(F.col("conv_id") / CHUNK_IDS).alias("chunk")).agg(
        F.any_value("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"),
    )


def _records(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _grow(batches):
    """Trees of sorted chunks; yields closed nodes and one row of open nodes for each tree."""

    def harvest(tree: Tree):
        closed, first, last = tree.rows()
        first, last = ([dict(zip(_OPEN, x, strict=True)) for x in path] for path in (first, last))
        rows = [(*x, None, None, None) for x in closed] + [(*[None] * len(_CLOSED), tree.first, first, last)]
        for at in range(0, len(rows), 20_000):
            yield _records(rows[at : at + 20_000], _PARTS)

    tree, key, lens, n, low, sha = Tree(), None, None, 0, None, None
    for b in batches:
        for k, ln, m, lo, ids in zip(*(b.column(c).to_pylist() for c in ("key", "lens", "n", "low", "ids")), strict=True):
            if k == key:
                sha.update(b",")
                n, low = n + m, min(low, lo)
            else:
                if key is not None:
                    tree.insert(key, lens, (n, low, sha.hexdigest()))
                    if tree.size >= BATCH_KEYS or tree.held >= BATCH_BYTES:
                        yield from harvest(tree)
                        tree = Tree()
                key, lens, n, low, sha = k, ln, m, lo, hashlib.sha256()
            sha.update(ids.encode())
    if key is not None:
        tree.insert(key, lens, (n, low, sha.hexdigest()))
        yield from harvest(tree)


def _settle(batches):
    """Open nodes of all trees, in key order, added up to final nodes."""
    kind = _schema(_SETTLED)
    merger = Merger()
    for b in batches:
        for first, last in zip(b.column("first").to_pylist(), b.column("last").to_pylist(), strict=True):
            done = merger.take(*([tuple(x.values()) for x in path] for path in (first, last)))
            if done:
                yield _records(done, kind)
    yield _records(merger.leave(0), kind)


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of ``convs`` (``conv_id, turns`` as
    ``conversations`` gives them; ids distinct), the empty one included:

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's smallest member; root
    null), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes at or below),
    ``saved_tokens`` (summed at and below: members but one times the code points of the last
    text), ``ends_sha256`` (of the ids of the conversations that end here, ascending, with
    commas), ``turn_id`` (digest of the last turn; root: empty). A conversation without turns
    belongs to the root. No conversation: no nodes. One conversation's key (16 bytes a turn) has
    to fit a task; nothing else grows with a key's copies, members or children."""
    chunks = _chunks(convs).checkpoint()
    dealt = chunks.repartitionByRange("key").sortWithinPartitions("key", "chunk")
    parts = dealt.select("key", "lens", "n", "low", "ids").mapInArrow(_grow, _PARTS_DDL).checkpoint()
    open_rows = parts.where("first is not null").select("first_key", "first", "last")
    settled = open_rows.repartition(1).sortWithinPartitions("first_key").select("first", "last").mapInArrow(_settle, _ddl(_SETTLED)).checkpoint()
    closed = parts.where("first is null").select(*_CLOSED)
    lows = sized(settled.select(F.col("digest").alias("up_digest"), F.col("conv_id").alias("up_id")))
    both = closed.unionByName(settled.drop("digest").withColumn("parent_conv_id", F.lit(None).cast("long")))
    found = both.join(lows, F.col("parent_digest") == F.col("up_digest"), "left")
    return found.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"
    )
