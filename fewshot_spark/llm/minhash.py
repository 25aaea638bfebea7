"""MinHash near-duplicates by a multi-index Hamming join.

Signature: 35 MinHash components of b = 16 bits. Distance: components that differ. The signature
is split into 7 chunks of 5 components. If two signatures differ in at most 13 components, some
chunk differs in at most one (pigeonhole: 7 chunks with 2 errors each would make 14). Every
allowed chunk error is enumerated by leaving out one component, which gives 35 keys of 4
components (64 bits); two signatures within distance 13 therefore share a key for certain. Pairs
that share a key are compared on the components' low 8 bits and kept up to a distance that a pair
at the similarity threshold exceeds with a chance below one in a million.

Whole plan: texts with equal shingle sets become one node (partial aggregation, so a group of
copies never meets in one task); nodes meet in key buckets, dealt to bounded blocks; each block
returns a spanning forest, never its pairs; the groups so found are confirmed on the full shingle
sets, again block by block, and the components of the confirmed links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import blocks, clusters, components, sized, to_cells, whole_groups
from .words import mix, shingles, word_hashes

COMPONENTS, CHUNKS, PER_CHUNK = 35, 7, 5
BUCKET_BLOCK, SET_BLOCK, SET_SHINGLES = 2000, 512, 2_000_000
_rng = np.random.default_rng(417)
_XOR = _rng.integers(0, 2**63, COMPONENTS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**62, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = mix(np.arange(1, CHUNKS * PER_CHUNK + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = [f"s{i}" for i in range(5)]


def kept_distance(percent: int) -> int:
    """Differing components up to which a pair that shares a key goes on to the exact check."""
    p = 1 - percent / 100
    return min(COMPONENTS, int(COMPONENTS * p + 5.2 * (COMPONENTS * p * (1 - p)) ** 0.5))


def set_key(s: np.ndarray) -> int:
    """One 64-bit hash of a whole shingle set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(s ^ _XOR[0])) + np.uint64(len(s)) * _MUL[0]
    return int(mix(np.array([total]))[0].astype(np.int64))


def _signatures(width: int):
    def run(batches):
        for b in batches:
            n = b.num_rows
            size, key = np.zeros(n, np.int64), np.zeros(n, np.int64)
            low = np.zeros((n, COMPONENTS), np.uint16)
            for i, _, h, counts in word_hashes(b.column(1)):
                at = np.concatenate([[0], np.cumsum(counts)])
                for k in np.flatnonzero(counts):
                    s = shingles(h[at[k] : at[k + 1]], width)
                    size[i + k], key[i + k] = len(s), set_key(s)
                    with np.errstate(over="ignore"):
                        m = np.array([((s ^ x) * y).min() for x, y in zip(_XOR, _MUL, strict=True)])
                    low[i + k] = (mix(m) & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(size), pa.array(key, mask=size == 0), pa.array([x.tobytes() for x in low])],
                ["doc_id", "text_key", "n_shingles", "skey", "sig"],
            )

    return run


def _keys(batches):
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        wide = sig.astype(np.uint64)
        low = np.zeros((len(sig), 40), np.uint8)
        low[:, :COMPONENTS] = sig.astype(np.uint8)
        low = low.view(np.int64)
        keys = np.empty((len(sig), CHUNKS * PER_CHUNK), np.uint64)
        for v in range(CHUNKS * PER_CHUNK):
            chunk, out = divmod(v, PER_CHUNK)
            packed = np.zeros(len(sig), np.uint64)
            for c in range(PER_CHUNK):
                if c != out:
                    packed = (packed << np.uint64(16)) | wide[:, chunk * PER_CHUNK + c]
            keys[:, v] = mix(packed ^ _SALT[v])
        per = CHUNKS * PER_CHUNK
        skey = b.column(0).to_numpy()
        for i in range(0, len(sig), 500):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[i : i + 500].ravel().view(np.int64)), pa.array(np.repeat(skey[i : i + 500], per))]
                + [pa.array(np.repeat(low[i : i + 500, c], per)) for c in range(5)],
                ["key", "skey", *_LOW],
            )


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def _bucket_links(keep: int):
    def run(batches):
        for table, groups in whole_groups(batches, ["key", "cell_i", "cell_j"]):
            skey = table["skey"].to_numpy()
            low = np.stack([table[c].to_numpy() for c in _LOW], 1).view(np.uint8)
            found = []
            for s, e in groups:
                sig = low[s:e]
                first = clusters(e - s, lambda i, rest, sig=sig: (sig[rest] != sig[i]).sum(1) <= keep)
                found += [(int(skey[s + f]), int(skey[s + k])) for k, f in enumerate(first) if f != k]
            yield _edges(found)

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            sets = [b""] * b.num_rows
            for i, _, h, counts in word_hashes(b.column(1)):
                at = np.concatenate([[0], np.cumsum(counts)])
                for k in np.flatnonzero(counts):
                    sets[i + k] = shingles(h[at[k] : at[k + 1]], width).tobytes()
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp"), part.column("skey"), part.column("n_blocks"), part.column("block"), pa.array(sets[i : i + 256], pa.binary())],
                    ["grp", "skey", "n_blocks", "block", "shingles"],
                )

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of some sets, by products of 0/1 blocks."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[ids] > 1
    owner, ids = owner[shared], ids[shared]
    ids = np.unique(ids, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    inter = np.zeros((n, n), np.float64)
    top = int(ids[-1]) + 1 if len(ids) else 0
    for v in range(0, top, 4096):
        s, e = np.searchsorted(ids, [v, v + 4096])
        m = np.zeros((n, min(4096, top - v)), np.float32)
        m[owner[s:e], ids[s:e] - v] = 1
        inter += m @ m.T
    return inter


def _confirmed(percent: int):
    def run(batches):
        for table, groups in whole_groups(batches, ["grp", "cell_i", "cell_j"]):
            skey, block = table["skey"].to_numpy(), table["block"].to_numpy()
            cross = (table["cell_i"].to_numpy() != table["cell_j"].to_numpy())
            found, raw = [], table["shingles"]
            for s, e in groups:
                at = s + np.unique(skey[s:e], return_index=True)[1]
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in at]
                sizes = np.array([len(x) for x in sets], np.float64)
                if len(at) == 2:
                    n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                    inter = np.array([[sizes[0], n], [n, sizes[1]]], np.float64)
                else:
                    inter = _intersections(sets)
                near = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
                if cross[s]:
                    near &= block[at][:, None] != block[at][None, :]
                first = clusters(len(at), lambda i, rest, near=near: near[i, rest])
                found += [(int(skey[at[f]]), int(skey[at[k]])) for k, f in enumerate(first) if f != k]
            yield _edges(found)

    return run


def _row():
    """Order of a class's rows: null ids last, then id and text hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, first`` for every row of ``docs``.

    Rows link where ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    ``component_id`` is the smallest id reachable; ``kept`` is ``doc_id = component_id``.
    Null and empty texts: 0 shingles, component = own id, kept. Rows with a null id keep a null
    ``kept``; they take part in links. ``first`` marks the rows of the smallest (id, ``text_key``
    = xxhash64 of the text) of a class, null ids last. Repeated rows are one class and all carry its id. Other
    columns are ignored, whatever their names. No rows give no rows."""
    keep = kept_distance(percent)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    keyed = src.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sigs = keyed.mapInArrow(
        _signatures(width), f"doc_id {id_type}, text_key long, n_shingles long, skey long, sig binary"
    ).checkpoint()
    nodes = (
        sigs.where("skey is not null")
        .groupBy("skey")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("carrier"), F.min(_row()).alias("first_row"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
        .checkpoint()
    )
    low = ", ".join(f"{c} long" for c in _LOW)
    buckets = blocks(nodes.select("skey", "sig").mapInArrow(_keys, f"key long, skey long, {low}"), ["key"], "skey", BUCKET_BLOCK)
    maybe = to_cells(buckets, ["key"]).mapInArrow(_bucket_links(keep), "a long, b long")
    groups = components(maybe).select(F.col("node").alias("skey"), F.col("component").alias("grp"))
    sized_groups = groups.join(nodes.select("skey", "carrier", "n_shingles"), "skey")
    wanted = (
        blocks(sized_groups, ["grp"], "skey", SET_BLOCK, "n_shingles", SET_SHINGLES)
        .select("grp", "skey", "n_blocks", "block", F.col("carrier.doc_id").alias("c_id"), F.col("carrier.text_key").alias("c_key"))
        .checkpoint()
    )
    texts = keyed.join(sized(wanted), (F.col("text_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
    sets = texts.select("grp", "text", "skey", "n_blocks", "block").mapInArrow(
        _sets(width), "grp long, skey long, n_blocks int, block int, shingles binary"
    )
    links = to_cells(sets, ["grp"]).mapInArrow(_confirmed(percent), "a long, b long")
    linked = components(links).select(F.col("node").alias("skey"), F.col("component").alias("comp"))
    lowest = linked.join(nodes, "skey").groupBy("comp").agg(F.min("first_row").alias("low_row"))
    classes = (
        nodes.select("skey", "first_row")
        .join(linked.join(lowest, "comp").select("skey", "low_row"), "skey", "left")
        .select("skey", F.coalesce("low_row", "first_row").alias("class_row"))
    )
    return (
        sigs.join(classes, "skey", "left")
        .withColumn("first", F.col("class_row").isNull() | (F.col("class_row") == _row()))
        .select("doc_id", "n_shingles", F.coalesce("class_row.doc_id", "doc_id").alias("component_id"), "text_key", "first")
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_key", "first")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class of near-duplicates does, with
    their own columns: the smallest id's (null ids last, then by a hash of the text), and one of
    rows equal in id and text. Rows without words all stay; so does a row whose id a dropped row
    shares. No rows give no rows."""
    judged = near_duplicates(docs, width, percent, id_col, text_col).where("n_shingles > 0").checkpoint()
    pair = [F.col("doc_id").alias("_near_id"), F.col("text_key").alias("_near_key")]
    same = F.col(id_col).eqNullSafe(F.col("_near_id")) & (F.xxhash64(F.col(text_col)) == F.col("_near_key"))
    left = docs.join(sized(judged.where("not first").select(*pair).distinct()), same, "left_anti")
    twice = judged.where("first").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair).checkpoint()
    if twice.isEmpty():
        return left
    once = left.join(sized(twice), same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(sized(twice), same, "left_anti").unionByName(once)
