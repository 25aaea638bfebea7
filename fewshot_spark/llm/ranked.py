"""Ranked lexical search by NRA (sequential impact-sorted reads only, no random access).

The corpus is searched in blocks of documents, where they are scanned: no posting is shuffled. A
block's postings of the items' terms are sorted by term and falling impact. For each item the lists
of its terms are read in step, impact by impact. What has been read is a document's lower score;
its upper score adds, for each list that it has not been seen in, the last impact read there. Reads
go on until no unseen document can come among the best, no other candidate can pass or tie with
them, and the scores of all remaining candidates are exact. A block returns its best documents per
item; these meet in two steps (salted, then per item).

A first pass counts documents, terms and the document frequencies of the items' terms. Items
are dealt to blocks of about ``BLOCK_PAIRS`` (item, term) pairs by a hash; the driver and every
task hold one block of items at a time, and each block scans the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_PAIRS, BLOCK_DOCS, BLOCK_HITS = 200_000, 16_384, 4_000_000
SLICE, FIRST_READ = 4 << 20, 64
# A term is a run of ASCII letters and digits and of all bytes beyond ASCII; only A-Z are lowered.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some megabytes of text at a time; a term is never cut."""
    at = 0
    while at < len(raw):
        part = raw[at : at + SLICE].translate(_TABLE)
        if at + SLICE < len(raw) and part[-1] != 32:
            cut = part.rfind(32)
            while cut < 0 and at + len(part) < len(raw):  # one term of more than a slice
                part += raw[at + len(part) : at + len(part) + SLICE].translate(_TABLE)
                cut = part.find(32, len(part) - SLICE)
            part = part[: cut + 1] if cut >= 0 else part
        yield part.split()
        at += len(part)


def _raw(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield x.as_py() or b""


def _item_terms(batches):
    for b in batches:
        rows: Counter = Counter()
        for k, raw in enumerate(_raw(b.column(1))):
            for part in terms(raw):
                rows.update((k, t) for t in part)
        at = pa.array([k for k, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([t for _, t in rows], pa.binary()), pa.array(rows.values(), pa.int64())], ["item_id", "term", "times"])


def _statistics(wanted: frozenset):
    """Rows (term, documents); with a null term first the documents, then all their terms."""

    def run(batches):
        docs = total = 0
        df: Counter = Counter()
        for b in batches:
            for raw in _raw(b.column(0)):
                n, held = 0, set()
                for part in terms(raw):
                    n += len(part)
                    held |= wanted.intersection(part)
                df.update(held)
                docs, total = docs + (n > 0), total + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, None, *df], pa.binary()), pa.array([docs, total, *df.values()], pa.int64()), pa.array([0, 1] + [2] * len(df), pa.int32())], ["term", "n", "kind"]
        )

    return run


class Lists:
    """Impact-sorted postings of a block of documents."""

    def __init__(self, hits: np.ndarray, doc: np.ndarray, norm: np.ndarray, n_terms: int):
        """``hits``: term number of every occurrence, ``doc``: its document; ``norm``: m by document."""
        key, tf = np.unique(doc * np.int64(n_terms) + hits, return_counts=True)
        term, doc = key % n_terms, key // n_terms
        impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * norm[doc])
        order = np.argsort((term << 21) - impact, kind="stable")  # an impact is below 1,000,000
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.n_docs = len(norm)

    def best(self, item: list[tuple[int, int]], k: int, tie: np.ndarray) -> list[tuple[int, int]]:
        """``(document, score)`` of the ``k`` best with a score above 0; ``item``: (term, weight);
        equal scores by ``tie``."""
        item = [(t, w) for t, w in item if w and self.start[t] < self.start[t + 1]]
        at = np.array([self.start[t] for t, _ in item])
        end = np.array([self.start[t + 1] for t, _ in item])
        weight = np.array([w for _, w in item], np.int64)
        lower = np.zeros(self.n_docs, np.int64)
        unseen = np.ones((len(item), self.n_docs), bool)
        live = np.ones(self.n_docs, bool)  # may still be among the best
        bound, step, alive = np.zeros(len(item), np.int64), FIRST_READ, None
        while (at < end).any():
            for j in np.flatnonzero(at < end):
                to = min(end[j], at[j] + step)
                doc, x = self.doc[at[j] : to], self.impact[at[j] : to]
                at[j], bound[j] = to, weight[j] * x[-1] if to < end[j] else 0
                if alive is not None:
                    keep = live[doc]
                    doc, x = doc[keep], x[keep]
                lower[doc] += weight[j] * x
                unseen[j, doc] = False
            step *= 4
            near = np.flatnonzero(live) if alive is None else alive
            low = lower[near]
            least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else 0
            upper = low + bound @ unseen[:, near]
            if least > 0:
                near = near[upper >= least]
                live[:] = False
                live[near] = True
                alive = near
            if least > 0 and (lower[near] == lower[near] + bound @ unseen[:, near]).all():
                break
        near = np.flatnonzero(live & (lower > 0))
        near = near[np.lexsort((tie[near], -lower[near]))][:k]
        return [(int(d), int(lower[d])) for d in near]


def _search(index: dict[bytes, int], weights: list[int], items: list[tuple[object, list[tuple[int, int]]]], docs_n: int, total: int, k: int, types: pa.Schema):
    def run(batches):
        ids: list = []
        sizes: list[int] = []
        hits: list[np.ndarray] = []
        held = 0

        def answer():
            count = np.array([len(h) for h in hits], np.int64)
            norm = 25 + (75 * np.array(sizes, np.int64) * docs_n) // total
            lists = Lists(np.concatenate(hits), np.repeat(np.arange(len(ids)), count), norm, max(1, len(weights)))
            order = pa.compute.sort_indices(pa.array(ids, types.field("doc_id").type), null_placement="at_end").to_numpy()
            tie = np.empty(len(ids), np.int64)
            tie[order] = np.arange(len(ids))
            rows = [(item_id, ids[d], s) for item_id, parts in items for d, s in lists.best([(t, weights[t] * q) for t, q in parts], k, tie)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), _raw(b.column(1)), strict=True):
                n, own = 0, []
                for part in terms(raw):
                    n += len(part)
                    own += [t for t in map(index.get, part) if t is not None]
                if own:
                    ids.append(doc_id)
                    sizes.append(n)
                    hits.append(np.array(own, np.int64))
                    held += len(own)
                    if len(ids) >= BLOCK_DOCS or held >= BLOCK_HITS:
                        yield answer()
                        ids, sizes, hits, held = [], [], [], 0
        if ids:
            yield answer()

    return run


def _weight(docs_n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1)))


def search(
    docs: DataFrame, items: DataFrame, k: int = 10,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0,
    best first, equal scores by ascending id (null last).

    Rows of one item id are one item, whose terms add up; equal rows of it count once; a null item
    id is an item like others. Each row of ``docs`` is a document, repeated ids too. Null and empty
    texts have no terms. Items without a document above 0 have no rows; other columns are ignored;
    an empty table gives no rows. An item's own terms have to fit a task."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("item_id", asked), ("doc_id", src))}
    pairs = asked.mapInArrow(_item_terms, f"item_id {kinds['item_id']}, term binary, times long")
    pairs = pairs.groupBy("item_id", "term").agg(F.sum("times").alias("times")).checkpoint()
    n_blocks = -(-pairs.count() // BLOCK_PAIRS)
    found = None
    for block in range(n_blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        part = _search_block(src, own, k, kinds).checkpoint()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = asked.select("item_id").limit(0).crossJoin(src.select("doc_id").limit(0)).withColumn("score", F.lit(0).cast("long"))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", "salt").orderBy(*best)
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    return some.select("item_id", "rank", "doc_id", "score")


def _search_block(src: DataFrame, own: DataFrame, k: int, kinds: dict[str, str]) -> DataFrame:
    rows = own.orderBy("term").toArrow()
    names = list(dict.fromkeys(rows["term"].to_pylist()))
    counted = src.select("text").mapInArrow(_statistics(frozenset(names)), "term binary, n long, kind int")
    got = counted.groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()
    docs_n, total = (next((r["n"] for r in got if r["kind"] == kind), 0) for kind in (0, 1))
    df = {bytes(r["term"]): r["n"] for r in got if r["kind"] == 2}
    index = {t: at for at, t in enumerate(t for t in names if t in df)}
    weights = [_weight(docs_n, df[t]) for t in index]
    items: dict = {}
    for item_id, term, times in zip(*(rows[c].to_pylist() for c in ("item_id", "term", "times")), strict=True):
        if term in index and weights[index[term]] > 0:
            items.setdefault(item_id, []).append((index[term], times))
    types = pa.schema([("item_id", rows.schema.field("item_id").type), ("doc_id", src.select("doc_id").limit(0).toArrow().schema.field("doc_id").type), ("score", pa.int64())])
    return src.mapInArrow(_search(index, weights, list(items.items()), docs_n, total, k, types), f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long")
