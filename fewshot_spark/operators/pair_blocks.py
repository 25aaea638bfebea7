"""Counts of pairs of words as compact blocks: what ``cooccurrence`` shuffles and keeps.

Words have numbers from 0 by falling count. A pair is kept once, as the row of its rarer word (the
larger number) and the other word's number; the number of words itself, in place of the other word,
stands for all contexts and carries the row's total. A row has no more entries than there are more
frequent words, and the word itself, so no frequent word makes a large one.

A block holds sorted pairs and their counts: differences of the numbers, byte by byte, compressed
(about two bytes for a pair). All blocks of a bucket are summed up by one task, a bucket at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

RUN_TOKENS = 1 << 20  # tokens whose pairs a task sorts at a time
BLOCK_PAIRS = 1 << 20  # pairs of a kept block
HELD_PAIRS = 1 << 23  # counts of a bucket that a task holds before it sums them up
HASHED_WORDS = 1 << 17  # words hashed at a time
SENT_ROWS = 1 << 16  # rows of a batch that goes back to Spark


class WordNumbers:
    """Number of each of ``words`` (its place), found by a hash and the word itself."""

    def __init__(self, words: pa.Array):
        hashes = _hashes(words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words, self.numbers = hashes[order], words.take(pa.array(order)), order.astype(np.int32)

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers of ``words``, -1 for any other word."""
        found, n = np.full(len(words), -1, np.int32), len(self.hashes)
        hashes = _hashes(words)
        at, left = np.searchsorted(self.hashes, hashes), np.arange(len(words))
        while len(left := left[at[left] < n]) and len(left := left[self.hashes[at[left]] == hashes[left]]):
            same = pc.equal(self.words.take(pa.array(at[left])), words.take(pa.array(left))).to_numpy(zero_copy_only=False)
            found[left[same]] = self.numbers[at[left[same]]]
            left = left[~same]
            at[left] += 1  # another word of the same hash
        return found


def _hashes(words: pa.Array) -> np.ndarray:
    parts = (words.slice(k, HASHED_WORDS).to_numpy(zero_copy_only=False) for k in range(0, len(words), HASHED_WORDS))
    return np.concatenate([np.zeros(0, np.uint64), *(hash_array(p, categorize=False) for p in parts)])


@dataclass(frozen=True)
class Layout:
    """Where a pair goes: word i belongs to bucket ``i % buckets``. Keys sort by bucket, row and other word."""

    words: int
    buckets: int

    @property
    def bits(self) -> int:
        return self.words.bit_length()

    @property
    def rows(self) -> int:
        return -(-self.words // self.buckets)

    def keys(self, row: np.ndarray, other: np.ndarray) -> np.ndarray:
        row = row.astype(np.int64)
        return (row % self.buckets * self.rows + row // self.buckets) << self.bits | other

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = keys >> self.bits
        return place % self.rows * self.buckets + place // self.rows, keys & ((1 << self.bits) - 1)

    def ends(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket begins in sorted ``keys``, and the last one ends."""
        return np.searchsorted(keys, np.arange(self.buckets + 1, dtype=np.int64) * self.rows << self.bits)


def packed(keys: np.ndarray, n: np.ndarray, bits: int) -> bytes:
    """A block of sorted, distinct ``keys`` and their counts."""
    place, other = keys >> bits, keys & ((1 << bits) - 1)
    starts = _starts(place)
    apart = np.diff(other, prepend=0)
    apart[starts] = other[starts]
    head, planes = [len(keys), len(starts)], []
    for x in (np.diff(place[starts], prepend=0), np.diff(starts, append=len(keys)), apart, n):
        width = (int(x.max()).bit_length() + 7) // 8
        head.append(width)
        planes.append(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, "<i8").tobytes() + pa.Codec("zstd").compress(b"".join(planes), asbytes=True)


def unpacked(block: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``(keys, counts)`` of ``packed``."""
    size, rows, *widths = np.frombuffer(block, "<i8", 6).tolist()
    sizes = [rows, rows, size, size]
    flat = np.frombuffer(pa.Codec("zstd").decompress(block[48:], sum(s * w for s, w in zip(sizes, widths, strict=True))), np.uint8)
    parts, at = [], 0
    for s, w in zip(sizes, widths, strict=True):
        x = np.zeros((s, 8), np.uint8)
        x[:, :w] = flat[at : at + s * w].reshape(w, s).T
        parts.append(x.view("<i8")[:, 0])
        at += s * w
    place, length, apart, n = parts
    sums = np.cumsum(apart)
    starts = np.cumsum(length) - length
    other = sums - np.repeat(sums[starts] - apart[starts], length)
    return np.repeat(np.cumsum(place), length) << bits | other, n


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return keys, n
    shift = int(n.max()).bit_length()
    if int(keys.max()).bit_length() + shift <= 63:  # both in one number: far faster to sort than places
        both = keys << shift
        both |= n
        both.sort()
        keys, n = both >> shift, both & ((1 << shift) - 1)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    starts = _starts(keys)
    return keys[starts], np.add.reduceat(n, starts)


def count_pairs(ids: np.ndarray, text: np.ndarray, window: int, at: Layout, start: int, end: int):
    """Sorted keys and counts, first of the pairs whose first word stands at ``start`` to ``end``, then of
    their words' totals. ``ids``: numbers of all tokens, -1 for other words; ``text``: the text of each."""
    stop = min(end + window, len(ids))
    ids, text, size = ids[start:stop], text[start:stop], end - start
    known, met, keys, got = ids >= 0, np.zeros(stop - start, np.int64), np.empty(window * size, np.int64), 0
    for k in range(1, window + 1):
        n = max(0, min(size, len(ids) - k))
        x, y = ids[:n], ids[k : k + n]
        both = known[:n] & known[k : k + n] & (text[:n] == text[k : k + n])
        met[:n] += both
        met[k : k + n] += both
        x, y = x[both], y[both]
        keys[got : got + len(x)] = at.keys(np.maximum(x, y), np.minimum(x, y))
        got += len(x)
    keys = keys[:got]
    keys.sort()
    starts = _starts(keys)
    pairs = keys[starts]
    del keys
    n = np.diff(starts, append=got)
    del starts
    yield pairs, n
    del pairs, n
    totals = np.bincount(ids[known], met[known], at.words).astype(np.int64)
    seen = np.flatnonzero(totals)
    keys = at.keys(seen, np.int64(at.words))
    order = np.argsort(keys)
    yield keys[order], totals[seen[order]]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted ``keys`` begins."""
    return np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))


def count_texts(batches, known: WordNumbers, window: int, at: Layout):
    """Blocks ``(bucket, block)`` of the pairs in batches of lists of tokens, some runs of tokens at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b.column(0))
        size += pc.sum(pc.list_value_length(held[-1])).as_py() or 0
        if size >= RUN_TOKENS:
            yield from _count_run(held, known, window, at)
            held, size = [], 0
    if size:
        yield from _count_run(held, known, window, at)


def _count_run(lists, known: WordNumbers, window: int, at: Layout):
    length = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists])
    words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    ids = known.find(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(length), dtype=np.int32), length)
    for start in range(0, len(ids), RUN_TOKENS):
        for keys, n in count_pairs(ids, text, window, at, start, min(start + RUN_TOKENS, len(ids))):
            ends = at.ends(keys)
            full = np.flatnonzero(np.diff(ends))
            yield _blocks(full, [packed(keys[ends[b] : ends[b + 1]], n[ends[b] : ends[b + 1]], at.bits) for b in full])


def _blocks(buckets, blocks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def merge_buckets(batches, at: Layout):
    """Blocks of the sums of all blocks of a bucket; ``batches`` have the blocks of a bucket in turn."""
    bucket, keys, counts, size = None, [], [], 0

    def done():
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        for s in range(0, len(k), BLOCK_PAIRS):
            yield _blocks([bucket], [packed(k[s : s + BLOCK_PAIRS], n[s : s + BLOCK_PAIRS], at.bits)])

    for b in batches:
        for i in range(b.num_rows):
            now = b.column(0)[i].as_py()
            if keys and now != bucket:
                yield from done()
                keys, counts, size = [], [], 0
            bucket = now
            k, n = unpacked(b.column(1)[i].as_py(), at.bits)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > max(HELD_PAIRS, 2 * len(keys[0])):
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [n], len(k)
    if keys:
        yield from done()


def row_totals(batches, at: Layout):
    """``(i, n)``: the totals of the words in the batches of blocks."""
    for b in batches:
        for block in b.column(1):
            keys, n = unpacked(block.as_py(), at.bits)
            row, other = at.pairs(keys)
            total = other == at.words
            yield pa.RecordBatch.from_arrays([pa.array(row[total]), pa.array(n[total])], ["i", "n"])


def cells(batches, at: Layout):
    """``(word, context, n)`` as arrays of numbers, both ways round, of the batches of blocks."""
    for b in batches:
        for block in b.column(1):
            keys, n = unpacked(block.as_py(), at.bits)
            row, other = at.pairs(keys)
            for s in range(0, len(row), SENT_ROWS):
                x, y, m = row[s : s + SENT_ROWS], other[s : s + SENT_ROWS], n[s : s + SENT_ROWS]
                pair = y < at.words
                x, y, m = x[pair], y[pair], m[pair]
                two = x != y
                yield np.concatenate([x, y[two]]), np.concatenate([y, x[two]]), np.concatenate([np.where(two, m, 2 * m), m[two]])
