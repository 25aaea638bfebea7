"""Words and word shingles as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D (the class ``[^\\x20\\x09-\\x0D]+``); A-Z
are lower-cased first. UTF-8 continuation bytes never collide with these, so working on bytes
gives the same words as working on characters. Work goes in slices of about 1 MB, and one long
text is cut at white space, so memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHINGLE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _STEP)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word (relative to ``offsets[0]``) and the words per text."""
    part = data[offsets[0] : offsets[-1]]
    if not len(part):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[part]
    cut = np.zeros(len(part) + 1, bool)
    cut[offsets - offsets[0]] = True
    before = np.concatenate([[False], word[:-1]]) & ~cut[:-1]
    after = np.concatenate([word[1:], [False]]) & ~cut[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets - offsets[0]))


def hash_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``part`` whose spans are given (all its words)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    idx = np.flatnonzero(~_SPACE[part])
    pos = np.arange(len(idx)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[part[idx]] * powers(int(lens.max()))[pos], first)
    return mix(h ^ lens.astype(np.uint64))


def slices(data: np.ndarray, offsets: np.ndarray, newline: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first text, past last text, offsets)`` of about 1 MB each. A text of more than 2 MB comes
    alone, in several slices that are cut at white space (at a line break, where ``newline``)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        if j > i + 1 or offsets[j] - offsets[i] <= 2 * SLICE_BYTES:
            yield i, j, offsets[i : j + 1]
        else:
            at, end = int(offsets[i]), int(offsets[j])
            while at < end:
                to = min(at + SLICE_BYTES, end)
                if newline and to < end:
                    found = np.flatnonzero(data[to : to + SLICE_BYTES] == 10)
                    to = to + int(found[0]) + 1 if len(found) else to
                while to < end and not _SPACE[data[to - 1]]:
                    to += 1
                yield i, j, np.array([at, to])
                at = to
        i = j


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first text, past last text, word hashes, words per text)`` for slices of texts."""
    data, offsets = utf8(column)
    held: list[np.ndarray] = []
    for i, j, own in slices(data, offsets):
        starts, ends, counts = spans(data, own)
        h = hash_words(data[own[0] : own[-1]], starts, ends)
        if own[-1] == offsets[j] and not held:
            yield i, j, h, counts
        else:
            held.append(h)
            if own[-1] == offsets[j]:
                h, held = np.concatenate(held), []
                yield i, j, h, np.array([len(h)])


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of one text's word hashes, sorted. With fewer words than ``width``
    the whole sequence is one shingle; without words there is none."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(n, width)
    with np.errstate(over="ignore"):
        s = h[: n - w + 1] * _SHINGLE[0]
        for k in range(1, w):
            s = s + h[k : n - w + 1 + k] * _SHINGLE[k]
    s = np.sort(mix(s ^ np.uint64(w)))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]
