"""Packing token ids into fixed windows: bounded-space online best-fit.

Each partition reads its documents once, in order, and keeps at most ``OPEN`` windows. A text's
ids first fill whole windows; its tail goes to the open window with the least room that still
takes it (best fit). If none takes it and all windows are open, the fullest is emitted and a new
one opened. At the end of a partition the open windows are leftovers: their pieces (at most
``OPEN`` windows of 1024 ids) carry their ids on, and groups of partitions merge their leftovers
by laying them end to end, cutting where a window is full. Groups of groups repeat this, a bounded
number of ids per task, until one group is left; its rest is cut into power-of-two windows, which
take no padding. Between the steps every piece holds its ids in two bytes each (four, where an id
needs them); the result has them as integers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

WINDOW, OPEN, FAN_IN = 1024, 32, 32
END_ID = 0
_SEQ = 1 << 34
_ROWS = 1000
_FIELDS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "raw", "part"]
_RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _unpacked(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4")


class _Out:
    """Rows of pieces, handed over as Arrow batches."""

    def __init__(self, id_type: pa.DataType):
        self.rows: list[tuple] = []
        self.id_type = id_type

    def piece(self, doc, start, ids, total, sequence, offset, part=-1):
        raw = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()
        self.rows.append((doc, start, len(ids), total, sequence, offset, raw, part))

    def flush(self):
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
        types = [self.id_type, *[pa.int64()] * 5, pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _FIELDS)


def _pack(path: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        windows: list[list] = []  # each: [filled, [(doc, start, ids, total), ...]]
        made, out = 0, None
        encoder = tokens.encoder(path)

        def emit(window):
            nonlocal made
            offset = 0
            for doc, start, ids, total in window[1]:
                out.piece(doc, start, ids, total, part * _SEQ + made, offset)
                offset += len(ids)
            made += 1

        for b in batches:
            out = out or _Out(b.schema.field(0).type)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(tokens.ids_of(encoder, text.as_py() or ""), np.uint32(END_ID))
                whole = len(ids) // WINDOW * WINDOW
                for start in range(0, whole, WINDOW):
                    emit([WINDOW, [(doc, start, ids[start : start + WINDOW], len(ids))]])
                    if len(out.rows) >= _ROWS:
                        yield out.flush()
                tail = ids[whole:].copy()
                if len(tail):
                    fits = [w for w in windows if w[0] + len(tail) <= WINDOW]
                    if fits:
                        w = max(fits, key=lambda x: x[0])
                    else:
                        if len(windows) == OPEN:
                            fullest = max(range(OPEN), key=lambda k: windows[k][0])
                            w = windows.pop(fullest)
                            # a cut is free: the head of the tail fills the window that is emitted
                            head = WINDOW - w[0]
                            if head:
                                w[1].append((doc, whole, tail[:head], len(ids)))
                                tail, whole = tail[head:], whole + head
                            emit(w)
                        w = [0, []]
                        windows.append(w)
                    w[1].append((doc, whole, tail, len(ids)))
                    w[0] += len(tail)
                    if w[0] == WINDOW:
                        windows = [x for x in windows if x is not w]
                        emit(w)
                if len(out.rows) >= _ROWS:
                    yield out.flush()
        if out is not None:
            n = 0
            for w in windows:
                for doc, start, ids, total in w[1]:
                    out.piece(doc, start, ids, total, None, n, part=part)
                    n += 1
            yield out.flush()

    return run


def _merge(level: int, last: bool):
    """Lay one group's leftover pieces end to end; full windows are final, the rest goes on (or,
    at the last level, is cut into power-of-two windows)."""

    def run(key, table):
        group = key[0].as_py()
        out = _Out(table.schema.field("doc_id").type)
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        rows = table.select(["doc_id", "start", "length", "doc_tokens", "raw"]).to_pylist()
        pieces = [(r["doc_id"], r["start"], _unpacked(r["raw"], r["length"]), r["doc_tokens"]) for r in rows]
        left = sum(len(p[2]) for p in pieces)
        base = (level << 55) + group * (1 << 30)
        made, filled, room = 0, 0, WINDOW if left >= WINDOW or not last else 1 << (left.bit_length() - 1)
        carried = 0
        for doc, start, ids, total in pieces:
            while len(ids):
                if not filled and left < WINDOW:
                    if not last:
                        out.piece(doc, start, ids, total, None, carried, part=group)
                        carried += 1
                        left -= len(ids)
                        # the rest of this group stays in order, below one window
                        break
                    room = 1 << (left.bit_length() - 1)
                take = min(room - filled, len(ids))
                out.piece(doc, start, ids[:take], total, base + made, filled)
                ids, start, filled, left = ids[take:], start + take, filled + take, left - take
                if filled == room:
                    made, filled, room = made + 1, 0, WINDOW
        return pa.Table.from_batches([out.flush()])

    return run


def _with_ids(batches):
    """The result's columns: every piece's ids as integers, and their digest."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            b = batch.slice(at, _ROWS)
            length = b["length"].to_numpy()
            ids = [_unpacked(r, n).astype("<u4") for r, n in zip(b["raw"].to_pylist(), length.tolist(), strict=True)]
            crc = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
            flat = pa.array(np.concatenate(ids).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), flat)
            made = {"ids_crc32": crc, "ids": lists}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b[c] for c in _RESULT], _RESULT)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``, one row per piece.

    ``path`` names the vocabulary of ``tokens.encoder``. A text's ids are followed by id 0; null
    and empty texts are that id alone. Every id lies in one piece. Windows hold 1024 ids; only the
    last group's rest is shorter, in power-of-two windows. ``sequence_id`` is unique, not dense; the
    ``ids`` (array of int) of its pieces, in the order of ``offset``, are the training sequence, and
    ``ids_crc32`` is the digest of them as little-endian 32-bit integers.
    Repeated rows and null ids are packed like any others; other columns are ignored. Texts and
    whole windows never leave their partition; only leftovers are shuffled. No rows give no rows."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, raw binary, part long"
    result = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    parts = src.mapInArrow(_pack(path), schema).checkpoint()
    done = parts.where("sequence_id is not null")
    rest, level = parts.where("sequence_id is null").checkpoint(), 1
    span = (rest.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = span <= FAN_IN
        rest = (
            rest.withColumn("grp", F.floor(F.col("part") / FAN_IN))
            .groupBy("grp")
            .applyInArrow(_merge(level, last), schema)
            .checkpoint()
        )
        done = done.unionByName(rest.where("sequence_id is not null"))
        if last:
            return done.mapInArrow(_with_ids, result)
        rest, level, span = rest.where("sequence_id is null"), level + 1, -(-span // FAN_IN)
