"""Line dedup with a log-template tree.

A line is parsed to a fixed depth: its token count and its ``DEPTH`` leading tokens name a leaf;
tokens with a digit are a variable field (one wildcard). Within a leaf, templates whose remaining
tokens agree place by place up to a quarter join one template: each template carries a sketch of 8
bytes, one per eighth of the remaining places, and joins those that differ in at most a quarter of
the used bytes. The sentences of a longer line are parsed alike but not generalised further. A line
of fewer than ``TREE_LINE`` tokens is its own exact template, digits included: with so few tokens (in
scripts without spaces, a whole line) a wildcard would leave nothing that tells lines apart.

A template that occurs in ``min_docs`` documents recurs. Its first document (smallest id) keeps
it, so copied text stays once; all other documents lose it. Counting is a partial aggregation on
narrow rows (template, document); leaves are dealt to bounded blocks that return spanning forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import blocks, clusters, components, free_name, sized, to_cells, whole_groups
from .words import hash_words, mix, powers, slices, spans, utf8

DEPTH, TREE_LINE, MIN_SENTENCE, LEAF_BLOCK = 4, 3, 6, 2000
_WILD = np.uint64(0x5851F42D4C957F2D)
_LINE, _SENTENCE = np.uint64(0x1B873593), np.uint64(0xCC9E2D51)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def _template(h: np.ndarray, first: np.ndarray, size: np.ndarray, kind: np.uint64) -> np.ndarray:
    pos = np.arange(len(h)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(h * powers(int(size.max()))[pos], first) ^ (size.astype(np.uint64) * kind))


class Units:
    """Lines and sentences of a slice of texts; word indices ``first`` and ``size`` per unit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.part = data[offsets[0] : offsets[-1]]
        self.starts, self.ends, counts = spans(data, offsets)
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        if not n:
            return
        h = hash_words(self.part, self.starts, self.ends)
        breaks = np.cumsum(self.part == 10)[self.starts]
        new_line = np.ones(n, bool)
        new_line[1:] = (self.doc[1:] != self.doc[:-1]) | (breaks[1:] != breaks[:-1])
        new_sentence = new_line.copy()
        new_sentence[1:] |= _STOP[self.part[self.ends[:-1] - 1]]
        self.line_first, self.sentence_first = np.flatnonzero(new_line), np.flatnonzero(new_sentence)
        self.line_size = np.diff(np.append(self.line_first, n))
        self.sentence_size = np.diff(np.append(self.sentence_first, n))
        digits = np.concatenate([[0], np.cumsum(_DIGIT[self.part])])
        wild = (digits[self.ends] > digits[self.starts]) & np.repeat(self.line_size >= TREE_LINE, self.line_size)
        self.h = np.where(wild, _WILD, h)
        self.line = _template(self.h, self.line_first, self.line_size, _LINE)
        self.sentence = _template(self.h, self.sentence_first, self.sentence_size, _SENTENCE)
        # the line that a sentence is in, and whether it is all of it
        self.in_line = np.searchsorted(self.line_first, self.sentence_first, "right") - 1
        self.whole = self.line_size[self.in_line] == self.sentence_size

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and sketch of every line."""
        size, first = self.line_size, self.line_first
        line = np.repeat(np.arange(len(first)), size)
        pos = np.arange(len(self.h)) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            val = self.h * powers(int(size.max()))[pos]
            lead = np.add.reduceat(np.where(pos < DEPTH, val, np.uint64(0)), first)
            leaf = mix(lead ^ (size.astype(np.uint64) * _WILD))
            tail = np.maximum(size - DEPTH, 1)[line]
            eighth = np.where(tail <= 8, pos - DEPTH, (pos - DEPTH) * 8 // tail)
            rest = pos >= DEPTH
            sums = np.zeros(len(first) * 8, np.uint64)
            np.add.at(sums, line[rest] * 8 + eighth[rest], val[rest])
        sketch = np.where(sums == 0, 0, mix(sums) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        return leaf, sketch.reshape(-1, 8).view(np.int64).ravel()


def _units(data: np.ndarray, own: np.ndarray, tree: bool) -> list[np.ndarray]:
    """Template and text number of the units of a slice; for the tree also leaf, sketch and
    whether the unit stays out of the tree."""
    u = Units(data, own)
    if not len(u.starts):
        z = np.zeros(0, np.int64)
        return [z, z, z, z, z == 1][: 5 if tree else 2]
    sn = (u.sentence_size >= MIN_SENTENCE) & ~u.whole
    template = np.concatenate([u.line, u.sentence[sn]]).view(np.int64)
    doc = np.concatenate([u.doc[u.line_first], u.doc[u.sentence_first[sn]]])
    if not tree:
        return [template, doc]
    leaf, sketch = u.leaves()
    none = np.zeros(int(sn.sum()), np.int64)
    gone = np.concatenate([u.line_size < TREE_LINE, none == 0])
    return [template, doc, np.concatenate([leaf.view(np.int64), none]), np.concatenate([sketch, none]), gone]


def _parse(tree: bool):
    """Distinct units of every text; those of a text of several slices are put together first."""
    names = ["leaf", "sketch", "template", "doc_id"] if tree else ["template", "doc_id"]

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            held: list[list[np.ndarray]] = []
            for i, j, own in slices(data, offsets, newline=True):
                held.append(_units(data, own, tree))
                if own[-1] != offsets[j]:
                    continue
                template, doc, *more = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                order = np.lexsort((template, doc))
                new = np.ones(len(order), bool)
                new[1:] = (template[order][1:] != template[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                at = order[new]
                cols = [pa.array(template[at]), b.column(0).take(pa.array(i + doc[at]))]
                if tree:
                    leaf, sketch, gone = (x[at] for x in more)
                    cols = [pa.array(leaf, mask=gone), pa.array(sketch, mask=gone), *cols]
                if len(at):
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _alike(sketch: np.ndarray):
    """Which sketches of one leaf join another's template: a quarter of the used bytes may differ."""
    used = (sketch != 0).any(0).sum()
    return lambda i, rest: (sketch[rest] != sketch[i]).sum(1) <= used // 4


def _join_templates(batches):
    for table, groups in whole_groups(batches, ["leaf", "cell_i", "cell_j"]):
        template = table["template"].to_numpy()
        sketch = np.ascontiguousarray(table["sketch"].to_numpy()).view(np.uint8).reshape(-1, 8)
        found = []
        for s, e in groups:
            first = clusters(e - s, _alike(sketch[s:e]))
            found += [(int(template[s + f]), int(template[s + k])) for k, f in enumerate(first) if f != k]
        a = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def _cut(data: np.ndarray, offsets: np.ndarray, drop: np.ndarray) -> tuple[bytes, int]:
    """One text without the units whose template is in ``drop``; how many were cut."""
    out, cut = [], 0
    for _, _, own in slices(data, offsets, newline=True):
        u = Units(data, own)
        raw = u.part.tobytes()
        if not len(u.starts):
            out.append(raw)
            continue
        ln = np.isin(u.line.view(np.int64), drop)
        sn = np.isin(u.sentence.view(np.int64), drop) & (u.sentence_size >= MIN_SENTENCE) & ~u.whole
        sn &= ~ln[u.in_line]
        cut += int(ln.sum() + sn.sum())
        # a line that loses all its sentences goes as a line
        left = np.bincount(u.in_line, weights=~sn, minlength=len(ln))
        ln |= left == 0
        sn &= ~ln[u.in_line]
        breaks = np.flatnonzero(u.part == 10)
        spans_ = []
        for k in np.flatnonzero(ln):
            at = np.searchsorted(breaks, u.starts[u.line_first[k]])
            spans_.append((int(breaks[at - 1]) + 1 if at else 0, int(breaks[at]) + 1 if at < len(breaks) else len(raw)))
        for k in np.flatnonzero(sn):
            a, z = u.sentence_first[k], u.sentence_first[k] + u.sentence_size[k]
            inside = k + 1 < len(u.in_line) and u.in_line[k + 1] == u.in_line[k]
            spans_.append((int(u.starts[a]), int(u.starts[z]) if inside else int(u.ends[z - 1])))
        at = 0
        for a, z in sorted(spans_):
            out.append(raw[at:a])
            at = z
        out.append(raw[at:])
    return b"".join(out), cut


def _rewrite(batches):
    for b in batches:
        data, offsets = utf8(b.column(0))
        drops = b.column(1)
        texts, cuts = b.column(0).to_pylist(), np.zeros(b.num_rows, np.int64)
        for i in np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)):
            drop = drops[int(i)].values.to_numpy()
            raw, cuts[i] = _cut(data, offsets[i : i + 2], drop)
            texts[i] = raw.decode()
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(texts, pa.string()), pa.array(cuts)], ["row", "kept_text", "cut_units"])


def recurring(docs: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(template, first_doc)`` of all recurring templates.

    A text gives each of its units once, so a count of units is a count of documents, but for ids
    of several rows: their units are made distinct before. The documents of a generalised template
    are the distinct first and last documents of its members where ``min_docs`` is at most 3 (a
    member of three documents recurs by itself); beyond, those of the undecided ones are counted."""
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_field = src.schema["doc_id"].dataType.simpleString()

    def parsed(rows):
        return rows.mapInArrow(_parse(True), f"leaf long, sketch long, template long, doc_id {id_field}")

    twice = src.groupBy(F.col("doc_id").alias("twice_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("twice_id").checkpoint()
    if twice.isEmpty():
        units = parsed(src)
    else:
        again = F.col("doc_id") == F.col("twice_id")
        units = parsed(src.join(sized(twice), again, "left_anti")).unionByName(parsed(src.join(sized(twice), again, "left_semi")).distinct())
    seen = units.groupBy("template", "leaf", "sketch").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    seen = seen.where(f"leaf is not null or docs >= {int(min_docs)}").checkpoint()
    leaves = blocks(seen.where("leaf is not null").select("leaf", "template", "sketch"), ["leaf"], "template", LEAF_BLOCK)
    joined = components(to_cells(leaves, ["leaf"]).mapInArrow(_join_templates, "a long, b long"))
    joined = joined.select(F.col("node").alias("template"), F.col("component").alias("log"))
    member = joined.join(seen, "template")
    logs = member.groupBy("log").agg(F.min("first_doc").alias("low"), F.max("docs").alias("most"), F.sum("docs").alias("all_docs"))
    if min_docs <= 3:
        exact = member.select("log", F.explode(F.array("first_doc", "last_doc")).alias("d"))
    else:
        open_logs = logs.where((F.col("most") < min_docs) & (F.col("all_docs") >= min_docs)).select("log")
        undecided = joined.join(open_logs, "log", "left_semi").checkpoint()
        exact = units.select("template", F.col("doc_id").alias("d")).join(sized(undecided), "template").select("log", "d").distinct()
    exact = exact.groupBy("log").agg(F.count_distinct("d").alias("n_docs"))
    logs = logs.join(exact, "log", "left").where(F.greatest("most", "n_docs") >= min_docs).select("log", "low")
    general = joined.join(logs, "log").select("template", F.col("low").alias("first_doc"))
    alone = seen.where(F.col("docs") >= min_docs).select("template", "first_doc")
    return alone.unionByName(general).groupBy("template").agg(F.min("first_doc").alias("first_doc"))


def drop_recurring(docs: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cut and ``cut_units`` (how many lines and sentences were cut).

    Lines of any length count, those of 1 or 2 tokens as they stand, and sentences of at least 6
    tokens. Rows of one id are one document; rows with a null id
    are left as they are; null and empty texts stay; a text may become empty; repeated rows are
    cut alike; no rows give no rows. Where ``docs`` has a column ``cut_units``, the new last column
    gets the first free name of ``cut_units_``, ``cut_units__``, ..."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    id_field = src.schema["doc_id"].dataType.simpleString()
    found = sized(recurring(docs, min_docs, id_col, text_col).checkpoint())
    units = src.mapInArrow(_parse(False), f"template long, doc_id {id_field}")
    drops = units.join(found, "template").where("doc_id != first_doc").groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("template").alias("drops"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    rows = rows.join(drops, F.col("id") == F.col("drop_id"), "left").select("text", "drops", "row")
    done = rows.mapInArrow(_rewrite, f"row {rows.schema['row'].dataType.simpleString()}, kept_text string, cut_units long")
    own = [F.col("kept_text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*own, F.col("cut_units").alias(free_name(docs.columns, "cut_units")))
