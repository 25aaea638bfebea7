"""Language ID with hyperdimensional profiles.

Every letter has three random sign vectors, permuted copies of one another (one per place in a
trigram). A trigram's vector binds (multiplies) its letters' vectors for their places; a text's
vector bundles (adds) those of its trigrams; a language's prototype bundles the unit vectors of
its training texts. A text gets the language whose prototype has the largest cosine.
Each task bundles its own texts and returns one vector per language; Spark adds these up in
fixed-point integers, so the order of tasks does not matter.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import pieces

DIMS, CODES, FIXED = 1024, 128, 1 << 24
SLICE_CHARS, COLUMNS = 1_000_000, 16_384


@functools.lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter code by code point: a-z have their own, other letters share by a rule, the rest is 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = 27 + c % (CODES - 27)
    out[97:123] = out[65:91] = np.arange(1, 27)
    return out


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    base = (np.random.default_rng(77).integers(0, 2, (CODES, DIMS)) * 2 - 1).astype(np.int8)
    return np.stack([np.roll(base, k, axis=1) for k in (2, 1, 0)])


def text_vectors(texts: list[str]) -> np.ndarray:
    """One bundled vector per text; all zero where a text has no letter. Texts go in slices of
    about a million characters, long ones in pieces that are added up."""
    out = np.zeros((len(texts), DIMS), np.float64)
    owners, parts, held = [], [], 0

    def work():
        cp = np.frombuffer("\n".join(parts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = _codes()[cp].astype(np.int32)
        # which part a code point is in: parts are joined by one newline each
        lens = np.array([len(p.lower()) + 1 for p in parts])
        owner = np.repeat(np.arange(len(parts)), lens)[: len(code)]
        keep = (code > 0) | np.concatenate([[True], code[:-1] > 0])
        code, owner = np.concatenate([[0], code[keep], [0]]), owner[keep]
        mid = np.flatnonzero(code[1:-1] > 0)
        gram = (code[mid] * CODES + code[mid + 1]) * CODES + code[mid + 2]
        seen = np.zeros(CODES**3, bool)
        seen[gram] = True
        ids = np.flatnonzero(seen)
        if not len(ids):
            return
        row = np.zeros(CODES**3, np.int32)
        row[ids] = np.arange(len(ids))
        row, who = row[gram], owner[mid].astype(np.int64)
        first, second, third = _letters()
        for c in range(0, len(ids), COLUMNS):  # some trigrams at a time, so scripts of many letters fit
            some = ids[c : c + COLUMNS]
            bound = (first[some // CODES**2] * second[some // CODES % CODES] * third[some % CODES]).astype(np.float32)
            at = slice(None) if len(ids) <= COLUMNS else (row >= c) & (row < c + COLUMNS)
            flat = who[at] * len(some) + (row[at] - c)
            counts = np.bincount(flat, minlength=len(parts) * len(some)).reshape(len(parts), -1).astype(np.float32)
            np.add.at(out, np.array(owners), (counts @ bound).astype(np.float64))

    for i, t in enumerate(texts):
        for p in pieces(t):
            owners.append(i)
            parts.append(p)
            held += len(p)
            if held >= SLICE_CHARS or len(parts) >= 400:
                work()
                owners, parts, held = [], [], 0
    if parts:
        work()
    return out


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _bundle(batches):
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for i in range(0, b.num_rows, 400):
            part = b.slice(i, 400)
            v = np.rint(_unit(text_vectors(_texts(part.column(0)))) * FIXED).astype(np.int64)
            langs = np.array(part.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(0)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], ["lang", "v"])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language from all ``rows`` with a non-null language. Texts without letters
    add nothing. The driver gets one vector of 1024 numbers per language."""
    src = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    parts = src.mapInArrow(_bundle, "lang string, v array<long>").select("lang", F.posexplode("v"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("v")).orderBy("lang").collect()
    return {r["lang"]: np.array([x["s"] for x in r["v"]], np.float64) / FIXED for r in whole}


def _score(names: list[str], prototypes: np.ndarray, sharpness: float):
    def run(batches):
        for b in batches:
            langs, scores = [], []
            for i in range(0, b.num_rows, 400):
                v = _unit(text_vectors(_texts(b.column(1).slice(i, 400))))
                known = (v != 0).any(1) & bool(names)
                if names:
                    cos = v @ prototypes.T
                    best = cos.argmax(1)
                    p = 1 / np.exp(sharpness * (cos - cos.max(1, keepdims=True))).sum(1)
                    langs += [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                    scores += np.where(known, p, 0.0).tolist()
                else:
                    langs += ["und"] * len(v)
                    scores += [0.0] * len(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], sharpness: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the whole text and nothing else.

    ``score`` is the soft-max share of the best cosine. Null texts and texts without a letter:
    ``und`` and 0; so are all texts when no language was learned. Equal cosines: the first
    language in sorted order. Repeated rows and null ids keep their rows; no rows give none."""
    names = sorted(prototypes)
    matrix = _unit(np.array([prototypes[n] for n in names])) if names else np.zeros((0, DIMS))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_score(names, matrix, sharpness), f"doc_id {id_type}, lang_pred string, score double")
