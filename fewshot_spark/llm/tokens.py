"""Byte-level BPE ids through tiktoken's rank file of a vocabulary, and token counts.

``byte_bpe_50k.json`` (library tokenizers) and ``byte_bpe_50k.tiktoken`` are one vocabulary;
tests compare the ids of both libraries. tiktoken is used because it is several times faster.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Split pattern and special string of the public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MARK = "<|endoftext|>"
SPECIAL = {MARK: 50256}

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 18
# Places where a token of PATTERN always begins: one blank between two other characters, and a
# closing or parting mark after a letter of a script that is written without blanks.
_SAFE = re.compile("(?<=\\S)[ \n\r\t](?=\\S)|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1f])")


@functools.lru_cache(maxsize=2)
def _ranks(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder of the vocabulary at ``path`` (a .tiktoken rank file), once per Python worker."""
    with open(path, "rb") as f:
        return _ranks(f.read())


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a long text at safe places (``_SAFE``), whatever its script. A token never spans such a
    place, so the pieces' ids are the text's ids. A run without any such place stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def ids_of(enc, text: str) -> np.ndarray:
    """Token ids of a whole text as uint32; special strings are their special id."""
    got = [enc.encode_to_numpy(p, allowed_special="all") for p in pieces(text) if p]
    return np.concatenate(got) if got else np.zeros(0, np.uint32)


def _count(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            n_bytes, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            queue: list[tuple[int, str]] = []
            held = 0

            def work():
                """One call for the batch: the special string between texts parts them, and each
                segment between special strings is encoded on its own."""
                if not queue:
                    return
                ids = enc.encode_to_numpy(MARK.join(p for _, p in queue), allowed_special="all")
                at = np.concatenate([[-1], np.flatnonzero(ids == SPECIAL[MARK]), [len(ids)]])
                k = 0
                for row, piece in queue:
                    own = piece.count(MARK)
                    n_tokens[row] += at[k + own + 1] - at[k] - 1
                    k += own + 1
                queue.clear()

            for row, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                n_bytes[row] = len(text.encode())
                for piece in pieces(text) if text else ():
                    queue.append((row, piece))
                    held += len(piece) if piece.isascii() else len(piece.encode())
                    if held >= BATCH_BYTES:
                        work()
                        held = 0
            work()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, in the scan stage (no shuffle).

    Whole texts are counted: batches of about 1 MB of text whatever the number of rows, long texts
    in pieces. Only lengths leave the task. Null and empty texts: 0 bytes, 0 tokens. Rows with
    null or repeated ids are counted each; other columns are ignored. No rows give no rows."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    got = src.mapInArrow(_count(path), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
