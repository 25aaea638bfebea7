"""Text encoders with one contract: ``(row_id, text) -> (row_id, embedding ARRAY<DOUBLE>)``.

* ``encode_hash`` (default): signed feature hashing. Tokens are the non-empty pieces of
  ``split(lower(text), '[ \\t\\r\\n]+')``; token t adds ``sign(t)`` to bucket ``h60(t) % dim``
  with ``sign(t) = +1`` when ``h60('s', t)`` is even, else -1; the vector is L2 normalised (a text
  without tokens gives the zero vector) and rounded to 6 digits. The whole text is encoded
  unless ``max_tokens`` is given. Two physical forms with equal output:
  - ``method="map"`` (default): documents are independent, so each partition encodes its rows in
    Arrow batches (``mapInPandas``): no shuffle at all, two md5 per distinct token and one
    ``numpy.bincount`` per run of about a million characters. This is the form that holds at corpus scale.
  - ``method="sql"``: the same definition in Spark SQL only: explode -> partial aggregation on
    (row, bucket) -> shuffle of at most ``dim`` cells per row -> per-row aggregation. It is the
    relational statement of the encoder (and what the DuckDB oracle mirrors), but it shuffles
    about ``dim`` cells per document twice.
* ``encode_hashing_tf``: MLlib ``HashingTF`` + ``IDF`` + ``Normalizer``.
* ``encode_word2vec``: MLlib ``Word2Vec`` fitted on the table's tokens (mean word vector per row).
* ``encode_with_model``: any per-batch model (a function ``list[str] -> ndarray``) through
  ``mapInPandas``; the model is built once per task by its factory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import h60

TOKEN_SPLIT = r"[ \t\r\n]+"
_SPLIT = re.compile(TOKEN_SPLIT)
SLICE_CHARS, SLICE_ROWS = 1 << 20, 1024  # what a task holds of its texts at a time


def tokens(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(col), TOKEN_SPLIT), lambda t: t != F.lit(""))


def truncate_tokens(toks: Column, max_tokens: int) -> Column:
    """First ``max_tokens`` tokens (a model's maximum sequence length)."""
    return F.slice(toks, 1, int(max_tokens))


def encode_hash(
    df: DataFrame,
    id_col: str = "row_id",
    text_col: str = "text",
    dim: int = 256,
    max_tokens: int | None = None,
    out: str = "embedding",
    method: str = "map",
    keep: list[str] | None = None,
) -> DataFrame:
    """Hashed encoding ``(id_col, <keep columns>, out)``. ``keep`` (map form) carries columns through
    the Arrow pass, so vectors need not be joined back to their rows."""
    if method == "map":
        return _encode_hash_map(df, id_col, text_col, dim, max_tokens, out, keep or [])
    if method != "sql" or keep:
        raise ValueError("method is 'map' or 'sql' (which carries no columns)")
    toks = tokens(text_col)
    if max_tokens is not None:
        toks = truncate_tokens(toks, max_tokens)
    t = F.col("_t")
    exploded = df.select(id_col, F.explode_outer(toks).alias("_t")).select(
        id_col,
        F.when(t.isNotNull(), h60(t) % dim).alias("_b"),
        F.when(t.isNotNull(), F.lit(1) - F.lit(2) * (h60(F.lit("s"), t) % 2)).alias("_s"),
    )
    cells = exploded.groupBy(id_col, "_b").agg(F.sum("_s").alias("_v"))
    per_row = cells.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_v")))).alias("_m"),
        F.coalesce(F.sum(F.col("_v") * F.col("_v")), F.lit(0)).alias("_ss"),
    )
    norm = F.sqrt(F.col("_ss").cast("double"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(
            F.col("_ss") > 0,
            F.round(F.coalesce(F.try_element_at(F.col("_m"), i.cast("bigint")), F.lit(0)).cast("double") / norm, 6),
        ).otherwise(F.lit(0.0)),
    )
    return per_row.select(id_col, dense.alias(out))


def small_batches(batches, text_col: str):
    """Non-empty pandas batches cut into runs of about ``SLICE_CHARS`` characters of text and at most
    ``SLICE_ROWS`` rows, so that what a task holds does not grow with the Arrow batches."""
    import numpy as np

    for pdf in batches:
        ends, i = np.cumsum([len(t) if isinstance(t, str) else 0 for t in pdf[text_col]]), 0
        while i < len(pdf):
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_CHARS, "right"))
            j = min(max(i + 1, j), i + SLICE_ROWS, len(pdf))
            yield pdf.iloc[i:j]
            i = j


def token_pieces(text):
    """The tokens of a text as lists, each of about ``SLICE_CHARS`` characters cut between tokens
    (one list unless the text is longer); a null text has none."""
    at, end = 0, len(text) if isinstance(text, str) else 0
    while at < end:
        cut = _SPLIT.search(text, at + SLICE_CHARS) if end - at > SLICE_CHARS else None
        to = cut.start() if cut else end
        yield [t for t in text[at:to].lower().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if t]
        at = to


def token_runs(texts: list, max_tokens: int | None = None):
    """``(places, tokens)`` of a list of texts, a bounded number of characters at a time."""
    place, toks, size = [], [], 0
    for i, text in enumerate(texts):
        left = max_tokens
        for part in token_pieces(text):
            if left is not None:
                part, left = part[:left], left - len(part[:left])
            place += [i] * len(part)
            toks += part
            size += sum(map(len, part)) + len(part)
            if size >= SLICE_CHARS:
                yield place, toks
                place, toks, size = [], [], 0
            if left == 0:
                break
    if toks:
        yield place, toks


def _h60_all(texts) -> "object":
    """``h60`` of every text, as a numpy array."""
    import hashlib

    import numpy as np

    digests = b"".join([hashlib.md5(t.encode("utf-8")).digest()[:8] for t in texts])
    return (np.frombuffer(digests, ">u8") >> 4).astype(np.int64)


def hash_vectors(texts: list, dim: int, max_tokens: int | None = None):
    """The hashed encoding of a list of texts as a ``len(texts) x dim`` numpy array (the per-batch
    kernel of ``encode_hash(method="map")``; also used for small bounded lists such as anchors).
    Tokens and their hashes are held for about ``SLICE_CHARS`` characters at a time."""
    import numpy as np
    import pandas as pd

    M = np.zeros((len(texts), dim))
    for place, toks in token_runs(texts, max_tokens):
        codes, uniques = pd.factorize(np.array(toks, dtype=object))
        cell = np.array(place, dtype=np.int64) * dim + (_h60_all(uniques) % dim)[codes]
        sign = (1.0 - 2.0 * (_h60_all(["s:" + t for t in uniques]) % 2))[codes]
        lo, hi = place[0] * dim, (place[-1] + 1) * dim
        M.ravel()[lo:hi] += np.bincount(cell - lo, weights=sign, minlength=hi - lo)
    nrm = np.sqrt(np.einsum("ij,ij->i", M, M))
    safe = np.where(nrm > 0, nrm, 1.0)
    return np.where(nrm[:, None] > 0, np.round(M / safe[:, None], 6), 0.0)


def _encode_hash_map(df: DataFrame, id_col: str, text_col: str, dim: int, max_tokens: int | None, out: str,
                     keep: list[str]) -> DataFrame:
    cols = [id_col, *keep]
    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in small_batches(batches, text_col):
            V = hash_vectors(pdf[text_col].tolist(), dim, max_tokens)
            yield pdf[cols].assign(**{out: list(V)})

    return df.select(*cols, text_col).mapInPandas(run, schema)


def l2_normalize(arr: Column | str) -> Column:
    """``v / |v|``; the zero vector stays zero."""
    a = F.col(arr) if isinstance(arr, str) else arr
    ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(ss > 0, F.transform(a, lambda x: x.cast("double") / F.sqrt(ss))).otherwise(
        F.transform(a, lambda x: F.lit(0.0))
    )


def encode_hashing_tf(df: DataFrame, id_col: str = "row_id", text_col: str = "text", dim: int = 256, out: str = "embedding") -> DataFrame:
    """MLlib encoder: HashingTF (term counts) -> IDF -> L2 Normalizer, as ARRAY<DOUBLE>."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    base = df.select(id_col, tokens(text_col).alias("_tok"))
    pipe = Pipeline(stages=[
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_n", p=2.0),
    ])
    model = pipe.fit(base)
    return model.transform(base).select(id_col, vector_to_array("_n").alias(out))


def encode_word2vec(df: DataFrame, id_col: str = "row_id", text_col: str = "text", dim: int = 64,
                    min_count: int = 1, seed: int = 0, max_iter: int = 1, out: str = "embedding"):
    """MLlib Word2Vec: the model is fitted on the tokens of ``df`` (distributed) and each row gets
    the mean of its word vectors. Returns ``(encoded DataFrame, fitted model)``."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    base = df.select(id_col, tokens(text_col).alias("_tok"))
    model = Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, maxIter=max_iter, inputCol="_tok", outputCol="_v").fit(base)
    return model.transform(base).select(id_col, vector_to_array("_v").alias(out)), model


def encode_with_model(
    df: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], "object"]],
    dim: int,
    id_col: str = "row_id",
    text_col: str = "text",
    out: str = "embedding",
) -> DataFrame:
    """Encode with a user model through Arrow batches; ``model_factory()`` runs once per task."""
    import numpy as np
    import pandas as pd

    schema = T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = model_factory()
        for pdf in batches:
            vecs = np.asarray(model(pdf[text_col].fillna("").tolist()), dtype=np.float64).reshape(len(pdf), dim)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), out: list(vecs)})

    return df.select(id_col, text_col).mapInPandas(run, schema)
