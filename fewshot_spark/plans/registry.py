"""Query registry and the shared base tables (Spark readers and their DuckDB SQL).

Every query reads the given tables (or what Spark derives from them) in full. Parameters follow
the original experiment grid where it applies: sample sizes 2..64, 20 seeds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import catalogue as C
from ..sources import readers as R

SIZES = [2, 4, 8, 16, 32, 64]
SEEDS = list(range(20))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def _values(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


SEEDS_SQL = _values([(i, s) for i, s in enumerate(SEEDS)], ["seed_idx", "seed"])
SIZES_SQL = _values([(s,) for s in SIZES], ["sample_size"])
DL_SQL = "(SELECT d.doc_id AS row_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_FLAG_SQL = {"en": "d.lang = 'en'", "de": "d.lang = 'de'", "es": "d.lang = 'es'", "fr": "d.lang = 'fr'",
             "quality": "l.quality = 1", "toxic": "l.toxic = 1"}
DL6_SQL = (
    "(SELECT d.doc_id AS row_id, d.text, "
    + ", ".join(f"CAST({_FLAG_SQL[c]} AS INTEGER) AS {c}" for c in C.FLAGS6[:4])
    + ", l.quality, l.toxic, ("
    + " + ".join(f"CASE WHEN {_FLAG_SQL[c]} THEN {1 << i} ELSE 0 END" for i, c in enumerate(C.FLAGS6))
    + ")::BIGINT AS label_mask FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
DLM_SQL = (
    "(SELECT d.doc_id AS row_id, d.text, l.quality, l.toxic, "
    "(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END + CASE WHEN l.toxic = 1 THEN 2 ELSE 0 END)::BIGINT AS label_mask "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)


def dl(spark, sf):
    return R.documents_labelled(spark, sf, "quality")


def dl6(spark, sf):
    return R.documents_multilabel(spark, sf, six=True)


def dlm(spark, sf):
    return R.documents_multilabel(spark, sf, six=False)


