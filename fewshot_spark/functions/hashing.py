"""Seeded, engine-portable draws.

Every random choice in the library is a hash of its inputs, so a draw depends only on
(seed, iteration, row id, ...) and never on partitioning, cluster size or task order.

    h60(p0, p1, ...) = first 15 hex digits of md5("p0:p1:...") as an integer in [0, 2**60)

The same value in DuckDB is ``('0x' || substr(md5(x), 1, 15))::BIGINT`` (see ``sql_h60``), which
is what lets the relational operators be checked row by row against another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def _as_col(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def hash_key(*parts) -> Column:
    """``concat(p0, ':', p1, ...)`` with every part cast to string."""
    cols: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append(_as_col(p).cast("string"))
    return F.concat(*cols)


def h60(*parts) -> Column:
    """Uniform 60-bit BIGINT draw keyed by the parts (non-negative, so ``h % m`` is in [0, m))."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 15), 16, 10).cast("bigint")


def sql_key(*parts: str) -> str:
    """DuckDB text of ``hash_key``: parts are SQL expressions (quote literals yourself)."""
    return " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


def sql_h60(*parts: str) -> str:
    """DuckDB text of ``h60``."""
    return f"('0x' || substr(md5({sql_key(*parts)}), 1, 15))::BIGINT"
