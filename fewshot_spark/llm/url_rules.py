"""URL rules by a sort-merge range join, in DataFrame functions only.

Canonical key: the host's labels reversed, each followed by a dot (``fr.wikipedia.org`` gives
``org.wikipedia.fr.``). A rule's host then is a prefix, and the hosts it covers are the interval
from its key to the end of that prefix. Rules and urls are sorted by key together; the sweep keeps
the stack of open rule hosts, one level per label count (intervals nest, so at most one host per
level is open). Urls are dealt by their first two labels and a salt, so a hot host is spread;
a rule goes to the salts of its two labels (one-label rules to all), never to a url twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
SPREAD = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
    from there up to ``?``, ``#`` or the end. Null urls and urls without ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _zone(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(key, ".", 2)), F.lit(SPREAD)).cast("int")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host`` (lower case, without a leading dot), ``path`` (from its ``/``) and
    ``verdict``. A rule fits its host and all subdomains where the url's path starts with the
    rule's. Among fitting rules the longest ``host + path`` wins; of equally long ones the longer
    host, then ``block`` before ``allow``. Without a fitting rule: null and ``default``. Null or
    odd urls get an empty host and fit no rule; repeated rows and null ids keep their rows; other
    columns are ignored; no pages give no rows, no rules judge all by ``default``."""
    r = rules.select(F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host != ''")
    r = r.groupBy("r_host").agg(
        F.sort_array(F.collect_set(F.struct(
            F.length(F.concat("r_host", "r_path")).alias("len"), F.length("r_host").alias("host_len"),
            F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("blocks"),
            F.col("r_path").alias("p"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
        )), asc=False).alias("paths")
    )
    r = r.withColumn("key", _key(F.col("r_host"))).withColumn("level", F.size(F.split("r_host", r"\.")))
    levels = [x[0] for x in r.select("level").distinct().orderBy("level").collect()]
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    zones = F.explode(F.when(F.col("level") >= 2, F.array(_zone(F.col("key")))).otherwise(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    opened = r.withColumn("zone", zones).withColumn("salt", salts).select(
        "zone", "salt", "key", F.lit(0).alias("kind"), "level", F.struct("key", "paths").alias("open"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("page_id", pages.schema[id_col].dataType), ("host", "string"), ("path", "string"))],
    )
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("h"))
    urls = urls.withColumn("key", _key(F.col("host"))).select(
        _zone(F.col("key")).alias("zone"), F.pmod("h", F.lit(SALTS)).cast("int").alias("salt"), "key", F.lit(1).alias("kind"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast(opened.schema["open"].dataType).alias("open"), "page_id", "host", "path",
    )
    sweep = Window.partitionBy("zone", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.last(F.when(F.col("level") == n, F.col("open")), ignorenulls=True).over(sweep).alias(f"open_{n}") for n in levels]
    swept = opened.unionByName(urls).select("kind", "key", "page_id", "host", "path", *stack).where("kind = 1")
    fits = [
        F.when(F.startswith("key", F.col(f"open_{n}.key")), F.filter(F.col(f"open_{n}.paths"), lambda x: F.startswith(F.col("path"), x["p"])))
        for n in levels
    ]
    none = F.lit(None).cast(r.schema["paths"].dataType)
    best = F.array_max(F.flatten(F.array_compact(F.array(*fits)))) if fits else F.get(none, 0)
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
