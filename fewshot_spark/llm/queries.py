"""One query per operator, over its whole table, with production parameters; oracles where SQL
can state the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewshot_spark.session import prepare_session, read_table

from . import decontaminate, embed_dedup, langid, line_dedup, minhash, packing, prefix_trie, quality, ranked, sharding, tokens, toxicity, url_rules

SHARDS = 8
# The rules that every url is judged by.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def vocabulary() -> str:
    """Rank file of the public vocabulary byte_bpe_50k (same ids as its .json form)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def crc_of_id(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 8 uneven old shards (by hash of the text, so equal texts lie together)
    into 8 shards of near-equal bytes, moving the fewest bytes. The new shards are written to the
    shared folder; the result is read from their files."""
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    old_shard = F.pmod(F.xxhash64(text), F.lit(SHARDS)).cast("int").alias("old_shard")
    docs = read_table(spark, sf_dir, "documents")
    placed = sharding.reshard(docs.select("doc_id", size, crc, old_shard), SHARDS).checkpoint()
    root = f"{prepare_session(spark).rstrip('/')}/reshard-{uuid.uuid4().hex}"
    paths = sharding.rewrite(spark, docs.select("*", size, crc, old_shard), placed, root, 1)
    if paths:
        written = spark.read.schema(f"{docs._jdf.schema().toDDL()}, slot long, shard int").parquet(f"{root}/generation=1")
    else:
        written = docs.limit(0).select("*", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard"))
    return written.select(
        "doc_id", size, crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old_shard
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary(), limit=512)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(read_table(spark, sf_dir, "pages"), rules, default="allow")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_of_id(5) != 0))
    out = langid.predict(docs, model)
    return out.select("doc_id", (crc_of_id(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "item_shingles", "shared_shingles")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3)
    return out.select("doc_id", "text", "cut_units")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_of_id(3) != 1)
    out = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"])
    return out.select(
        "doc_id", (crc_of_id(3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.grafted(prefix_trie.conversations(read_table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_nodes(convs).drop("turn_id")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_of_id(5) != 0)
    out = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return out.select(
        "doc_id", (crc_of_id(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_reshard": op1_reshard,
    "op2_token_counts": op2_token_counts,
    "op3_url_rules": op3_url_rules,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_packing": op7_packing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE = {
    "op3_url_rules": """
with u as (
  select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), j as (
  select page_id, host, path, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from p
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from j
""",
    "op4_minhash_dedup": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), n as (select doc_id, count(*) as n from s group by 1),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(node, spot) as (select distinct a, a from e union select r.node, e.b from r join e on e.a = r.spot),
c as (select node, min(spot) as low from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.low, w.doc_id) as component_id, coalesce(c.low, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join c on c.node = w.doc_id
""",
    "op6_decontaminate": r"""
with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
widths as (select distinct least(len(w), 5) as v from b where len(w) > 0),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - v + 2), lambda i: array_to_string(w[i:i+v-1], ' '))) as g from d, widths where len(w) >= v),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - v + 2), lambda i: array_to_string(w[i:i+v-1], ' '))) as g
  from (select *, least(len(w), 5) as v from b where len(w) > 0)),
n as (select item_id, count(*) as n from bs group by 1),
m as (select doc_id, item_id, count(*) as k from ds join bs using (g) group by 1, 2)
select doc_id, item_id, n as item_shingles, k as shared_shingles from m join n using (item_id) where 100 * k >= 80 * n
""",
    "op8_embedding_dedup": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), r(node, spot) as (select distinct a, a from l union select r.node, l.b from r join l on l.a = r.spot),
c as (select node, min(spot) as low from r group by 1),
k as (select a, count(*) as n from l group by 1)
select x.vec_id, coalesce(k.n, 0) as n_links, coalesce(c.low, x.vec_id) as component_id, coalesce(c.low, x.vec_id) = x.vec_id as kept
from embeddings x left join k on k.a = x.vec_id left join c on c.node = x.vec_id
""",
    "op11_prefix_trie": """
with own as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, role, text) as turns
  from conversations where conv_id is not null group by 1
), c as (
  select *, list_reduce(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint),
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, k: xor(y >> 1, (y & 1) * 3988292384)), 4294967295) as raw from own
), h as (select conv_id, turns, xor(raw, 4294967295) % 6 as h from c),
g as (
  select h.conv_id, list_concat(coalesce(d.turns[1:h.h], []), h.turns[h.h + 1:]) as turns
  from h left join own d on d.conv_id = h.conv_id - h.conv_id % 100
), p as (select conv_id, len(turns) as n, depth, turns[1:depth] as prefix from g, lateral (select unnest(range(0, len(turns) + 1)) as depth)),
node as (
  select depth, prefix, min(conv_id) as top, count(*) as n_convs, coalesce(length(prefix[depth].t), 0) as size,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '') as ends from p group by 1, 2
), m as (select p.conv_id as member, node.depth, top, n_convs, size from p join node using (depth, prefix)),
kin as (
  select distinct a.depth as depth, a.top as top, b.depth as d2, b.top as t2, b.n_convs, b.size from m a join m b on a.member = b.member and a.depth <= b.depth
), leaf as (select depth as d2, top as t2, count(*) filter (where kin.d2 = depth + 1) as n_children from kin group by 1, 2),
s as (
  select kin.depth, kin.top, sum((n_convs - 1) * size)::bigint as saved_tokens, count(*) filter (where leaf.n_children = 0) as n_leaves
  from kin join leaf on leaf.d2 = kin.d2 and leaf.t2 = kin.t2 group by 1, 2
)
select node.top as conv_id, node.depth::bigint as depth, up.top as parent_conv_id, node.n_convs, leaf.n_children, s.n_leaves, s.saved_tokens, sha256(ends) as ends_sha256
from node join s on s.depth = node.depth and s.top = node.top join leaf on leaf.d2 = node.depth and leaf.t2 = node.top
left join m up on up.member = node.top and up.depth = node.depth - 1
""",
    "op13_ranked_search": r"""
with t as (
  select row_number() over () as doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), d as (select * from t where len(w) > 0),
g as (select count(*)::bigint as n_docs, sum(len(w))::bigint as total from d),
m as (select doc, doc_id, 25 + (75 * len(w)::bigint * n_docs) // total as m from d, g),
f as (select doc, term, count(*)::bigint as tf from (select doc, unnest(w) as term from d) group by 1, 2),
df as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from f, g group by term, n_docs),
q as (
  select item_id, term, count(*)::bigint as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select distinct item_id, text from benchmark)) group by 1, 2
), s as (
  select item_id, doc, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join df using (term) join f using (term) join m using (doc) group by 1, 2, 3
), r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 10
""",
}
