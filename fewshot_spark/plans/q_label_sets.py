"""Queries: label sets of more labels than a mask holds, and partners drawn without pairing sets.

The multi-label rows are the orders: a label set of 100 labels (part keys of the order's lines), or
of 28 labels of which 8 are in most orders (quantities, return flags, line status) with one draw only,
so that many examples take the exact way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_h60 as H
from ..operators import examples as X
from ..operators import label_sets as LS
from ..operators import metrics as V
from ..session import read_table
from .registry import register

SEED, ITERS = 5, 3
# label ids of a line, in SQL that both engines read
_LABELS = {
    100: ["l_partkey % 100"],
    28: [
        "l_partkey % 20",
        "20 + CAST(l_quantity AS BIGINT) % 4",
        "CASE l_returnflag WHEN 'A' THEN 24 WHEN 'N' THEN 25 ELSE 26 END",
        "CASE WHEN l_linestatus = 'O' THEN 27 END",
    ],
}


def order_sets(spark, sf, n_labels: int):
    """``(dataset, row_id, label_words)``: every order that has lines."""
    ids = F.array_compact(F.array(*[F.expr(c).cast("int") for c in _LABELS[n_labels]]))
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.explode(ids).alias("label"))
    sets = lines.groupBy("row_id").agg(F.collect_set("label").alias("labels"))
    return sets.select(F.lit("orders").alias("dataset"), "row_id", LS.label_words(F.col("labels"), n_labels).alias("label_words"))


def _sets_sql(n_labels: int) -> str:
    long = " UNION ALL ".join(f"SELECT l_orderkey AS row_id, ({c})::INTEGER AS label FROM lineitem" for c in _LABELS[n_labels])
    words = ", ".join(
        f"coalesce(bit_or(CASE WHEN label // {LS.WORD} = {w} THEN 1::BIGINT << (label % {LS.WORD}) END), 0)::BIGINT" for w in range(LS.n_words(n_labels)))
    return f"""long AS (SELECT DISTINCT row_id, label FROM ({long}) WHERE label IS NOT NULL),
    rows AS MATERIALIZED (SELECT 'orders' AS dataset, row_id, [{words}] AS s FROM long GROUP BY row_id)"""


def _free(a: str, b: str, n_labels: int) -> str:
    return "(" + " AND ".join(f"({a}[{w + 1}] & {b}[{w + 1}]) = 0" for w in range(LS.n_words(n_labels))) + ")"


def _partners_sql(n_labels: int, draws: int) -> str:
    """First of the seeded draws among the rows without a common hot label that shares no label,
    else the row at a seeded rank among all rows that share none, ordered by set and hash."""
    draw = [str(SEED), "dataset", "iteration", "row_id", "'neg'"]
    return f"""WITH {_sets_sql(n_labels)},
    hot AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS i FROM long GROUP BY label QUALIFY i < {LS.HOT}),
    pat AS MATERIALIZED (SELECT r.*, coalesce(p.pat, 0)::BIGINT AS pat FROM rows r LEFT JOIN
            (SELECT row_id, sum(1::BIGINT << h.i) AS pat FROM long JOIN hot h USING (label) GROUP BY row_id) p USING (row_id)),
    pos AS (SELECT *, row_number() OVER (PARTITION BY pat ORDER BY {H("'pos'", 'row_id')}, row_id) - 1 AS p FROM pat),
    cnt AS (SELECT pat, count(*) AS n FROM pat GROUP BY pat),
    blk AS (SELECT a.pat AS a, b.pat AS b, b.n, sum(b.n) OVER (PARTITION BY a.pat ORDER BY b.pat) AS hi, sum(b.n) OVER (PARTITION BY a.pat) AS tot
            FROM cnt a JOIN cnt b ON (a.pat & b.pat) = 0),
    ex AS (SELECT r.*, i.range AS iteration FROM pat r CROSS JOIN range({ITERS}) i),
    shot AS (SELECT e.*, j.range AS j, {H(*draw, 'j.range')} % t.tot::BIGINT AS r
             FROM ex e JOIN (SELECT DISTINCT a, tot FROM blk) t ON t.a = e.pat CROSS JOIN range({draws}) j),
    got AS (SELECT s.row_id, s.iteration, min(CASE WHEN {_free('s.s', 'o.s', n_labels)} THEN s.j END) AS j,
                   arg_min(o.row_id, s.j) FILTER (WHERE {_free('s.s', 'o.s', n_labels)}) AS other
            FROM shot s JOIN blk b ON b.a = s.pat AND s.r < b.hi AND s.r >= b.hi - b.n
                 JOIN pos o ON o.pat = b.b AND o.p = s.r - (b.hi - b.n)
            GROUP BY ALL),
    rest AS (SELECT e.* FROM ex e JOIN got g USING (row_id, iteration) WHERE g.j IS NULL),
    sets AS (SELECT s, count(*) AS n FROM rows GROUP BY s),
    pr AS (SELECT a.s AS a, b.s AS b, b.n, sum(b.n) OVER (PARTITION BY a.s ORDER BY b.s) AS hi, sum(b.n) OVER (PARTITION BY a.s) AS tot
           FROM (SELECT DISTINCT s FROM rest) a JOIN sets b ON {_free('a.s', 'b.s', n_labels)}),
    ranked AS (SELECT e.row_id, e.iteration, e.s, {H(*['e.' + d if d in ('dataset', 'iteration', 'row_id') else d for d in draw], "'rest'")} % t.tot::BIGINT AS r
               FROM rest e JOIN (SELECT DISTINCT a, tot FROM pr) t ON t.a = e.s),
    spos AS (SELECT row_id, s, row_number() OVER (PARTITION BY s ORDER BY {H("'pos'", 'row_id')}, row_id) - 1 AS p FROM rows)
    SELECT row_id, iteration::INTEGER AS iteration, other AS neg_row_id FROM got WHERE j IS NOT NULL
    UNION ALL
    SELECT k.row_id, k.iteration::INTEGER, o.row_id
    FROM ranked k JOIN pr b ON b.a = k.s AND k.r < b.hi AND k.r >= b.hi - b.n JOIN spos o ON o.s = b.b AND o.p = k.r - (b.hi - b.n)"""


def _register_partners(name: str, n_labels: int, draws: int) -> None:
    sql = f"SELECT row_id, iteration, neg_row_id FROM ({_partners_sql(n_labels, draws)})"

    @register(name, sql)
    def run(spark, sf):
        rows = order_sets(spark, sf, n_labels)
        ex = X.repeat_iterations(rows, ITERS)
        out = LS.disjoint_partners(ex, rows, ["dataset"], SEED, draws=draws)
        return out.select("row_id", "iteration", "neg_row_id")


_register_partners("negative_sample_100_labels", 100, LS.DRAWS)
_register_partners("negative_sample_crowded", 28, 1)


@register(
    "metric_f1_100_labels",
    f"""
    WITH {_sets_sql(100)},
    late AS (SELECT DISTINCT l_orderkey AS row_id, (l_partkey % 100)::INTEGER AS label FROM lineitem WHERE l_linenumber > 1),
    u AS (SELECT coalesce(t.row_id, p.row_id) AS row_id, coalesce(t.label, p.label) AS label, t.label IS NOT NULL AS t, p.label IS NOT NULL AS p
          FROM long t FULL JOIN late p ON t.row_id = p.row_id AND t.label = p.label),
    per AS (SELECT l.range AS label, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t) AS sup, count(*) FILTER (WHERE p) AS prd
            FROM range(100) l LEFT JOIN u ON u.label = l.range GROUP BY ALL),
    f AS (SELECT *, CASE WHEN sup + prd > 0 THEN 2.0::DOUBLE * tp / (sup + prd) ELSE 0.0 END AS f1 FROM per)
    SELECT (SELECT count(*) FROM rows) AS n,
           round((SELECT count(*) FROM (SELECT row_id FROM u GROUP BY row_id HAVING bool_and(t = p)))::DOUBLE / (SELECT count(*) FROM rows), 9) AS accuracy,
           round(avg(f1), 9) AS macro_f1, round(2.0::DOUBLE * sum(tp) / sum(sup + prd), 9) AS micro_f1,
           round(sum(f1 * sup)::DOUBLE / sum(sup), 9) AS weighted_f1
    FROM f
    """,
)
def q_metric_f1_100_labels(spark, sf):
    """Multi-label metrics over 100 labels: the labels of all lines of an order against those of its
    lines after the first."""
    label = (F.col("l_partkey") % 100).cast("int")
    sets = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(label).alias("all"), F.collect_set(F.when(F.col("l_linenumber") > 1, label)).alias("late"))
    pred = sets.select(LS.label_words(F.col("all"), 100).alias("true_mask"), LS.label_words(F.col("late"), 100).alias("pred_mask"))
    return V.multilabel_summary(pred, [], 100)
