"""Label-name ablations: which names and template build the anchors.

Variants: ``default`` (the set's own names and template), ``SHORT`` (no template), ``QA`` (a
question template), ``A`` (other names and template, only for the sets that have them),
``PEM`` (names permuted so that no label keeps its own name), ``ALF`` (letters a, b, c, ...;
at most 26 classes). ``B`` has no tables and is rejected.

``derange_labels`` draws uniformly among all derangements of a group without enumerating n!
orders: the labels are put in the hash orders ``h60(seed, group, try, label_id)`` of ``TRIES``
tries, and the first order in which no label stands at its own place counts (an order is one with
probability about 1/e, so none of them is with 2e-13; such a group takes the cycle).
``permute_labels`` is that cycle: a cyclic shift of one hash order, which reaches only the
single-cycle derangements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60

STORED = ("default", "SHORT", "QA", "A")
ALPHABET_SIZE = 26
TRIES = 64


def _check_pairs(labels: DataFrame, group_cols: list[str]) -> None:
    single = labels.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < 2).limit(1).collect()
    if single:
        raise ValueError(f"cannot permute a single label without a fixed point: {single[0].asDict()}")


def derange_labels(
    labels: DataFrame,
    group_cols: list[str],
    seed: int,
    id_col: str = "label_id",
    name_col: str = "label_name",
    out: str = "shown_name",
    tries: int = TRIES,
) -> DataFrame:
    """Add ``out``: the name of another label of the group, by a uniform derangement of each group.

    Ids are unique in a group. A group with one label cannot be deranged and raises."""
    cycle = permute_labels(labels, group_cols, seed, id_col, name_col, "_cycle")
    own = Window.partitionBy(*group_cols).orderBy(id_col)
    placed = cycle.withColumn("_at", F.row_number().over(own)).withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    h = h60(F.lit(int(seed)), *[F.col(g) for g in group_cols], F.col("_try"), F.col(id_col))
    order = Window.partitionBy(*group_cols, "_try").orderBy("_h", id_col)
    ranked = placed.withColumn("_h", h).withColumn("_to", F.row_number().over(order)).select(
        *group_cols, "_try", "_at", "_to", F.col(name_col).alias("_name"))
    good = ranked.groupBy(*group_cols, "_try").agg(F.max((F.col("_at") == F.col("_to")).cast("int")).alias("_fixed")).where("_fixed = 0")
    first = good.groupBy(*group_cols).agg(F.min("_try").alias("_try"))
    shown = ranked.join(first, [*group_cols, "_try"]).select(*group_cols, F.col("_to").alias("_at"), F.col("_name").alias("_shown"))
    return (
        cycle.withColumn("_at", F.row_number().over(own))
        .join(shown, [*group_cols, "_at"], "left")
        .withColumn(out, F.coalesce("_shown", "_cycle"))
        .select(*labels.columns, out)
    )


def permute_labels(
    labels: DataFrame,
    group_cols: list[str],
    seed: int,
    id_col: str = "label_id",
    name_col: str = "label_name",
    out: str = "shown_name",
) -> DataFrame:
    """Add ``out``: the name of the next label in the seeded cycle of each group.

    A group with one label cannot be deranged and raises.
    """
    _check_pairs(labels, group_cols)
    h = h60(F.lit(int(seed)), *[F.col(g) for g in group_cols], F.col(id_col))
    w = Window.partitionBy(*group_cols).orderBy("_h", id_col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        labels.withColumn("_h", h)
        .withColumn(out, F.coalesce(F.lead(name_col).over(w), F.first(name_col).over(whole)))
        .drop("_h")
    )


def letter_labels(labels: DataFrame, id_col: str = "label_id", out: str = "shown_name") -> DataFrame:
    """Name label i by the i-th letter; more than 26 labels raise."""
    too_many = labels.where(F.col(id_col) >= ALPHABET_SIZE).limit(1).collect()
    if too_many:
        raise ValueError("the letter variant supports at most 26 classes")
    return labels.withColumn(out, F.char(F.lit(97) + F.col(id_col)))


def anchors_variant(catalogue: DataFrame, variant: str, seed: int = 0, datasets: list[str] | None = None) -> DataFrame:
    """Anchors of one variant: ``(dataset, variant, label_id, label_name, shown_name, template, anchor)``.

    ``label_name`` stays the real name (for result keys); ``shown_name`` is what the anchor says.
    Sets without tables for the variant are left out.
    """
    if variant == "B":
        raise ValueError("variant 'B' has no label or template tables")
    cat = catalogue if datasets is None else catalogue.where(F.col("dataset").isin(list(datasets)))
    if variant in STORED:
        rows = cat.where(F.col("variant") == variant).withColumn("shown_name", F.col("label_name"))
    elif variant == "PEM":
        base = cat.where(F.col("variant") == "default")
        rows = derange_labels(base, ["dataset"], seed).withColumn("variant", F.lit("PEM"))
    elif variant == "ALF":
        base = cat.where(F.col("variant") == "default")
        rows = letter_labels(base).withColumn("variant", F.lit("ALF"))
    else:
        rows = cat.where(F.col("variant") == "default").withColumn("shown_name", F.col("label_name"))
    return rows.select(
        "dataset", "variant", "label_id", "label_name", "shown_name", "template",
        F.concat("template", "shown_name").alias("anchor"),
    )
