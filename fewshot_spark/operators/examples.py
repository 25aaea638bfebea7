"""Training-example generation: anchors, triplets and pairs with seeded random partners.

A random partner of another class (or of the same class, or with a disjoint label set) is drawn
without comparing rows: rows of a split are laid out class after class at dense positions, a
draw is a hash modulo the number of admissible rows, and the partner is fetched by an equi-join
on (split, position). Work is O(rows x iterations); no cross join, no nested-loop join over rows.

Draw keys: ``h60(seed, <split keys>, iteration, row_id, tag)`` so the same row draws differently
in every split, iteration and role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..functions import ranking
from ..functions.ranking import number_by_hash
from . import label_sets as LS

POS_BITS = None  # sub-group bits of the position numbering: chosen from the largest class
MAX_BROADCAST_ANCHORS = 1_000_000
PAIRED_LABELS = 12  # up to 4,096 label sets are paired; with more labels partners are drawn
_LOW = (1 << LS.WORD) - 1


# ---- anchors (G1, J1) ----------------------------------------------------------------------


def generate_anchors(template: str, labels: list[str]) -> dict[int, str]:
    """``{label_id: template + name}``; the template is kept verbatim."""
    return {i: template + name for i, name in enumerate(labels)}


def anchors_frame(catalogue: DataFrame) -> DataFrame:
    """Anchor sentences of catalogue rows: ``(dataset, variant, label_id, anchor)``."""
    return catalogue.select(
        "dataset", "variant", "label_id", F.concat("template", "label_name").alias("anchor")
    )


def join_anchor(
    df: DataFrame,
    anchors: DataFrame,
    on: list[str] | None = None,
    label_col: str = "label",
    check: bool = True,
) -> DataFrame:
    """Attach ``anchor`` to each row by its label (broadcast: anchors are a catalogue slice).

    A label with no anchor raises (naming the label) when ``check``.
    """
    on = on or []
    a = anchors.select(*on, F.col("label_id").alias(label_col), "anchor")
    side = F.broadcast(a) if a.count() <= MAX_BROADCAST_ANCHORS else a  # one anchor per class: small
    if check:
        missing = df.select(*on, label_col).distinct().join(side, [*on, label_col], "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"no anchor for label(s) {[tuple(r) for r in missing]}")
    return df.join(side, [*on, label_col])


def anchors_lookup(anchors: dict[int, str], label_col: str = "label") -> Column:
    """Anchor by a literal map (no join); an unknown label raises."""
    m = F.create_map(*[x for k, v in anchors.items() for x in (F.lit(int(k)), F.lit(v))])
    a = F.try_element_at(m, F.col(label_col))
    return F.when(a.isNull(), F.raise_error(F.concat(F.lit("no anchor for label "), F.col(label_col).cast("string")))).otherwise(a)


# ---- iterations and layout (U4, positions) -------------------------------------------------


def repeat_iterations(df: DataFrame, iterations: int, out: str = "iteration") -> DataFrame:
    """Every row once per iteration (``explode(sequence(0, n - 1))``)."""
    if iterations < 1:
        raise ValueError("iterations must be >= 1")
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))


def class_layout(df: DataFrame, split_keys: list[str], class_col: str) -> DataFrame:
    """Per (split, class): ``n_c`` rows, ``off_c`` = rows of smaller classes, ``tot`` = split rows."""
    counts = df.groupBy(*split_keys, class_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(*split_keys).orderBy(class_col)
    return counts.withColumn(
        "off_c", F.coalesce(F.sum("n_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    ).withColumn("tot", F.sum("n_c").over(Window.partitionBy(*split_keys)))


def lay_out(df: DataFrame, split_keys: list[str], class_col: str, id_col: str = "row_id", bits: int | None = POS_BITS,
            check_other: bool = False) -> DataFrame:
    """Dense positions: class c of a split occupies ``[off_c, off_c + n_c)``, rows inside a class
    ordered by ``h60('pos', id)``. Adds ``pos_c``, ``pos``, ``n_c``, ``off_c``, ``tot``.

    With ``check_other`` a split with a single class raises. Nothing is cached here: a caller that
    draws several partners from a layout over a large table may persist it, and free it again.
    """
    layout = class_layout(df, split_keys, class_col)
    if check_other or bits is None:
        # one small job: largest class and the first split with a single class
        single = F.when(F.col("n_c") == F.col("tot"), F.to_json(F.struct(*split_keys, class_col)))
        stats = layout.agg(F.max("n_c").alias("m"), F.min(single).alias("single")).first()
        if check_other and stats["single"] is not None:
            raise ValueError(f"split with one class only, no negative can be drawn: {stats['single']}")
    if bits is None:
        m = stats["m"] or 0
        bits = 0
        while m > ranking.GROUP_ROWS_PER_TASK and bits < 12:
            m //= 2
            bits += 1
    hp = df.withColumn("_hp", h60(F.lit("pos"), F.col(id_col)))
    numbered = number_by_hash(hp, [*split_keys, class_col], "_hp", id_col, out="pos_c", bits=bits).drop("_hp")
    return numbered.join(layout, [*split_keys, class_col]).withColumn("pos", F.col("off_c") + F.col("pos_c"))


def _check_other_class(layout: DataFrame, split_keys: list[str], class_col: str) -> None:
    single = layout.where(F.col("n_c") == F.col("tot")).select(*split_keys, class_col).limit(5).collect()
    if single:
        raise ValueError(f"split(s) with one class only, no negative can be drawn: {[r.asDict() for r in single]}")


def _draw(seed: int, split_keys: list[str], tag: str, id_col: str = "row_id", extra: list[str] | None = None) -> Column:
    return h60(F.lit(int(seed)), *[F.col(k) for k in split_keys], F.col("iteration"), F.col(id_col), *[F.col(c) for c in (extra or [])], F.lit(tag))


# ---- single-label partners (J2, J3) --------------------------------------------------------


def _partner(
    ex: DataFrame,
    laid: DataFrame,
    split_keys: list[str],
    target: Column,
    out_id: str,
    out_text: str | None,
    text_col: str,
    id_col: str,
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Fetch the row at ``target``; ``carry`` names further columns of it (source -> output)."""
    other = laid.select(*split_keys, F.col("pos").alias("_target"), F.col(id_col).alias(out_id),
                        *([F.col(text_col).alias(out_text)] if out_text else []),
                        *[F.col(c).alias(o) for c, o in (carry or {}).items()])
    return ex.withColumn("_target", target).join(other, [*split_keys, "_target"]).drop("_target")


def negative_sample(
    ex: DataFrame,
    laid: DataFrame,
    split_keys: list[str],
    seed: int,
    out_id: str = "neg_row_id",
    out_text: str | None = "negative",
    text_col: str = "text",
    id_col: str = "row_id",
    tag: str = "neg",
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Uniform row of another class in the same split: ``r = h % (tot - n_c)``, skip the own block."""
    r = _draw(seed, split_keys, tag, id_col) % (F.col("tot") - F.col("n_c"))
    target = F.when(r < F.col("off_c"), r).otherwise(r + F.col("n_c"))
    return _partner(ex, laid, split_keys, target, out_id, out_text, text_col, id_col, carry)


def positive_sample(
    ex: DataFrame,
    laid: DataFrame,
    split_keys: list[str],
    seed: int,
    out_id: str = "pos_row_id",
    out_text: str | None = "positive",
    text_col: str = "text",
    id_col: str = "row_id",
    tag: str = "pos",
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Uniform row of the same class (itself allowed): ``off_c + h % n_c``."""
    target = F.col("off_c") + _draw(seed, split_keys, tag, id_col) % F.col("n_c")
    return _partner(ex, laid, split_keys, target, out_id, out_text, text_col, id_col, carry)


def gen_triplets(
    rows: DataFrame,
    anchors: dict[int, str] | DataFrame,
    iterations: int,
    seed: int,
    split_keys: list[str],
    label_col: str = "label",
    text_col: str | None = "text",
    id_col: str = "row_id",
    bits: int = POS_BITS,
) -> DataFrame:
    """(anchor of the row's class, row, random row of another class) per row and iteration.

    Output: ``split keys, iteration, row_id, label, neg_row_id, anchor, positive, negative``;
    with ``text_col=None`` the ids only (no text is laid out or cached).
    A split with a single class raises.
    """
    base = rows if text_col else rows.select(*split_keys, id_col, label_col)
    laid = lay_out(base, split_keys, label_col, id_col, bits, check_other=True)
    ex = repeat_iterations(laid, iterations)
    if isinstance(anchors, dict):
        ex = ex.withColumn("anchor", anchors_lookup(anchors, label_col))
    else:
        ex = join_anchor(ex, anchors, label_col=label_col)
    out = negative_sample(ex, laid, split_keys, seed, out_text="negative" if text_col else None,
                          text_col=text_col or "text", id_col=id_col)
    texts = [F.col(text_col).alias("positive"), "negative"] if text_col else []
    return out.select(*split_keys, "iteration", id_col, label_col, "neg_row_id", "anchor", *texts)


def gen_pairs(
    rows: DataFrame,
    iterations: int,
    seed: int,
    split_keys: list[str],
    label_col: str = "label",
    text_col: str | None = "text",
    id_col: str = "row_id",
    bits: int = POS_BITS,
) -> DataFrame:
    """Per row and iteration one positive pair (same class, target 1.0) and one negative pair
    (another class, target 0.0). Output: ``split keys, iteration, row_id, other_row_id, text_a,
    text_b, target``; with ``text_col=None`` the ids and target only."""
    base = rows if text_col else rows.select(*split_keys, id_col, label_col)
    laid = lay_out(base, split_keys, label_col, id_col, bits, check_other=True)
    ex = repeat_iterations(laid, iterations)
    out_text = "text_b" if text_col else None
    pos = positive_sample(ex, laid, split_keys, seed, out_id="other_row_id", out_text=out_text,
                          text_col=text_col or "text", id_col=id_col).withColumn("target", F.lit(1.0))
    neg = negative_sample(ex, laid, split_keys, seed, out_id="other_row_id", out_text=out_text,
                          text_col=text_col or "text", id_col=id_col).withColumn("target", F.lit(0.0))
    texts = [F.col(text_col).alias("text_a"), "text_b"] if text_col else []
    cols = [*split_keys, "iteration", id_col, "other_row_id", *texts, "target"]
    return pos.select(*cols).unionByName(neg.select(*cols))


# ---- multi-label partners (J4, J5) ---------------------------------------------------------


def disjoint_blocks(rows: DataFrame, split_keys: list[str], mask_col: str = "label_mask") -> DataFrame:
    """Per (split, mask a): the masks b with ``a & b = 0`` as sorted blocks ``[lo, hi)`` of the
    concatenated rows of those masks, and ``tot_a``. Works on distinct masks only (small)."""
    keys = split_keys or []
    mc = rows.groupBy(*keys, mask_col).agg(F.count(F.lit(1)).alias("n_m"))
    a = mc.select(*keys, F.col(mask_col).alias("a_mask"))
    b = mc.select(*keys, F.col(mask_col).alias("b_mask"), "n_m")
    cond = [a[k] == b[k] for k in keys] + [(F.col("a_mask").bitwiseAND(F.col("b_mask"))) == 0]
    pairs = a.join(b, cond).select(*[a[k] for k in keys], "a_mask", "b_mask", "n_m")
    w = Window.partitionBy(*keys, "a_mask").orderBy("b_mask")
    pairs = pairs.withColumn(
        "lo", F.coalesce(F.sum("n_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    ).withColumn("hi", (F.col("lo") + F.col("n_m")).cast("bigint"))
    return pairs.groupBy(*keys, "a_mask").agg(
        F.sort_array(F.collect_list(F.struct("hi", "lo", "b_mask"))).alias("blocks"),
        F.sum("n_m").cast("bigint").alias("tot_a"),
    )


def disjoint_negative(
    ex: DataFrame,
    rows: DataFrame,
    split_keys: list[str],
    seed: int,
    mask_col: str = "label_mask",
    text_col: str | None = "text",
    id_col: str = "row_id",
    on_empty: str = "skip",
    out_id: str = "neg_row_id",
    out_text: str | None = "negative",
    bits: int = POS_BITS,
    tag: str = "neg",
    method: str | None = None,
) -> DataFrame:
    """Uniform row of the split whose label set shares no label with the example's row.

    ``on_empty='raise'`` fails when a row has no such partner; ``'skip'`` drops those examples.
    ``method='pairs'`` pairs the distinct masks of a split, ``'draws'`` is
    ``label_sets.disjoint_partners`` (the draws differ). Words always take the draws; masks take
    the pairs unless told otherwise.
    """
    if method not in (None, "pairs", "draws"):
        raise ValueError("method is 'pairs' or 'draws'")
    words = LS.is_words(rows, mask_col)
    if words and method == "pairs":
        raise ValueError("label sets as words take the method 'draws'")
    if words or method == "draws":
        as_words = F.col(mask_col) if words else F.array(F.col(mask_col).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(mask_col, LS.WORD))
        found = LS.disjoint_partners(ex.withColumn("_words", as_words), rows.withColumn("_words", as_words), split_keys, seed,
                                     "_words", id_col, out_id, on_empty, bits, tag).drop("_words")
        if not (out_text and text_col):
            return found
        other = rows.select(*split_keys, F.col(id_col).alias(out_id), F.col(text_col).alias(out_text))
        return found.join(other, [*split_keys, out_id]).select(*ex.columns, out_id, out_text)
    blocks = disjoint_blocks(rows, split_keys, mask_col)
    ex2 = ex.withColumn("a_mask", F.col(mask_col))
    joined = ex2.join(blocks, [*split_keys, "a_mask"], "left")
    if on_empty == "raise":
        bad = joined.where(F.col("tot_a").isNull()).select(*split_keys, id_col).limit(5).collect()
        if bad:
            raise ValueError(f"row(s) with no disjoint-label partner: {[r.asDict() for r in bad]}")
    elif on_empty != "skip":
        raise ValueError("on_empty is 'raise' or 'skip'")
    joined = joined.where(F.col("tot_a").isNotNull())
    r = _draw(seed, split_keys, tag, id_col) % F.col("tot_a")
    blk = F.element_at(F.filter("blocks", lambda x: x["hi"] > F.col("_r")), 1)
    drawn = joined.withColumn("_r", r).withColumn("_blk", blk).select(
        *[c for c in ex.columns], F.col("_blk.b_mask").alias("_b"), (F.col("_r") - F.col("_blk.lo")).alias("_p")
    )
    hp = rows.withColumn("_hp", h60(F.lit("pos"), F.col(id_col)))
    texts = [F.col(text_col).alias(out_text)] if (out_text and text_col) else []
    laid = number_by_hash(hp, [*split_keys, mask_col], "_hp", id_col, out="_p", bits=bits).select(
        *split_keys, F.col(mask_col).alias("_b"), "_p", F.col(id_col).alias(out_id), *texts
    )
    return drawn.join(laid, [*split_keys, "_b", "_p"]).drop("_b", "_p")


def _method(label_cols: list[str]) -> str:
    """How disjoint partners are found: label sets are paired only where few can exist."""
    return "pairs" if len(label_cols) <= PAIRED_LABELS else "draws"


def gen_triplets_multilabel(
    rows: DataFrame,
    template: str,
    label_cols: list[str],
    names: list[str],
    iterations: int,
    seed: int,
    split_keys: list[str],
    mask_col: str = "label_mask",
    text_col: str | None = "text",
    id_col: str = "row_id",
    on_empty: str = "raise",
    bits: int = POS_BITS,
) -> DataFrame:
    """(template + ', '.join(set label names), row, random row sharing no label) per labelled row
    and iteration (ids and anchor only with ``text_col=None``). Unlabelled rows are never anchors
    but may be negatives."""
    from .prepare import multilabel_anchor

    ex = repeat_iterations(rows.where(LS.has_label(rows, mask_col)), iterations).withColumn(
        "anchor", multilabel_anchor(template, label_cols, names)
    )
    out = disjoint_negative(ex, rows, split_keys, seed, mask_col, text_col, id_col, on_empty, bits=bits,
                            method=_method(label_cols))
    texts = [F.col(text_col).alias("positive"), "negative"] if text_col else []
    return out.select(*split_keys, "iteration", id_col, mask_col, "neg_row_id", "anchor", *texts)


def positive_sample_multilabel(
    ex_rows: DataFrame,
    rows: DataFrame,
    label_cols: list[str],
    iterations: int,
    seed: int,
    split_keys: list[str],
    text_col: str | None = "text",
    id_col: str = "row_id",
    bits: int = POS_BITS,
) -> DataFrame:
    """For each row of ``ex_rows``, iteration and set label: a uniform row of ``rows`` carrying that
    label (itself allowed). Output: ``split keys, iteration, row_id, label_id, other_row_id,
    text_a, text_b`` (ids only with ``text_col=None``)."""
    from .prepare import label_unpivot

    tcols = [text_col] if text_col else []
    laid = lay_out(label_unpivot(rows, [*split_keys, id_col, *tcols], label_cols), split_keys, "label_id", id_col, bits)
    sizes = class_layout(label_unpivot(rows, [*split_keys, id_col], label_cols), split_keys, "label_id").select(
        *split_keys, "label_id", "n_c", "off_c"
    )
    ex = repeat_iterations(label_unpivot(ex_rows, [*split_keys, id_col, *tcols], label_cols), iterations)
    ex = ex.join(sizes, [*split_keys, "label_id"])
    target = F.col("off_c") + _draw(seed, split_keys, "pos", id_col, ["label_id"]) % F.col("n_c")
    other = laid.select(*split_keys, F.col("pos").alias("_t"), F.col(id_col).alias("other_row_id"),
                        *([F.col(text_col).alias("text_b")] if text_col else []))
    texts = [F.col(text_col).alias("text_a"), "text_b"] if text_col else []
    return ex.withColumn("_t", target).join(other, [*split_keys, "_t"]).select(
        *split_keys, "iteration", id_col, "label_id", "other_row_id", *texts
    )


def gen_pairs_multilabel(
    rows: DataFrame,
    label_cols: list[str],
    iterations: int,
    seed: int,
    split_keys: list[str],
    mask_col: str = "label_mask",
    text_col: str | None = "text",
    id_col: str = "row_id",
    bits: int = POS_BITS,
) -> DataFrame:
    """Per row and iteration: for each set label one positive (a row with that label, itself
    allowed, target 1.0) and one negative sharing no label (target 0.0). Rows with no disjoint
    partner are skipped entirely. Output: ``split keys, iteration, row_id, label_id, other_row_id,
    text_a, text_b, target`` (label_id is -1 on negatives; no texts with ``text_col=None``)."""
    method = _method(label_cols)
    if method == "pairs":
        blocks = disjoint_blocks(rows, split_keys, mask_col).select(*split_keys, F.col("a_mask").alias(mask_col))
        eligible = rows.join(blocks, [*split_keys, mask_col], "left_semi")
        ex = repeat_iterations(eligible, iterations)
    else:
        ex = repeat_iterations(rows, iterations)
    neg = disjoint_negative(ex, rows, split_keys, seed, mask_col, text_col, id_col, "skip",
                            out_id="other_row_id", out_text="text_b" if text_col else None, bits=bits, method=method)
    if method == "draws":  # a row has a partner in every iteration or in none
        partnered = neg.where(F.col("iteration") == 0).select(*split_keys, id_col)
        eligible = rows.join(partnered, [*split_keys, id_col], "left_semi")
    texts = [F.col(text_col).alias("text_a"), "text_b"] if text_col else []
    neg = neg.select(*split_keys, "iteration", id_col, F.lit(-1).alias("label_id"), "other_row_id",
                     *texts, F.lit(0.0).alias("target"))
    pos = positive_sample_multilabel(eligible, rows, label_cols, iterations, seed, split_keys, text_col, id_col, bits)
    return pos.withColumn("target", F.lit(1.0)).unionByName(neg)


# ---- batches (U5) --------------------------------------------------------------------------


def assign_batches(
    ex: DataFrame,
    split_keys: list[str],
    batch_size: int,
    seed: int,
    key_cols: list[str],
    bits: int = POS_BITS,
) -> DataFrame:
    """Shuffled batches per split: ``batch_id = pos // batch_size`` with positions in
    ``h60(seed, split keys, 'batch', key_cols)`` order; adds ``steps = ceil(n / b)`` and
    ``warmup_steps = ceil(0.1 * steps)``."""
    h = h60(F.lit(int(seed)), *[F.col(k) for k in split_keys], F.lit("batch"), *[F.col(c) for c in key_cols])
    numbered = number_by_hash(ex.withColumn("_hb", h), split_keys, "_hb", key_cols, out="_pos", bits=bits, with_counts=True)
    steps = F.ceil(F.col("group_n") / F.lit(batch_size))
    return (
        numbered.withColumn("batch_id", F.floor(F.col("_pos") / F.lit(batch_size)).cast("bigint"))
        .withColumn("steps", steps.cast("bigint"))
        .withColumn("warmup_steps", F.ceil(F.col("steps") * F.lit(0.1)).cast("bigint"))
        .drop("_hb", "_pos", "group_n")
    )
