"""Mixing sources to target weights by Pareto order sampling.

Every source gets a word target. A document is expected `scale * merit` times, at most
`most` times, so that the expected words of its source meet the target. The whole part of
that number are certain copies. For the rest p, documents are ranked by Pareto's ratio
(u / (1 - u)) / (p / (1 - p)), u a repeatable uniform number, and taken in that order until
the words still missing are reached: the size of the sample is fixed, in words, the unit of
the mix, and the documents' chances differ. The last document is in if that comes nearer.

No source is sorted or brought to one task: sums over ranges of the ratio narrow the cut
down twelve bits at a time, so a source with a third of all rows costs a few partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanmill.llm.base import numbered_in_order, word_count
from loanmill.sources.scratch import Scratch

# Bits of the ratio, and how many of them a pass looks at.
_BITS, _STEP = 48, 12


def length_merit(size: Column) -> Column:
    """Whole number of doublings of the length, so that fragments come less often than pages."""
    return F.floor(F.log2(size + 1)) + 1


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """Rows with their size, merit on a grid of quarter doublings, and uniform number."""
    size = word_count(F.col("text"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)
    return docs.select(
        F.struct("*").alias("row"), "source", size.alias("size"), ((u + 0.5) / 2.0**53).alias("u")
    )


def _with_merit(rows: DataFrame, merit) -> DataFrame:
    grid = F.round(4 * F.log2(merit(F.col("size")).cast("double")))
    return rows.withColumn("merit", F.pow(F.lit(2.0), grid / 4))


def _targets(sources: DataFrame, share: float, most: int, scratch: Scratch) -> DataFrame:
    """Adds `target`: the budget by weight, what exceeds `most` sizes reshared until none does."""
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    per_weight, capped = 0.0, -1
    while True:
        over = F.col("weight") * per_weight > cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(over.cast("int")).alias("n"),
        ).first()
        if not row.weights or row.n == capped:
            break
        per_weight, capped = (share * total - row.fixed) / row.weights, row.n
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(per_weight)))
    return sources.withColumn("target", target)


def _expected(most: int) -> Column:
    return F.round(F.least(F.lit(float(most)), F.col("scale") * F.col("merit")), 9)


def _ratio_key() -> Column:
    """Pareto's ratio r as r / (1 + r) in fixed point: same order, from 0 to 2^48."""
    u, p = F.col("u"), F.col("chance")
    return F.floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * 2.0**_BITS).cast("long")


def _drawn(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Rows with their source's plan, certain copies, chance of one more, and ratio."""
    plan = sources.withColumnRenamed("source", "plan_source")
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
        .withColumn("certain", F.floor(_expected(most)))
        .withColumn("chance", _expected(most) - F.col("certain"))
        .withColumn("ratio", F.when(F.col("chance") > 0, _ratio_key()))
    )


def _cuts(drawn: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source the last ratio that is taken."""
    ranked = scratch.keep(
        drawn.where("ratio IS NOT NULL AND size > 0").select("source", "need", "ratio", "size"),
        "ranked",
    )
    state = None
    for shift in range(_BITS - _STEP, -1, -_STEP):
        rows = ranked.withColumn("bin", F.shiftright("ratio", shift))
        if state is None:
            rows = rows.withColumn("before", F.lit(0).cast("long"))
        else:
            known = state.select(F.col("source").alias("s"), F.col("bin").alias("within"), "before")
            rows = rows.join(
                known,
                F.col("source").eqNullSafe(F.col("s"))
                & (F.shiftright("bin", _STEP) == F.col("within")),
            )
        upto = Window.partitionBy("source").orderBy("bin")
        crossing = (
            rows.groupBy("source", "bin")
            .agg(F.sum("size").alias("words"), F.max("need").alias("need"), F.max("before").alias("b"))
            .withColumn("reached", F.col("b") + F.sum("words").over(upto))
            .where("reached >= need")
            .groupBy("source")
            .agg(F.min(F.struct("bin", "reached", "words", "need")).alias("at"))
        )
        state = scratch.keep(
            crossing.select(
                "source", "at.bin", (F.col("at.reached") - F.col("at.words")).alias("before"),
                "at.reached", "at.need",
            ),
            f"cut_{shift}",
        )
    nearer = F.col("reached") - F.col("need") <= F.col("need") - F.col("before")
    return state.select(
        F.col("source").alias("cut_source"),
        F.when(nearer, F.col("bin")).otherwise(F.col("bin") - 1).alias("cut"),
    )


def mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 1,
    merit=length_merit,
) -> DataFrame:
    """`row` (all columns of the document), `source`, `size`, `source_size`, `target`, `copies`.

    Sources in code-point order, null last, weigh `weights`, repeating. The mix holds `share`
    times all words; no source gives more than `most` times its own. `merit` makes the
    relative chance from the size. Every input row comes back once; `copies` says how often
    the mix holds it. A text without words, or null, has size 0 and adds nothing. Rows equal
    in doc_id and text tie and are in or out together. An empty table gives no rows.
    """
    rows = _with_merit(_measured(docs, seed), merit)
    measured = scratch.keep(rows.drop("row"), "measured")
    classes = scratch.keep(
        measured.groupBy("source", "merit").agg(F.sum("size").alias("words")), "classes"
    )
    names = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    ordered = numbered_in_order(names, [F.asc_nulls_last("source")], scratch, "sources")
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")
    )
    sources = _targets(ordered.withColumn("weight", weight), share, most, scratch)

    # Within a source: the scale at which expected words meet the target, `most` being the top.
    known = sources.select(F.col("source").alias("s"), "source_size", "target")
    by_merit = Window.partitionBy("source").orderBy(F.desc("merit"))
    above = by_merit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_merit.rowsBetween(0, Window.unboundedFollowing)
    at_top = F.coalesce(F.sum("words").over(above), F.lit(0))
    left = F.sum(F.col("merit") * F.col("words")).over(rest)
    scale = F.when(left > 0, (F.col("target") - most * at_top) / left).otherwise(0.0)
    levels = (
        classes.join(known, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("scale", scale)
        .withColumn("fits", F.col("scale") * F.col("merit") <= most + 1e-9)
    )
    chosen = F.first(F.when(F.col("fits"), F.col("scale")), ignorenulls=True).over(
        by_merit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    certain = F.sum(F.floor(_expected(most)) * F.col("words"))
    plan = scratch.keep(
        levels.withColumn("scale", F.coalesce(chosen, F.lit(0.0)))
        .groupBy("source", "source_size", "target", "scale")
        .agg(certain.alias("certain_words"))
        .select(
            "source", "source_size", "target", "scale",
            (F.col("target") - F.col("certain_words")).alias("need"),
        ),
        "plan",
    )
    cuts = _cuts(_drawn(measured, plan, most), scratch)
    more = (F.col("ratio") <= F.coalesce(F.col("cut"), F.lit(2**_BITS))).cast("int")
    return (
        _drawn(rows, plan, most)
        .join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .select(
            "row", "source", "size", "source_size", "target",
            (F.col("certain") + F.coalesce(more, F.lit(0))).cast("int").alias("copies"),
        )
    )
