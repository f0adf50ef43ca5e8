"""Mixing sources to target weights by hash thresholds.

Every document has a 32-bit hash of its id. A source's budget is met by taking all documents whose
hash is under a threshold. The threshold comes from histograms of sizes by source and hash: the
first has 256 ranges over all documents; only the range in which the budget ends is looked at again,
in 256 finer ranges, until ranges are single hashes. No documents are sorted, thresholds of smaller
budgets take subsets of what larger ones take, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.llm.common import WORD, id_text, stored, without

WEIGHTS = (5, 2, 1)
CEILING = 3
BITS, LEVELS = 8, 4


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def id_hash() -> Column:
    """32 bits of the id."""
    return F.conv(F.substring(F.md5(id_text().cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> with ``target``: all sizes shared by weight, none above its ceiling.

    Sources in code point order, null last, have the weights in turn. With the sources by rising
    ceiling per weight, what each and those after it would get per weight if all before them are at
    their ceilings rises until the first source that stays under its own, and falls after it; the
    largest is the share. One row per source is windowed, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    weighted = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
    rising = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - ceiling * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    shared = weighted.withColumn("_share", left / F.sum("_weight").over(after))
    share = F.max("_share").over(Window.partitionBy()) * F.col("_weight")
    top = (ceiling * F.col("source_size")).cast("double")
    return shared.select("source", "source_size", F.least(top, share).alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source of ``plan``: ``copies`` all its documents get, and the hash under which one more.

    ``sized`` has (source, _hash, _size). The threshold is the one whose total is nearest the budget.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.withColumn("copies", copies.cast("long")).select(
        F.col("source").alias("_of"), "source_size", "target", "copies",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("_budget"),
        F.lit(0).cast("long").alias("_range"), F.lit(0).cast("long").alias("_below"),
    )
    carried = ["source_size", "target", "copies", "_budget"]
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = F.shiftrightunsigned(F.col("_hash"), shift + BITS) == F.col("_range")
        bars = (
            sized.join(state, F.col("source").eqNullSafe(F.col("_of")) & inside)
            .groupBy(F.col("_of"), F.shiftrightunsigned("_hash", shift).alias("_bar"), *carried, "_below")
            .agg(F.sum("_size").alias("_sum"))
        )
        up_to = Window.partitionBy("_of").orderBy("_bar")
        reach = bars.withColumn("_reach", F.col("_below") + F.sum("_sum").over(up_to))
        last = F.struct(F.col("_reach") < F.col("_budget"), F.when(F.col("_reach") < F.col("_budget"), -F.col("_bar")).otherwise(F.col("_bar")))
        # the first range that reaches the budget, or else the last one
        state = reach.groupBy("_of", *carried).agg(F.min_by(F.struct("_bar", "_reach", "_sum"), last).alias("_b")).select(
            "_of", *carried, F.col("_b._bar").alias("_range"),
            (F.col("_b._reach") - F.col("_b._sum")).alias("_below"), F.col("_b._sum").alias("_sum"),
        )
    over, under = F.col("_below") + F.col("_sum") - F.col("_budget"), F.col("_budget") - F.col("_below")
    return state.select(
        F.col("_of"), "source_size", "target", F.col("copies").alias("_copies"),
        (F.col("_range") + F.when(over <= under, 1).otherwise(0)).alias("_limit"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Sizes are words; a null text has none. A null source is a source of its own, the last. Documents
    with the same id share their hash, so repeated rows are taken together. Where nothing has words,
    targets are 0 and nothing is taken. Input columns with the names of these outputs are replaced.
    """
    sized = stored(docs.select("source", id_hash().alias("_hash"), word_count().alias("_size")), "sizes", wide=True)
    plan = stored(targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, ceiling).coalesce(1), "targets")
    idle = plan.filter("source_size = 0").select(
        F.col("source").alias("_of"), "source_size", "target",
        F.lit(0).cast("long").alias("_copies"), F.lit(0).cast("long").alias("_limit"),
    )
    limits = stored(thresholds(sized.filter("_size > 0"), plan).unionByName(idle).coalesce(1), "limits")
    base = without(docs, "size", "source_size", "target", "copies", "taken")
    return (
        base.withColumns({"_size": word_count(), "_hash": id_hash()})
        .join(limits, F.col("source").eqNullSafe(F.col("_of")))
        .withColumn("copies", F.col("_copies") + F.when(F.col("_hash") < F.col("_limit"), 1).otherwise(0))
        .select(*base.columns, F.col("_size").alias("size"), "source_size", "target", "copies",
                (F.col("copies") * F.col("_size")).alias("taken"))
    )
