"""Places of rows in a sorted order, without one task seeing them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.llm.common import stored

_SLOT_BITS = 33  # monotonically_increasing_id keeps a row's place in its partition in the low bits


def same(pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of pairs of columns; nulls are equal."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def ranked(rows: DataFrame, order: Sequence[str], group: Sequence[str] = (), place: str = "place", size: str = "size") -> DataFrame:
    """Add each row's place (from 0) by ``order`` in its group, and the group's number of rows.

    Nulls come first and are one group. Ties are dealt out in any order, so ``order`` should leave only rows
    whose places may be swapped. ``rows`` should be a stored table, as its sort key is sampled first.

    Rows are exchanged by ranges of (group, order), with the place in the input last, so that neither a
    hot group nor equal rows land in one task, and sorted there. A row for each partition and group is all
    that places need from elsewhere.
    """
    keys = [*group, *order]
    spread = rows.withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = spread.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at").drop("_at")
    laid = stored(sorted_rows.withColumn("_slot", F.monotonically_increasing_id()), "laid", wide=True)
    part = F.shiftright("_slot", _SLOT_BITS)
    names = [f"_g{i}" for i in range(len(group))]
    runs = laid.groupBy(part.alias("_p"), *[F.col(c).alias(n) for c, n in zip(group, names)]).agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # a group has at most one row for each partition here
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "*", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias(size)
    )
    found = laid.withColumn("_part", part).join(
        stored(runs, "runs"), same([("_part", "_p"), *zip(group, names)])
    )
    return found.withColumn(place, F.col("_slot") - F.col("_first") + F.col("_before")).select(*rows.columns, place, size)
