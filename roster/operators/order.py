"""Row order: consecutive row numbers and exact-size parts without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.functions.text import column
from roster.session import cut_lineage

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low bits

PART_SIZES = (  # fixed values: offered rows per part
    5_000, 10_000, 15_000, 20_000, 25_000, 30_000, 50_000, 75_000, 100_000, 200_000, 300_000,
    500_000, 1_000_000,
)


def number_rows(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "row_number"
) -> DataFrame:
    """Add exact 1-based row numbers in ``order_by`` order.

    ``order_by`` must identify a row, which also lets the range exchange split the data evenly.
    Rows are range-partitioned and sorted once, kept in the checkpoint folder (range bounds come
    from a sample, so the layout must not be computed twice), and each partition is shifted by the
    number of rows before it. The shift table has one row per partition.
    """
    order = [column(c) for c in order_by]
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_rows.withColumn("_slot", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    )
    place = F.col("_slot").bitwiseAND((1 << _SLOT_BITS) - 1)
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(name, place + F.col("_shift") + 1)
        .drop("_part", "_slot", "_shift")
    )


def _runs(placed: DataFrame, place: Column) -> DataFrame:
    """A row for each stretch of a block's rows in one task: where it starts, its rows, and the rows before it in file order.

    ``_whole`` says that the rows of each stretch follow each other and that no two of a block overlap.
    """
    runs = placed.groupBy(
        F.shiftright("_slot", _SLOT_BITS).alias("_part"), place["path"].alias("_path"), place["block"].alias("_block")
    ).agg(
        F.min("_slot").alias("_first"), F.max("_slot").alias("_last"), F.count(F.lit(1)).alias("_rows"),
        F.min(place["seq"]).alias("_from"), F.max(place["seq"]).alias("_to"),
    )
    # one row a block: files first, then blocks in their file; files are summed up before they are put in order
    in_file = Window.partitionBy("_path").orderBy("_block", "_from")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.lag("_block").over(in_file) < F.col("_block")) | (F.lag("_to").over(in_file) < F.col("_from")), F.lit(True))
    whole = (F.col("_last") - F.col("_first") + 1 == F.col("_rows")) & apart
    runs = runs.select("*", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_in_file"), whole.alias("_whole"))
    files = runs.groupBy("_path").agg(F.sum("_rows").alias("_file_rows"))
    files_before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select(F.col("_path").alias("_file"), F.coalesce(F.sum("_file_rows").over(files_before), F.lit(0)).alias("_files_before"))
    return runs.join(files, F.col("_path") == F.col("_file")).select(
        "_part", "_path", "_block", "_first", (F.col("_in_file") + F.col("_files_before")).alias("_before"), "_whole"
    )


def number_file_rows(df: DataFrame, name: str = "row_number", order: str = "row_order") -> DataFrame:
    """Add exact 1-based row numbers in file order to a table as the reader gives it, without moving its rows.

    The rows of a block are together in one task and in order, so a row's number is its place among them plus the rows of
    the blocks before, which one count per block tells. The files are scanned twice. Steps between the reader
    and here may drop or change rows but not exchange them; rows that were exchanged are sorted by ``number_rows``.
    """
    place = column(order)
    slotted = df.withColumn("_slot", F.monotonically_increasing_id())
    runs = cut_lineage(_runs(slotted.select("_slot", order), place))
    if not runs.where("NOT _whole").isEmpty():
        return number_rows(df, [order], name)
    mine = (
        (F.shiftright("_slot", _SLOT_BITS) == F.col("_part")) & (place["path"] == F.col("_path")) & (place["block"] == F.col("_block"))
    )
    joined = slotted.join(F.broadcast(runs), mine)  # one small row a block
    return joined.select(*[column(c) for c in df.columns], (F.col("_slot") - F.col("_first") + F.col("_before") + 1).alias(name))


def split_in_parts(
    df: DataFrame, rows_per_part: int, order_by: Sequence[Column | str] | None = None, name: str = "part"
) -> DataFrame:
    """Add a 1-based part number; every part has exactly ``rows_per_part`` rows but the last.

    Without ``order_by`` parts are in file order, and rows stay where they are; see ``number_file_rows``.
    """
    if rows_per_part < 1:
        raise ValueError("rows_per_part must be positive")
    numbered = number_rows(df, order_by, "_row_number") if order_by else number_file_rows(df, "_row_number")
    part = F.floor((F.col("_row_number") - 1) / rows_per_part).cast("bigint") + 1
    return numbered.withColumn(name, part).drop("_row_number")
