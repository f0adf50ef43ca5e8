"""Union of tables with different columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.functions.text import column
from roster.operators.shape import clean_id_columns, strip_quotes_all


def merge_sources(tables: Sequence[DataFrame], clean: bool = True) -> DataFrame:
    """All rows of all tables; columns in first-seen order, empty text where a table has no such column.

    Columns are text. ``clean`` also cleans id columns and removes quotes.
    """
    names = list(dict.fromkeys(c for t in tables for c in t.columns))
    aligned = [
        t.select(
            *[(column(c).cast("string") if c in t.columns else F.lit("")).alias(c) for c in names]
        )
        for t in tables
    ]
    merged = reduce(DataFrame.unionAll, aligned)
    return strip_quotes_all(clean_id_columns(merged)) if clean else merged
