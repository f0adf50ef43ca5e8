"""Row filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from roster.functions.ids import cnpj_valid
from roster.functions.numbers import plain_number
from roster.functions.text import column, is_blank


def nonzero(df: DataFrame, name: str):
    """Condition: the value is there and is not zero in whatever form."""
    if isinstance(df.schema[name].dataType, NumericType):
        return column(name).isNotNull() & (column(name) != 0)
    return ~is_blank(name) & F.coalesce(plain_number(name) != 0, F.lit(True))


def drop_empty_or_zero(df: DataFrame, name: str) -> DataFrame:
    """Drop rows whose value is null, blank or zero."""
    return df.where(nonzero(df, name))


def filter_date_range(
    df: DataFrame, ts: str, first: dt.date | str, last: dt.date | str
) -> DataFrame:
    """Rows on calendar days ``first`` to ``last``, both included; swapped bounds are put right.

    The bounds are written as a range on the column itself, so a Parquet scan can skip row groups.
    """
    low, high = sorted(dt.date.fromisoformat(str(d)) for d in (first, last))
    kind = df.schema[ts].dataType
    kind = kind.simpleString() if isinstance(kind, (TimestampType, TimestampNTZType)) else "date"
    start = F.lit(low.isoformat()).cast(kind)
    end = F.lit((high + dt.timedelta(days=1)).isoformat()).cast(kind)
    return df.where((column(ts) >= start) & (column(ts) < end))


def valid_cnpj_only(df: DataFrame, name: str) -> DataFrame:
    """Rows whose id has exactly 14 digits."""
    return df.where(cnpj_valid(name).isNotNull())
