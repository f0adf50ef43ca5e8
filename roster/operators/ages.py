"""Age columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from roster.functions.dates import age, age_checked, date_br
from roster.operators.discover import find_birth_column


def add_age(df: DataFrame, birth: str, as_of: dt.date | str | None = None, name: str = "idade") -> DataFrame:
    """Add the age without a range check."""
    return df.withColumn(name, age(birth, as_of))


def add_age_checked(
    df: DataFrame, birth: str, as_of: dt.date | str | None = None, name: str = "idade"
) -> DataFrame:
    """Add the age, null outside 0 to 150."""
    return df.withColumn(name, age_checked(birth, as_of))


def refresh_age(
    df: DataFrame, birth: str | None = None, as_of: dt.date | str | None = None
) -> DataFrame:
    """Recompute the age column from the birth-date column (found by name unless given)."""
    birth = birth or find_birth_column(df.columns)
    if birth is None:
        raise ValueError("no birth-date column found; name it")
    name = next((c for c in df.columns if c.strip().lower() == "idade"), "IDADE")
    return df.withColumn(name, age_checked(birth, as_of))


def format_date_column(df: DataFrame, name: str, dayfirst: bool = True) -> DataFrame:
    return df.withColumn(name, date_br(name, dayfirst))
