"""Figures over lists: prices, dates, totals, ages, coverage and per-source statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.functions.ids import bank_code
from roster.functions.numbers import SUSPICIOUS, amount_text, capped, over_limit, parse_decimal, rounded, stripped_number
from roster.functions.text import column, strip, text
from roster.operators.calls import exact
from roster.operators.discover import find_total_columns


def price_report(df: DataFrame, price: str, ts: str) -> DataFrame:
    """Rows, rows with a price, rows above zero, price total, time range, rows without a time."""
    amount = parse_decimal(price)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(amount).alias("priced"),
        F.count_if(amount > 0).alias("positive"),
        F.sum(exact(amount)).cast("double").alias("total"),
        F.min(column(ts)).alias("first_ts"),
        F.max(column(ts)).alias("last_ts"),
        F.count_if(column(ts).isNull()).alias("bad_ts"),
    )


def date_span(df: DataFrame, ts: str) -> DataFrame:
    """First and last day, and first and last moment within the last day.

    Grouped by day first, so one scan with a small exchange does it; the last day is the largest
    group key.
    """
    days = (
        df.where(column(ts).isNotNull())
        .groupBy(column(ts).cast("date").alias("_day"))
        .agg(F.min(column(ts)).alias("_low"), F.max(column(ts)).alias("_high"))
    )
    return days.agg(
        F.min("_day").alias("first_day"),
        F.max("_day").alias("last_day"),
        F.max_by("_low", "_day").alias("last_day_first_ts"),
        F.max_by("_high", "_day").alias("last_day_last_ts"),
        F.min("_low").alias("first_ts"),
        F.max("_high").alias("last_ts"),
    )


def _read_amounts(df: DataFrame, parts: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """Rows with the number of each part, null if unreadable, and the names of these columns by part.

    Texts are cleaned in one projection and read in the next: each step refers to the one before
    several times, and as a column it is computed once.
    """
    names = {p: i for i, p in enumerate(dict.fromkeys(parts))}
    texts, amounts = {p: f"_part_text{i}" for p, i in names.items()}, {p: f"_part{i}" for p, i in names.items()}
    cleaned = df.withColumns({x: amount_text(p) for p, x in texts.items()})
    return cleaned.withColumns({n: stripped_number(texts[p]) for p, n in amounts.items()}).drop(*texts.values()), amounts


def row_total(amounts: Iterable[Column | str], limit: float | None = SUSPICIOUS) -> Column:
    """Sum of the amounts of a row; those that are null or above ``limit`` count 0."""
    total = F.lit(0.0)
    for amount in amounts:
        total = total + capped(amount, limit)
    return total


def _present(df: DataFrame, totals: Mapping[str, Sequence[str]] | None) -> dict[str, list[str]]:
    totals = find_total_columns(df.columns) if totals is None else totals
    return {t: [p for p in parts if p in df.columns] for t, parts in totals.items() if t in df.columns}


def zeroed_amounts(
    df: DataFrame, totals: Mapping[str, Sequence[str]] | None = None, limit: float | None = SUSPICIOUS
) -> DataFrame:
    """Per total column: rows, parts that count 0 for their size, and totals that become 0 for theirs."""
    present = _present(df, totals)
    if not present:
        raise ValueError("no total column")
    read, amounts = _read_amounts(df, sum(present.values(), []))
    figures = [F.count(F.lit(1)).alias("_rows")]
    for i, parts in enumerate(present.values()):
        over = sum((over_limit(amounts[p], limit).cast("int") for p in parts), F.lit(0))
        large = F.lit(False) if limit is None else F.abs(row_total([amounts[p] for p in parts], limit)) > limit
        figures += [F.coalesce(F.sum(over), F.lit(0)).alias(f"_p{i}"), F.count_if(large).alias(f"_t{i}")]
    rows = [
        F.struct(F.lit(name).alias("column"), F.col("_rows").alias("rows"), F.col(f"_p{i}").alias("zeroed_parts"), F.col(f"_t{i}").alias("zeroed_totals"))
        for i, name in enumerate(present)
    ]
    return read.agg(*figures).select(F.inline(F.array(*rows)))  # one scan for all totals


def recompute_totals(
    df: DataFrame, totals: Mapping[str, Sequence[str]] | None = None, limit: float | None = SUSPICIOUS
) -> DataFrame:
    """Replace each total column that exists by the sum of its parts, two places.

    A part or total above ``limit`` counts as a reading error and becomes 0; ``zeroed_amounts`` says
    how many do, and ``limit=None`` keeps them all.
    Without ``totals`` the used and balance totals and their parts are found by name.
    """
    present = _present(df, totals)
    if not present:
        return df
    read, amounts = _read_amounts(df, sum(present.values(), []))
    sums = {t: f"_t{i}" for i, t in enumerate(present)}
    summed = read.withColumns({sums[t]: row_total([amounts[p] for p in parts], limit) for t, parts in present.items()})
    if limit is not None:
        summed = summed.withColumns({s: F.when(F.abs(F.col(s)) <= limit, F.col(s)).otherwise(0.0) for s in sums.values()})
    shown = summed.withColumns({t: rounded(F.col(s), 2) for t, s in sums.items()})
    return shown.drop(*sums.values(), *amounts.values())


def conversion_check(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column: values that are neither blank nor ``0`` but read as 0."""
    read, amounts = _read_amounts(df, names)

    def failed(name: str) -> Column:
        value = F.coalesce(strip(name), F.lit(""))
        return F.count_if((capped(amounts[name]) == 0) & ~value.isin("", "0"))

    counts = read.agg(
        F.count(F.lit(1)).alias("_rows"), *[failed(c).alias(f"_n{i}") for i, c in enumerate(names)]
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("errors"))
        for i, c in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def batch_stats(marked: DataFrame, removed: Column | str, source: str = "source_file") -> DataFrame:
    """Per source: rows in, kept, removed and rate in percent, from one flagged table."""
    gone = F.count_if(column(removed))
    rows = F.count(F.lit(1))
    return marked.groupBy(source).agg(
        rows.alias("rows_in"),
        (rows - gone).alias("rows_kept"),
        gone.alias("rows_removed"),
        F.try_divide(gone * 100.0, rows).alias("rate"),
    )


def batch_totals(stats: DataFrame) -> DataFrame:
    """Grand totals of ``batch_stats`` (empty sources count as errors)."""
    rows, removed = F.sum("rows_in"), F.sum("rows_removed")
    return stats.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("rows_in") > 0).alias("processed"),
        F.count_if(F.col("rows_in") == 0).alias("failed"),
        rows.alias("rows_in"),
        F.sum("rows_kept").alias("rows_kept"),
        removed.alias("rows_removed"),
        F.try_divide(removed * 100.0, rows).alias("rate"),
    )


def top_sources(
    stats: DataFrame, n: int = 10, by: str = "rate", source: str = "source_file", worst: bool = False
) -> DataFrame:
    """The ``n`` sources with the highest (or lowest) rate."""
    rate = column(by)
    return stats.orderBy(rate.asc() if worst else rate.desc(), source).limit(n)


def age_stats(df: DataFrame, name: str) -> DataFrame:
    value = column(name)
    return df.agg(
        F.min(value).alias("youngest"),
        F.max(value).alias("oldest"),
        F.avg(value).alias("mean"),
        F.count(value).alias("valid"),
        F.count_if(value.isNull()).alias("invalid"),
    )


def lookup_coverage(df: DataFrame, code: str) -> DataFrame:
    """After a layered bank lookup: rows with and without a name, rows and codes per source.

    Grouped by code first, so distinct codes are counted from a small table.
    """
    per_code = df.groupBy(bank_code(code).alias("_code"), "fonte_informacao").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.length("nome_banco") > 0).alias("_named"),
    )
    return per_code.groupBy("fonte_informacao").agg(
        F.sum("_rows").alias("rows"),
        F.sum("_named").alias("rows_with_name"),
        (F.sum("_rows") - F.sum("_named")).alias("rows_without_name"),
        F.count("_code").alias("codes"),
    )


def codes_without_name(df: DataFrame, code: str) -> DataFrame:
    """Bank codes (column ``key``) none of whose rows got a name in a lookup, from one pass over the rows."""
    per_code = df.groupBy(bank_code(code).alias("key")).agg(F.bool_or(F.length("nome_banco") > 0).alias("_named"))
    return per_code.where(F.col("key").isNotNull() & ~F.coalesce("_named", F.lit(False))).select("key")


def format_counts(df: DataFrame, name: str) -> DataFrame:
    """Filled and blank values after formatting a column."""
    filled = F.coalesce(text(name), F.lit("")) != ""
    return df.agg(F.count_if(filled).alias("filled"), F.count_if(~filled).alias("blank"))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per non-null value (an empty text is a value)."""
    return (
        df.where(column(name).isNotNull())
        .groupBy(column(name).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
