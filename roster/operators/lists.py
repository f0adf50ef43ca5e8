"""Deny lists and allow lists.

Lists are reduced to distinct keys and joined; Spark broadcasts a list whose measured size is under
its threshold and sorts and merges otherwise, splitting hot key partitions (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.functions.ids import cnpj14, cpf, cpf_strict, phone
from roster.functions.text import column, strip

Normaliser = Callable[[Column], Column]


def once_per_key(df: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    """One row per key, ready to be joined by that key.

    The keys are grouped as a struct. Their own columns are then new to Spark, which exchanges the
    small result again for the join. Adaptive execution splits hot partitions only where both sides
    of a join come straight from such an exchange; without it the hot keys of the other side would
    stay in one task.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_group"))
    rows = grouped.agg(*values) if values else df.select(F.struct(*keys).alias("_group")).distinct()
    return rows.select("_group.*", *[c for c in rows.columns if c != "_group"])


def _distinct_keys(members: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Each key once, so that a key repeated many times in a list is one row in the join."""
    names = [f"_key{i}" for i in range(len(keys))]
    return once_per_key(members.select(*[k.alias(n) for k, n in zip(keys, names)]), names)


def with_keys(base: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Add the keys as columns ``_on0``, …: a join on columns computes each key once per row, a
    join on expressions computes it again for the exchange and for every comparison of the sort."""
    return base.withColumns({f"_on{i}": k for i, k in enumerate(keys)})


def on_keys(count: int, null_safe: bool) -> Column:
    pairs = [
        F.col(f"_on{i}").eqNullSafe(F.col(f"_key{i}")) if null_safe else F.col(f"_on{i}") == F.col(f"_key{i}")
        for i in range(count)
    ]
    return reduce(lambda a, b: a & b, pairs)


def mark_listed(
    base: DataFrame,
    keys: Sequence[Column],
    members: DataFrame,
    member_keys: Sequence[Column],
    flag: str = "listed",
    null_safe: bool = False,
) -> DataFrame:
    """Add a boolean column: does the row's key occur in ``members``? One join, no row lost."""
    listed = _distinct_keys(members, member_keys).withColumn("_hit", F.lit(True))
    joined = with_keys(base, keys).join(listed, on_keys(len(keys), null_safe), "left")
    return joined.select(*[column(c) for c in base.columns], F.col("_hit").isNotNull().alias(flag))


def _filter_listed(base, keys, members, member_keys, null_safe, how) -> DataFrame:
    listed = _distinct_keys(members, member_keys)
    kept = with_keys(base, keys).join(listed, on_keys(len(keys), null_safe), how)
    return kept.drop(*[f"_on{i}" for i in range(len(keys))])


def keep_listed(
    base: DataFrame, keys: Sequence[Column], members: DataFrame, member_keys: Sequence[Column],
    null_safe: bool = False,
) -> DataFrame:
    """Rows whose key occurs in ``members``."""
    return _filter_listed(base, keys, members, member_keys, null_safe, "left_semi")


def drop_listed(
    base: DataFrame, keys: Sequence[Column], members: DataFrame, member_keys: Sequence[Column],
    null_safe: bool = False,
) -> DataFrame:
    """Rows whose key does not occur in ``members``."""
    return _filter_listed(base, keys, members, member_keys, null_safe, "left_anti")


def mark_denied(
    base: DataFrame, deny: DataFrame, key: str, deny_key: str, normalise: Normaliser = cpf, null_safe: bool = True
) -> DataFrame:
    """All rows with the flag ``denied``. A missing id matches a missing id unless ``null_safe`` is off."""
    return mark_listed(base, [normalise(column(key))], deny, [normalise(column(deny_key))], "denied", null_safe)


def _sides(marked: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows without the flag, rows with it."""
    return marked.where(~F.col(flag)).drop(flag), marked.where(flag).drop(flag)


def split_by_denylist(
    base: DataFrame, deny: DataFrame, key: str, deny_key: str, normalise: Normaliser = cpf, null_safe: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(kept, denied) rows of ``base``. Jobs that need both take ``mark_denied``: one pass, one join."""
    return _sides(mark_denied(base, deny, key, deny_key, normalise, null_safe), "denied")


def trimmed(c: Column) -> Column:
    return strip(c)


def trimmed_or_nan(c: Column) -> Column:
    """Stripped text, with a missing value as the text ``nan``."""
    return F.coalesce(strip(c), F.lit("nan"))


def folder_keys(tables: Sequence[DataFrame]) -> DataFrame:
    """Column ``CPF`` of the tables of a deny folder: each table's ``CPF``, or else its ``identifier``.

    Tables with neither are left out; it is an error if none has one.
    """
    found = []
    for table in tables:
        name = next((c for c in ("CPF", "identifier") if c in table.columns), None)
        if name is not None:
            found.append(table.select(column(name).cast("string").alias("CPF")))
    if not found:
        raise ValueError("no deny list has a CPF or an identifier column")
    return reduce(DataFrame.unionAll, found)


def mark_denied_folder(data: DataFrame, deny: Sequence[DataFrame], key: str = "CPF") -> DataFrame:
    """Folder form: column ``CPF`` compared as stripped text with the keys of the deny tables."""
    return mark_denied(data, folder_keys(deny), key, "CPF", trimmed, null_safe=False)


def split_by_denylist_folder(
    data: DataFrame, deny: DataFrame | Sequence[DataFrame], key: str = "CPF"
) -> tuple[DataFrame, DataFrame]:
    """(kept, denied) rows, folder form."""
    return _sides(mark_denied_folder(data, [deny] if isinstance(deny, DataFrame) else deny, key), "denied")


def remove_by_cnpj(base: DataFrame, deny: DataFrame, key: str, deny_key: str) -> DataFrame:
    """Drop rows whose company id is listed; blank ids stay."""
    listed = deny.where(cnpj14(column(deny_key)) != "")
    return drop_listed(base, [cnpj14(column(key))], listed, [cnpj14(column(deny_key))])


def remove_by_phone(base: DataFrame, deny: DataFrame, key: str, deny_key: str) -> DataFrame:
    """Drop rows whose phone digits are listed; missing phones stay."""
    return drop_listed(base, [phone(column(key))], deny, [phone(column(deny_key))])


def mark_denied_numbers(base: DataFrame, deny: DataFrame, key: str, deny_key: str) -> DataFrame:
    """Flag rows whose number, as stripped text, is listed (column ``denied``)."""
    return mark_listed(
        base, [trimmed_or_nan(column(key))], deny, [trimmed_or_nan(column(deny_key))], "denied"
    )


def remove_by_number_batch(base: DataFrame, deny: DataFrame, key: str, deny_key: str) -> DataFrame:
    """Drop rows whose number, as stripped text, is listed."""
    return drop_listed(
        base, [trimmed_or_nan(column(key))], deny, [trimmed_or_nan(column(deny_key))]
    )


def denied_numbers_report(
    base: DataFrame, deny: DataFrame, key: str, deny_key: str, source: str = "source_file"
) -> DataFrame:
    """Figures of the rows ``remove_by_number_batch`` drops; see ``number_figures``."""
    return number_figures(mark_denied_numbers(base, deny, key, deny_key), key, source)


def number_figures(marked: DataFrame, key: str, source: str = "source_file") -> DataFrame:
    """Per source of ``mark_denied_numbers``: rows, rows removed, distinct numbers removed, rate in percent.

    Counted per (source, number) first, so a large source or a hot number is summed up before
    the exchange.
    """
    per_number = marked.groupBy(source, trimmed_or_nan(column(key)).alias("_number")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("denied").alias("_denied")
    )
    rows, removed = F.sum("_rows"), F.sum("_denied")
    return per_number.groupBy(source).agg(
        rows.alias("rows_in"),
        (rows - removed).alias("rows_kept"),
        removed.alias("rows_removed"),
        F.count_if(F.col("_denied") > 0).alias("numbers_removed"),
        F.try_divide(removed * 100.0, rows).alias("rate"),
    )


def mark_denied_pairs(
    base: DataFrame, deny: DataFrame, cpf_col: str, number: str, deny_cpf: str, deny_number: str
) -> DataFrame:
    """Flag rows whose (person id, number) is listed (column ``denied``)."""
    own = [cpf(column(cpf_col)), column(number)]
    listed = [cpf(column(deny_cpf)), column(deny_number)]
    return mark_listed(base, own, deny, listed, "denied")


def mask_denied_numbers(
    base: DataFrame, deny: DataFrame, cpf_col: str, number: str, deny_cpf: str, deny_number: str
) -> DataFrame:
    """Replace a number by ``-`` where (person id, number) is listed; every row stays."""
    return mask_marked(mark_denied_pairs(base, deny, cpf_col, number, deny_cpf, deny_number), number)


def mask_marked(marked: DataFrame, number: str) -> DataFrame:
    """Replace the numbers of flagged rows; see ``mask_denied_numbers``."""
    masked = F.when(F.col("denied"), "-").otherwise(column(number).cast("string"))
    return marked.withColumn(number, masked).drop("denied")


def mark_allowed(
    data: DataFrame, allow: DataFrame, key: str, allow_key: str, normalise: Normaliser = cpf_strict
) -> DataFrame:
    """All rows with the flag ``allowed``; a blank id is never listed."""
    listed = allow.where(normalise(column(allow_key)) != "")
    return mark_listed(data, [normalise(column(key))], listed, [normalise(column(allow_key))], "allowed")


def split_by_allowlist(
    data: DataFrame, allow: DataFrame, key: str, allow_key: str, normalise: Normaliser = cpf_strict
) -> tuple[DataFrame, DataFrame]:
    """(listed, not listed) rows of ``data``. Jobs that need both take ``mark_allowed``."""
    absent, listed = _sides(mark_allowed(data, allow, key, allow_key, normalise), "allowed")
    return listed, absent


def removed_keys(before: DataFrame, after: DataFrame, key: str, normalise: Normaliser = cpf) -> DataFrame:
    """Distinct keys that are in ``before`` and no longer in ``after``."""
    keys = before.select(normalise(column(key)).alias("key")).distinct()
    return drop_listed(keys, [F.col("key")], after, [normalise(column(key))])


def union_keys(lists: Sequence[DataFrame], key: str, normalise: Normaliser = cpf_strict) -> DataFrame:
    """Distinct non-blank keys of several lists."""
    parts = [d.select(normalise(column(key)).alias("key")) for d in lists]
    return reduce(DataFrame.unionByName, parts).where(F.col("key") != "").distinct()
