"""Joins that add columns: by person id, company id, company name and bank code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.functions.ids import bank_code, cnpj_text, cnpj_valid, cpf
from roster.functions.text import column, company_key, fix_mojibake, is_blank, strip
from roster.operators.dedupe import dedup_first
from roster.operators.discover import find_key_column
from roster.operators.lists import on_keys, once_per_key
from roster.session import cut_lineage

Normaliser = Callable[[Column], Column]


def _join_with_suffixes(
    left: DataFrame, own: Column, right: DataFrame, how: str, right_columns: Sequence[str],
    null_safe: bool = False,
) -> DataFrame:
    """Join key ``own`` to ``_key0``; a name on both sides comes out as ``name_x`` and ``name_y``.

    ``right`` carries its columns as ``_r0``, ``_r1``, … in the order of ``right_columns``.
    """
    on = on_keys(1, null_safe)
    both = set(left.columns) & set(right_columns)
    return left.withColumn("_on0", own).join(right, on, how).select(
        *[column(c).alias(f"{c}_x" if c in both else c) for c in left.columns],
        *[
            F.col(f"_r{i}").alias(f"{c}_y" if c in both else c)
            for i, c in enumerate(right_columns)
        ],
    )


def _numbered(df: DataFrame, key: Column, columns: Sequence[str]) -> DataFrame:
    return df.select(key.alias("_key0"), *[column(c).alias(f"_r{i}") for i, c in enumerate(columns)])


def _id_or_null(c: Column) -> Column:
    return cpf(c, blank_is_null=True)


def mark_enriched(
    base: DataFrame,
    data: DataFrame,
    key: str,
    data_key: str,
    dedup_by: Sequence[Column | str] | None = None,
    normalise: Normaliser = _id_or_null,
    null_safe: bool = False,
    flag: str = "enriched",
) -> DataFrame:
    """All rows of ``base`` with the columns of ``data`` and the flag ``enriched``: does the id occur there? One join.

    A base row comes out once per data row of its id; a column name of both sides becomes ``name_x`` and ``name_y``.
    ``dedup_by`` first keeps only the first data row per id in that order. A missing or blank id matches nothing, as all rows
    without one would pair up; ``normalise=cpf`` takes blanks for eleven zeros, and ``null_safe`` lets missing ids match
    each other, as a join of two spreadsheets does: keep both for lists where these are few.
    """
    if dedup_by is not None:
        data = dedup_first(data, data_key, dedup_by, normalise)
    columns = [c for c in data.columns if c != data_key]
    extra = _numbered(data, normalise(column(data_key)), columns).withColumn(f"_r{len(columns)}", F.lit(True))
    joined = _join_with_suffixes(base, normalise(column(key)), extra, "left", [*columns, "_hit"], null_safe)
    return joined.withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def enriched_side(marked: DataFrame, base_columns: Sequence[str], has: bool, flag: str = "enriched") -> DataFrame:
    """The enriched rows of ``mark_enriched``, or the others with the columns they came with."""
    if has:
        return marked.where(flag).drop(flag)
    own = [column(c if c in marked.columns else f"{c}_x").alias(c) for c in base_columns]
    return marked.where(~F.col(flag)).select(*own)


def enrich_by_cpf(
    base: DataFrame,
    data: DataFrame,
    key: str,
    data_key: str,
    dedup_by: Sequence[Column | str] | None = None,
    normalise: Normaliser = _id_or_null,
    null_safe: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) rows of ``base``; see ``mark_enriched``, which jobs that need both take."""
    marked = mark_enriched(base, data, key, data_key, dedup_by, normalise, null_safe)
    return enriched_side(marked, base.columns, True), enriched_side(marked, base.columns, False)


def join_companies(
    ids: DataFrame, data: DataFrame, key: str = "CNPJ", data_key: str | None = None
) -> DataFrame:
    """Every valid id of the list with its company rows; ids without one get nulls."""
    data_key = data_key or find_key_column(data, ["cnpj", "cpf"])
    own = cnpj_valid(key)
    columns = data.columns
    companies = _numbered(data, cnpj_valid(data_key), columns).where(F.col("_key0").isNotNull())
    return _join_with_suffixes(ids.where(own.isNotNull()), own, companies, "left", columns)


def _ids_by_name(ref: DataFrame, name: str, cnpj: str, order_by: Column | str) -> DataFrame:
    """Distinct (company name, id) with the place of the first one."""
    return (
        ref.select(
            company_key(name).alias("_name"),
            cnpj_text(cnpj).alias("_id"),
            column(order_by).alias("_order"),
        )
        .where((F.col("_name") != "") & (F.col("_id") != ""))
        .groupBy("_name", "_id")
        .agg(F.min("_order").alias("_first"))
    )


def fill_cnpj_by_name(
    base: DataFrame,
    ref: DataFrame,
    name: str,
    ref_name: str,
    ref_cnpj: str,
    order_by: Column | str,
    target: str = "CNPJ",
) -> DataFrame:
    """Fill ``target`` with the ids of the company name, first seen first, joined by ``; ``.

    Rows without a match keep their value. The cell holds all ids of one name by definition; for
    names with very many ids use ``split_by_match_count``, which keeps one id per row.
    """
    found = F.array_sort(F.collect_list(F.struct("_first", "_id")))
    cells = once_per_key(
        _ids_by_name(ref, ref_name, ref_cnpj, order_by),
        ["_name"],
        F.concat_ws("; ", F.transform(found, lambda x: x["_id"])).alias("_cell"),
    )
    current = column(target) if target in base.columns else F.lit("")
    joined = base.withColumn("_own", company_key(name)).join(cells, F.col("_own") == F.col("_name"), "left")
    return joined.withColumn(target, F.coalesce("_cell", current)).drop("_own", "_name", "_cell")


ONE, SEVERAL, NONE = "one", "several", "none"


def tag_match_count(
    base: DataFrame,
    ref: DataFrame,
    name: str,
    ref_name: str,
    ref_cnpj: str,
    order_by: Column | str,
    target: str = "CNPJ",
    tag: str = "matches",
) -> DataFrame:
    """All rows of ``base`` with ids by company name in ``target`` and the tag ``one``, ``several`` or ``none``.

    Of several ids each has a row. Ids are joined row by row, so a name with very many ids never becomes one cell. A value
    that ``base`` already holds counts when the name has no match. ``base`` and ``ref`` are scanned once: the distinct
    (name, id) rows are kept in the checkpoint folder, and counted from there.
    """
    pairs = cut_lineage(_ids_by_name(ref, ref_name, ref_cnpj, order_by).select("_name", "_id"))
    per_name = once_per_key(pairs, ["_name"], F.count(F.lit(1)).alias("_ids"), F.min("_id").alias("_only"))
    if target not in base.columns:
        base = base.withColumn(target, F.lit(""))
    named = base.withColumn("_own", company_key(name))
    counted = named.join(per_name, F.col("_own") == F.col("_name"), "left")
    # a fresh key: rows of a frequent name are exchanged again, so that they can be split again
    counted = counted.withColumn("_many", F.when(F.col("_ids") > 1, F.concat("_name", F.lit(""))))
    listed = pairs.select(F.col("_name").alias("_pair_name"), F.col("_id").alias("_pair_id"))
    spread = counted.join(listed, F.col("_many") == F.col("_pair_name"), "left")
    # a row without a match keeps its own value, which may list several
    own = F.coalesce(column(target).cast("string"), F.lit(""))
    parts = F.filter(F.transform(F.split(own, ";"), strip), lambda x: x != "")
    cells = (
        F.when(F.col("_pair_id").isNotNull(), F.array("_pair_id")).when(F.col("_only").isNotNull(), F.array("_only"))
        .when(F.contains(own, F.lit(";")), parts).otherwise(F.array(column(target).cast("string")))
    )
    side = (
        F.when((F.col("_ids") > 1) | (F.col("_ids").isNull() & F.contains(own, F.lit(";"))), SEVERAL)
        .when(F.col("_ids").isNull() & is_blank(target), NONE).otherwise(ONE)
    )
    kept = [column(c) for c in base.columns if c != target]
    out = spread.select(*kept, side.alias(tag), F.explode(cells).alias(target))
    return out.select(*[column(c) for c in base.columns], tag)


def match_count_sides(tagged: DataFrame, tag: str = "matches") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one id, several ids with one row each, no id) of ``tag_match_count``."""
    return tuple(tagged.where(F.col(tag) == side).drop(tag) for side in (ONE, SEVERAL, NONE))


def split_by_match_count(
    base: DataFrame,
    ref: DataFrame,
    name: str,
    ref_name: str,
    ref_cnpj: str,
    order_by: Column | str,
    target: str = "CNPJ",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one id, several ids with one row each, no id); see ``tag_match_count``, which jobs that need all take."""
    return match_count_sides(tag_match_count(base, ref, name, ref_name, ref_cnpj, order_by, target))


def _last_per_code(banks: DataFrame, code: str, order_by: Column | str, **values: Column) -> DataFrame:
    """One row per bank code; the last row of a repeated code wins."""
    rows = banks.select(
        bank_code(code).alias("_code"),
        column(order_by).alias("_order"),
        *[v.alias(n) for n, v in values.items()],
    ).where(F.col("_code").isNotNull())
    best = F.max_by(F.struct(*values), F.col("_order"))
    return once_per_key(rows, ["_code"], best.alias("_best")).select("_code", "_best.*")


def bank_names(
    base: DataFrame, banks: DataFrame, code: str, bank_code_col: str, name: str, order_by: Column | str
) -> DataFrame:
    """Add ``nome_banco`` by bank code; null when the code is unknown."""
    names = _last_per_code(banks, bank_code_col, order_by, _bank=fix_mojibake(name))
    coded = base.withColumn("_own", bank_code(code))
    joined = coded.join(names, F.col("_own") == F.col("_code"), "left")
    return joined.withColumn("nome_banco", F.col("_bank")).drop("_own", "_code", "_bank")


# Source tags and columns of the bank tables.
PRIMARY_SOURCE, FALLBACK_SOURCE = "BRASIL_API", "CSV_LOCAL"
TABLE_CODE, TABLE_NAME, TABLE_FULL_NAME, TABLE_ISPB = "Código COMPE", "Banco", "Nome Completo", "ISPB"


def bank_names_layered(
    base: DataFrame,
    primary: DataFrame,
    fallback: DataFrame | None,
    code: str,
    order_by: Column | str,
    tag_source: bool = True,
) -> DataFrame:
    """Add bank name, full name, register number and source; the primary table goes first.

    The fallback table has no full name and no register number: its name serves for both names.
    Columns are those of the two bank tables. ``fallback=None`` with ``tag_source=False`` is the
    form that knows one source only.
    """
    own = F.col("_own")
    first = _last_per_code(
        primary, TABLE_CODE, order_by,
        _name1=fix_mojibake(TABLE_NAME), _full1=fix_mojibake(TABLE_FULL_NAME),
        _ispb1=column(TABLE_ISPB).cast("string"),
    ).withColumnRenamed("_code", "_code1")
    coded = base.withColumn("_own", bank_code(code))
    joined = coded.join(first, own == F.col("_code1"), "left")
    name, full = F.col("_name1"), F.col("_full1")
    source = F.when(F.col("_code1").isNotNull(), PRIMARY_SOURCE)
    helpers = ["_own", "_code1", "_name1", "_full1", "_ispb1"]
    if fallback is not None:
        second = _last_per_code(
            fallback, TABLE_CODE, order_by, _name2=fix_mojibake(TABLE_NAME)
        ).withColumnRenamed("_code", "_code2")
        joined = joined.join(second, own == F.col("_code2"), "left")
        use_second = F.col("_code1").isNull()
        name = F.when(use_second, F.col("_name2")).otherwise(name)
        full = F.when(use_second, F.col("_name2")).otherwise(full)
        source = source.when(F.col("_code2").isNotNull(), FALLBACK_SOURCE)
        helpers += ["_code2", "_name2"]
    added = {
        "nome_banco": F.coalesce(name, F.lit("")),
        "nome_completo_banco": F.coalesce(full, F.lit("")),
        "ispb": F.coalesce(F.col("_ispb1"), F.lit("")),
    }
    if tag_source:
        added["fonte_informacao"] = F.coalesce(source, F.lit(""))
    return joined.withColumns(added).drop(*helpers)
