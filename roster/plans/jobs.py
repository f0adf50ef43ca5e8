"""One job per list operation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roster import functions as R
from roster.operators import (
    ages, calls, clean, dedupe, discover, enrich, lists, order, reports, shape,
)
from roster.sources import readers, writers
from roster.session import cut_lineage
from roster.sources.readers import ORDER, SOURCE

Step = Callable[[DataFrame], DataFrame]

# fixed values: prefixes of the outputs' names
NO_DUPLICATES, LARGEST, NUMBERS_GONE, FILTERED, NAMED = (
    "sem_duplicados_", "maior_valor_", "blacklist_lote_", "filtrado_", "com_nomes_",
)
KEPT, DENIED, ABSENT, LISTED, WITH_DATA, WITHOUT_DATA = "whitelist_", "blacklist_", "deny_", "allow_", "com_", "sem_"


def _fitting(folder: readers.Folder, needed: Sequence[str]) -> list[DataFrame]:
    """The tables of a folder that have the columns."""
    return [t for t in readers.tables(folder) if set(needed) <= set(t.columns)]


def _per_layout(
    spark: SparkSession, path: str, out: str, prefix: str, step: Step, needed: Sequence[str] = (), clean: bool = True
) -> DataFrame:
    """Apply ``step`` to each table of a folder and write one output folder per input file, all in one job.

    Files without the ``needed`` columns, and those ``step`` finds no column in (a ``ValueError``), are left out; the
    report returned says of every file what the reader found.
    """
    folder = readers.probe(spark, path)
    done, lacking = [], []
    for table in _fitting(folder, needed):
        try:
            done.append(step(table))
        except ValueError:
            lacking.append(table)
    writers.write_per_source(done, out, prefix, clean)
    return _report(folder, needed, lacking)


def _report(folder: readers.Folder, needed: Sequence[str], lacking: Sequence[DataFrame]) -> DataFrame:
    """The folder's quality report, with the files of the tables ``lacking`` a column that had to be found."""
    report = readers.quality_report(folder.spark, folder, needed)
    if not lacking:
        return report
    shapes = [F.col("columns") == F.array(*[F.lit(c) for c in t.columns if c not in (SOURCE, ORDER)]) for t in lacking]
    found = reduce(lambda a, b: a | b, shapes) & (F.col("status") == "ok")
    return report.withColumn("status", F.when(found, "no fitting column").otherwise(F.col("status")))


def _write_two(first: DataFrame, second: DataFrame, out: str, names: tuple[str, str]) -> None:
    for rows, name in ((first, names[0]), (second, names[1])):
        writers.write_list(rows, f"{out}/{name}")


def _column(table: DataFrame, name: str | None, find: Callable[[DataFrame], str | None]) -> str:
    chosen = name or find(table)
    if chosen is None:
        raise ValueError("no fitting column found; name it")
    return chosen


# removal

def remove_duplicates(spark: SparkSession, path: str, key: str, out: str) -> DataFrame:
    """First row per person id of one list or a whole folder taken as one list."""
    rows = readers.read_lists(spark, path)
    writers.write_list(dedupe.dedup_first(rows, key, [ORDER]), out)
    return dedupe.dedup_stats(rows, key)


def remove_duplicates_per_file(spark: SparkSession, path: str, key: str, out: str) -> DataFrame:
    """First row per person id inside each file; files without the column are in the report."""
    folder = readers.probe(spark, path)
    tables = _fitting(folder, [key])
    writers.write_per_source([dedupe.dedup_first(t, key, [ORDER], within=[SOURCE]) for t in tables], out, NO_DUPLICATES)
    report = readers.quality_report(spark, folder, [key])
    if not tables:
        return report
    stats = reduce(DataFrame.unionByName, [dedupe.dedup_stats(t, key, within=[SOURCE]) for t in tables])
    return report.join(stats, SOURCE, "left")


def keep_largest_per_file(spark: SparkSession, path: str, key: str, value: str, out: str) -> DataFrame:
    """Per file and person id the row with the largest value; files without a column are only in the report."""
    return _per_layout(
        spark, path, out, LARGEST, lambda t: dedupe.dedup_max(t, key, value, [ORDER], within=[SOURCE]), [key, value]
    )


def remove_denied(
    spark: SparkSession, path: str, deny_path: str, key: str, deny_key: str, out: str
) -> None:
    """Kept and denied rows by person id, written as two lists."""
    base, deny = readers.read_lists(spark, path), readers.read_lists(spark, deny_path)
    writers.write_flagged(lists.mark_denied(base, deny, key, deny_key), "denied", out, ("whitelist", "blacklist"))


def _flag_per_file(
    spark: SparkSession, path: str, needed: str, out: str, flag: str, prefixes: tuple[str, str], step: Step
) -> DataFrame:
    """Flag the rows of every file and write both sides in one job; files without the column are only reported.

    Returns, per file, what the reader says of it and the rows of both sides, counted from what was written.
    """
    folder = readers.probe(spark, path)
    marked = [step(t) for t in _fitting(folder, [needed])]
    report = readers.quality_report(spark, folder, [needed])
    if not marked:
        return report
    # flagged once: the write and the figures read the same rows
    flagged = [cut_lineage(t) for t in marked]
    writers.write_flagged_per_source(flagged, flag, out, prefixes)
    figures = [
        t.groupBy(SOURCE).agg(F.count_if(~F.col(flag)).alias("rows_out"), F.count_if(flag).alias("rows_flagged")) for t in flagged
    ]
    return report.join(reduce(DataFrame.unionByName, figures), SOURCE, "left")


def remove_denied_folder(spark: SparkSession, path: str, deny_path: str, out: str) -> DataFrame:
    """Kept and denied rows of every file, by the column ``CPF``; figures per file."""
    deny = readers.read_sources(spark, deny_path)
    return _flag_per_file(
        spark, path, "CPF", out, "denied", (KEPT, DENIED), lambda t: lists.mark_denied_folder(t, deny)
    )


def remove_denied_phones(
    spark: SparkSession, path: str, deny_path: str, key: str, deny_key: str, out: str
) -> None:
    base, deny = readers.read_lists(spark, path), readers.read_lists(spark, deny_path)
    writers.write_list(lists.remove_by_phone(base, deny, key, deny_key), out)


def remove_denied_companies(
    spark: SparkSession, path: str, deny_path: str, key: str, deny_key: str, out: str
) -> None:
    base, deny = readers.read_lists(spark, path), readers.read_lists(spark, deny_path)
    writers.write_list(lists.remove_by_cnpj(base, deny, key, deny_key), out)


def remove_denied_numbers_per_file(
    spark: SparkSession, path: str, deny_path: str, deny_key: str, out: str, key: str | None = None
) -> DataFrame:
    """Drop listed numbers in every file; the number column is found unless named.

    Returns each file's figures and, for files without such a column, the status that says so. Rows and figures come from
    one join.
    """
    deny = readers.read_lists(spark, deny_path)
    folder = readers.probe(spark, path)
    marked, figures, lacking = [], [], []
    for table in readers.tables(folder):
        name = key if key in table.columns else None if key else discover.find_phone_column(table.drop(SOURCE, ORDER))
        if name is None:
            lacking.append(table)
            continue
        rows = cut_lineage(lists.mark_denied_numbers(table, deny, name, deny_key))
        marked.append(rows.where("NOT denied").drop("denied"))
        figures.append(lists.number_figures(rows, name))
    report = _report(folder, [key] if key else [], lacking)
    if not marked:
        return report
    writers.write_per_source(marked, out, NUMBERS_GONE)
    return report.join(reduce(DataFrame.unionByName, figures), SOURCE, "left")


def mask_denied_numbers(
    spark: SparkSession, path: str, deny_path: str, cpf_col: str, number: str, deny_cpf: str,
    deny_number: str, out: str,
) -> DataFrame:
    """Replace listed numbers by a dash; returns how many were replaced."""
    base, deny = readers.read_lists(spark, path), readers.read_lists(spark, deny_path)
    marked = cut_lineage(lists.mark_denied_pairs(base, deny, cpf_col, number, deny_cpf, deny_number))
    writers.write_list(lists.mask_marked(marked, number), out)
    return marked.agg(F.count_if("denied").alias("replaced"))


# filters

def split_in_parts(spark: SparkSession, path: str, rows_per_part: int, out: str) -> None:
    writers.write_parts(readers.read_lists(spark, path), rows_per_part, None, out)


def split_by_allowlist(
    spark: SparkSession, path: str, allow_path: str, key: str, allow_key: str, out: str
) -> DataFrame:
    """Listed and absent rows of every file, with figures; a single file is a folder of one."""
    allow = readers.read_lists(spark, allow_path)
    return _flag_per_file(
        spark, path, key, out, "allowed", (ABSENT, LISTED), lambda t: lists.mark_allowed(t, allow, key, allow_key)
    )


def split_by_value(spark: SparkSession, path: str, name: str, out: str) -> DataFrame:
    rows = readers.read_lists(spark, path)
    writers.write_by_value(rows, name, out)
    return reports.value_counts(rows, name)


def drop_empty_or_zero(spark: SparkSession, path: str, out: str, name: str | None = None) -> DataFrame:
    """Drop rows without a value, file by file; a table with one column needs no name.

    Returns the figures of every file with the column, from the one pass that marks its rows.
    """
    folder = readers.probe(spark, path)
    marked = []
    for table in readers.tables(folder):
        own = [c for c in table.columns if c not in (SOURCE, ORDER)]
        chosen = name or (own[0] if len(own) == 1 else None)
        if chosen in own:  # the other files are listed by quality_report
            marked.append(cut_lineage(table.withColumn("_gone", ~F.coalesce(clean.nonzero(table, chosen), F.lit(False)))))
    if not marked:
        raise ValueError(f"no file under {path} has the column")
    writers.write_per_source([t.where("NOT _gone").drop("_gone") for t in marked], out, FILTERED)
    return reduce(DataFrame.unionByName, [reports.batch_stats(t, "_gone") for t in marked])


def write_batch_report(stats: DataFrame, out: str, best: int = 10) -> DataFrame:
    """Write per-file figures and return the files with the highest rate."""
    writers.write_report(stats, out)
    return reports.top_sources(stats, best)


def add_age(spark: SparkSession, path: str, birth: str, out: str, as_of: dt.date | None = None) -> DataFrame:
    aged = ages.add_age(readers.read_lists(spark, path), birth, as_of)
    writers.write_list(aged, out)
    return reports.age_stats(aged, "idade")


def add_age_checked(
    spark: SparkSession, path: str, birth: str, out: str, as_of: dt.date | None = None
) -> DataFrame:
    aged = ages.add_age_checked(readers.read_lists(spark, path), birth, as_of)
    writers.write_list(aged, out)
    return reports.age_stats(aged, "idade")


def refresh_age(
    spark: SparkSession, path: str, out: str, birth: str | None = None, as_of: dt.date | None = None
) -> None:
    writers.write_list(ages.refresh_age(readers.read_lists(spark, path), birth, as_of), out)


def format_column(
    spark: SparkSession, path: str, name: str, out: str, form: Callable[[str], Column]
) -> DataFrame:
    """Rewrite one column by a column function (``R.date_br``, ``R.cpf_strict``, ``R.cnpj_mask``,
    ``R.price3``, …); returns filled and blank values."""
    formatted = readers.read_lists(spark, path).withColumn(name, form(name))
    writers.write_list(formatted, out, clean=False)
    return reports.format_counts(formatted, name)


def export_voip_prices(
    spark: SparkSession, path: str, price: str, ts: str, out: str,
    first: dt.date | None = None, last: dt.date | None = None, dayfirst: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Rows of a date range with three-place prices; returns the price figures and the date span."""
    rows = readers.read_lists(spark, path).withColumn("_ts", R.parse_ts(ts, dayfirst))
    if first is not None and last is not None:
        rows = clean.filter_date_range(rows, "_ts", first, last)
    shown = rows.withColumn(price, R.price3(price)).drop("_ts")
    writers.write_list(shown, out, clean=False)
    return reports.price_report(rows, price, "_ts"), reports.date_span(rows, "_ts")


def conform_layout(spark: SparkSession, path: str, out: str) -> None:
    writers.write_list(shape.conform_layout(readers.read_lists(spark, path)), out)


def keep_columns_alpha(spark: SparkSession, path: str, names: Sequence[str], out: str) -> None:
    """Chosen columns as A, B, C, …, by the columns each file has."""
    def step(table: DataFrame) -> DataFrame:
        kept = [c for c in table.columns if c in set(names)]
        if not kept:
            raise ValueError("none of the columns")
        return table.select(SOURCE, ORDER, *[R.column(c).alias(shape.alpha_name(i)) for i, c in enumerate(kept)])

    _per_layout(spark, path, out, "", step, clean=False)


def identifiers_to_cpf(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Only the identifiers of every file, as ``CPF``; returns the status of each file."""
    return _per_layout(
        spark, path, out, "", lambda t: t.select(SOURCE, ORDER, F.col("identifier").alias("CPF")), ["identifier"]
    )


# additions

def enrich_by_cpf(
    spark: SparkSession, path: str, data_path: str, key: str, data_key: str, out: str
) -> None:
    base = readers.read_lists(spark, path, with_order=False).drop(SOURCE)
    data = readers.read_lists(spark, data_path, with_order=False).drop(SOURCE)
    marked = cut_lineage(enrich.mark_enriched(base, data, key, data_key))
    _write_two(*[enrich.enriched_side(marked, base.columns, has) for has in (True, False)], out, ("com", "sem"))


def enrich_folder_by_cpf(
    spark: SparkSession, path: str, data_path: str, key: str, data_key: str, out: str
) -> DataFrame:
    """Every file with the first data row of each id; matched and unmatched rows apart, from one join and one write.

    Files without the column are only in the report, which is returned.
    """
    data = readers.read_lists(spark, data_path).drop(SOURCE)
    first = dedupe.dedup_first(data, data_key, [ORDER]).drop(ORDER)
    folder = readers.probe(spark, path)
    done = []
    for table in _fitting(folder, [key]):
        marked = cut_lineage(enrich.mark_enriched(table, first, key, data_key))
        for side, has in ((WITH_DATA, True), (WITHOUT_DATA, False)):
            rows = shape.strip_quotes_all(enrich.enriched_side(marked, table.columns, has))
            done.append(rows.withColumn("side", F.lit(side)).withColumn(SOURCE, writers.output_name(F.col(SOURCE), F.lit(side))))
    writers.write_sources(done, out, ["side", SOURCE])
    return readers.quality_report(spark, folder, [key])


def merge_folder(spark: SparkSession, path: str, out: str, skip_first_line: bool = False) -> None:
    writers.write_list(readers.merge_folder(spark, path, skip_first_line=skip_first_line), out, clean=False)


def add_constant(spark: SparkSession, path: str, name: str, value: str, out: str) -> None:
    _per_layout(spark, path, out, "", lambda t: shape.add_constant(t, name, value))


def match_calls(
    spark: SparkSession, voip_path: str, dialer_path: str, out: str, voip_phone: str, voip_ts: str,
    price: str, voip_seconds: str, dialer_phone: str, dialer_ts: str, dialer_seconds: str,
    tolerance_seconds: int = calls.TOLERANCE_SECONDS, dialer_skip_first_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Merged calls and dialler calls without a VoIP record, as two lists; returns both reports."""
    def numbered(path: str, skip: bool) -> DataFrame:
        rows = readers.read_lists(spark, path, skip_first_line=skip)
        return order.number_file_rows(rows, "_row").drop(ORDER, SOURCE)

    voip = numbered(voip_path, False).withColumn("_ts", R.parse_ts(voip_ts))
    dialer = numbered(dialer_path, dialer_skip_first_line).withColumn("_ts", R.parse_ts(dialer_ts))
    pairs = calls.match_calls(
        voip, dialer, voip_phone, "_ts", "_row", dialer_phone, "_ts", "_row", tolerance_seconds
    )
    merged = calls.merge_matched_calls(
        voip.drop("_ts"), dialer.drop("_ts"), pairs, voip_phone, dialer_phone, price, "_row", "_row"
    )
    absent = calls.calls_absent(dialer, voip, dialer_phone, voip_phone)
    writers.write_list(merged, f"{out}/mesclado_voip_discador")
    writers.write_list(absent.drop("_ts", "_row"), f"{out}/discador_numero_ausente_no_voip")
    return (
        calls.call_report(voip, dialer, pairs, "_ts", price, voip_seconds, dialer_seconds, "_row", "_row"),
        calls.absent_report(absent, dialer_phone, "_ts", dialer_seconds),
    )


def fill_by_company_name(
    spark: SparkSession, path: str, ref_path: str, name: str, ref_name: str, ref_cnpj: str, out: str
) -> None:
    """Company ids by name: rows with one id, with several (one row each) and with none."""
    base = readers.read_lists(spark, path).drop(SOURCE, ORDER)
    ref = readers.read_lists(spark, ref_path)
    tagged = cut_lineage(enrich.tag_match_count(base, ref, name, ref_name, ref_cnpj, ORDER))
    for rows, folder in zip(enrich.match_count_sides(tagged), ("1_cnpj", "varios_cnpj", "sem_corresp")):
        writers.write_list(rows, f"{out}/{folder}")


# columns

def map_columns(spark: SparkSession, path: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    rows = readers.read_lists(spark, path)
    writers.write_list(shape.map_columns(rows, mapping), out)
    return shape.mapping_report(rows, list(mapping), mapping)


def recompute_totals(spark: SparkSession, path: str, out: str) -> None:
    _per_layout(spark, path, out, "", reports.recompute_totals)


def normalize_money(spark: SparkSession, path: str, out: str) -> None:
    _per_layout(spark, path, out, "", shape.normalize_money)


# conversion and extraction

def excel_numbers(spark: SparkSession, path: str, names: Sequence[str], out: str, places: int = 2) -> None:
    _per_layout(spark, path, out, "", lambda t: shape.apply_excel_numbers(t, names, places))


def id_text_to_list(spark: SparkSession, path: str, out: str, name: str = "CNPJ") -> None:
    writers.write_list(readers.read_id_text(spark, path, name), out, clean=False)


def extract_ids(
    spark: SparkSession, path: str, key: str, out: str, ids_per_file: int | None = None
) -> None:
    """Distinct valid company ids as comma-joined text files."""
    ids = dedupe.distinct_ids(readers.read_lists(spark, path), key, ORDER)
    writers.write_id_text(ids, "id", ["first_row"], out, ids_per_file)


def join_companies(
    spark: SparkSession, ids_path: str, data_path: str, out: str, data_key: str | None = None
) -> None:
    """Company data for lists of ids without a header, with a byte-order mark for spreadsheets."""
    ids = readers.read_key_list(spark, ids_path).select("CNPJ")
    data = readers.read_lists(spark, data_path, with_order=False).drop(SOURCE)
    writers.write_list(enrich.join_companies(ids, data, "CNPJ", data_key), out, bom=True, clean=False)


# banks

def bank_names(
    spark: SparkSession, path: str, banks_path: str, bank_code: str, bank_name: str, out: str,
    code: str | None = None,
) -> DataFrame:
    """Bank names from one table; files without a code column are only in the report, which is returned."""
    banks = readers.read_lists(spark, banks_path)

    def step(table: DataFrame) -> DataFrame:
        own = _column(table.drop(SOURCE, ORDER), code, discover.find_bank_code_column)
        return enrich.bank_names(table, banks, own, bank_code, bank_name, ORDER)

    return _per_layout(spark, path, out, NAMED, step)


def bank_names_layered(
    spark: SparkSession, path: str, register_path: str, table_path: str, out: str,
    code: str | None = None,
) -> DataFrame:
    """Bank names from the register first, then from the short table; see ``bank_names``."""
    register, table_banks = readers.read_lists(spark, register_path), readers.read_lists(spark, table_path)

    def step(table: DataFrame) -> DataFrame:
        own = _column(table.drop(SOURCE, ORDER), code, discover.find_bank_code_column)
        return shape.fix_bank_texts(enrich.bank_names_layered(table, register, table_banks, own, ORDER))

    return _per_layout(spark, path, out, NAMED, step)


def branch_banks(spark: SparkSession, path: str, out: str, uf: str | None = None) -> None:
    """Banks with a branch (in a state) from a branch register."""
    writers.write_list(dedupe.branch_banks(readers.read_lists(spark, path), ORDER, uf), out, clean=False)
