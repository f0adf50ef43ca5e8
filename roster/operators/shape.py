"""Column selection, renaming and value clean-up."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roster.functions.numbers import (
    decimal_comma, excel_text, money2_amount, money2_text, parse_br_number,
)
from roster.functions.text import column, fix_mojibake, strip_quotes, text


def alpha_name(index: int) -> str:
    """Spreadsheet column name: 0 is A, 25 is Z, 26 is AA."""
    name, left = "", index + 1
    while left:
        left, letter = divmod(left - 1, 26)
        name = chr(65 + letter) + name
    return name


def keep_columns_alpha(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chosen columns in table order, renamed A, B, C, …"""
    chosen = [c for c in df.columns if c in set(names)]
    if not chosen:
        raise ValueError("none of the chosen columns is in the table")
    return df.select(*[column(c).alias(alpha_name(i)) for i, c in enumerate(chosen)])


def identifier_to_cpf(df: DataFrame) -> DataFrame:
    """Only the column ``identifier``, as ``CPF``."""
    if "identifier" not in df.columns:
        raise ValueError("no column named identifier")
    return df.select(column("identifier").alias("CPF"))


# Columns of the benefit-holder layout, in output order.
INSS_LAYOUT = (
    "CEL1", "Nome", "CPF", "NASC", "IDADE", "Municipio", "UF", "Codigo_Banco", "nome_banco",
    "Valor_Parcela", "Prazo", "Parcelas_Paga", "Parcelas_Restante", "Emprestimo_Ativos",
    "Beneficio", "Valor_Beneficio", "Margem_Disponivel", "Margem_RMC", "Margem_RCC",
)


def conform_layout(
    df: DataFrame,
    layout: Sequence[str] = INSS_LAYOUT,
    optional: Mapping[str, str] | None = None,
) -> DataFrame:
    """The columns of ``layout`` in order; ``optional`` columns are added with their value if absent."""
    optional = {"nome_banco": ""} if optional is None else optional
    missing = [c for c in layout if c not in df.columns and c not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(
        *[column(c) if c in df.columns else F.lit(optional[c]).alias(c) for c in layout]
    )


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Output columns by ``{model column: data column}``; an absent data column gives empty text.

    Model columns without an entry (or with an empty one) are left out.
    """
    chosen = {model: data for model, data in mapping.items() if data}
    return df.select(
        *[
            (column(data) if data in df.columns else F.lit("")).alias(model)
            for model, data in chosen.items()
        ]
    )


def mapping_report(df: DataFrame, model: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    """Per model column: the data column used and how many of its values are filled."""
    mapped = [m for m in model if mapping.get(m) in df.columns]
    filled = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.coalesce(text(mapping[m]), F.lit("")) != "").alias(f"_n{i}") for i, m in enumerate(mapped)],
    )
    rows = [
        F.struct(
            F.lit(m).alias("model_column"),
            F.lit(mapping.get(m) or None).cast("string").alias("data_column"),
            F.col("_rows").alias("rows"),
            (F.col(f"_n{mapped.index(m)}") if m in mapped else F.lit(0).cast("bigint")).alias("filled"),
        )
        for m in model
    ]
    return filled.select(F.inline(F.array(*rows)))


def add_constant(df: DataFrame, name: str, value: str) -> DataFrame:
    """A text column with one value; an existing column of that name is overwritten."""
    return df.withColumn(name, F.lit(value))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def strip_quotes_all(df: DataFrame) -> DataFrame:
    """Remove double quotes from every text column."""
    return df.withColumns({c: strip_quotes(c) for c in text_columns(df)}) if text_columns(df) else df


# Words that mark an id column.
ID_WORDS = (
    "telefone", "fone", "phone", "celular", "mobile", "cpf", "cnpj", "rg", "cep", "codigo", "code",
    "numero", "num", "id", "identificador",
)


def id_columns(names: Sequence[str], words: Sequence[str] = ID_WORDS) -> list[str]:
    """Names holding one of ``words`` as a whole word (words end at ``_``, blanks, ``-`` or digits)."""
    marks = set(words)
    return [n for n in names if marks & set(re.split(r"[^a-zà-ÿ]+", n.lower()))]


def clean_id(c: Column | str) -> Column:
    """Id text: missing markers become empty, a trailing ``.0`` goes."""
    value = text(c)
    blank = value.isNull() | value.isin("nan", "None", "NULL")
    return F.when(blank, "").otherwise(F.regexp_replace(value, r"\.0$", ""))


def clean_id_columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Clean the id columns (named ones, else by ``id_columns``)."""
    chosen = id_columns(df.columns) if names is None else [n for n in names if n in df.columns]
    return df.withColumns({c: clean_id(c) for c in chosen}) if chosen else df


def decimal_comma_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Write the named columns with a decimal comma."""
    return df.withColumns({c: decimal_comma(c) for c in names if c in df.columns})


def apply_excel_numbers(df: DataFrame, names: Sequence[str], places: int = 2) -> DataFrame:
    """Fixed-place decimal-point text in the named columns; absent ones are skipped."""
    present = [c for c in names if c in df.columns]
    if not present:
        raise ValueError("none of the chosen columns is in the table")
    return _read_then_write(df, present, parse_br_number, lambda c, n: excel_text(n, places))


def _read_then_write(
    df: DataFrame,
    names: Sequence[str],
    read: Callable[[str], Column],
    write: Callable[[str, Column], Column],
) -> DataFrame:
    """Read numbers in one projection and format them in the next.

    Formatting refers to the number several times; with the number as a column it is read once.
    """
    helpers = {c: f"_n{i}" for i, c in enumerate(names)}
    numbers = df.withColumns({h: read(c) for c, h in helpers.items()})
    return numbers.withColumns({c: write(c, F.col(h)) for c, h in helpers.items()}).drop(*helpers.values())


# Money columns of the margin layout.
MONEY_COLUMNS = (
    "Renda_Bruta", "Bruta_5", "Utilizado_5", "Saldo_5", "Bruta_Beneficio_5",
    "Utilizado_Beneficio_5", "Saldo_Beneficio_5", "Bruta_35", "Utilizado_35", "Saldo_35",
    "Total_Utilizado", "Total_Saldo",
)


def normalize_money(df: DataFrame, names: Sequence[str] = MONEY_COLUMNS) -> DataFrame:
    """Two-place decimal-comma text in whichever of the money columns exist."""
    present = [c for c in names if c in df.columns]
    return _read_then_write(df, present, money2_amount, money2_text) if present else df


# Columns that hold bank texts.
BANK_TEXT_COLUMNS = (
    "nome_banco", "nome_completo_banco", "Banco", "name", "fullName", "fonte_informacao", "Site",
    "site",
)


def fix_bank_texts(df: DataFrame, names: Sequence[str] = BANK_TEXT_COLUMNS) -> DataFrame:
    """Repair wrongly decoded text in the bank columns that exist."""
    present = [c for c in names if c in text_columns(df)]
    return df.withColumns({c: fix_mojibake(c) for c in present}) if present else df
