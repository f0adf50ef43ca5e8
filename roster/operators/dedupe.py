"""Duplicate removal by normalised key.

"First per key" is a ranked window limited to rank 1. Spark then keeps only the best row per key in
every map task before the exchange, so a key that holds much of the data sends one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.functions.ids import bank_code, cnpj_valid, cpf
from roster.functions.numbers import plain_number
from roster.functions.text import blank_to_null, column, strip

Normaliser = Callable[[Column], Column]


def first_per_key(
    df: DataFrame, keys: Sequence[Column | str], order_by: Sequence[Column | str]
) -> DataFrame:
    """The first row of each key in ``order_by`` order; null is a key like any other."""
    ranked = Window.partitionBy(*[column(k) for k in keys]).orderBy(*[column(o) for o in order_by])
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def dedup_first(
    df: DataFrame,
    key: str,
    order_by: Sequence[Column | str],
    normalise: Normaliser = cpf,
    within: Sequence[str] = (),
) -> DataFrame:
    """Keep the first row per normalised key; ``within=["source_file"]`` works file by file."""
    return first_per_key(df, [*within, normalise(column(key))], order_by)


def dedup_max(
    df: DataFrame,
    key: str,
    value: str,
    order_by: Sequence[Column | str],
    normalise: Normaliser = cpf,
    within: Sequence[str] = (),
) -> DataFrame:
    """Keep the row with the largest value per key (unreadable counts 0); null keys are dropped."""
    keyed = normalise(column(key))
    size = F.coalesce(plain_number(value), F.lit(0.0))
    return first_per_key(df.where(keyed.isNotNull()), [*within, keyed], [size.desc(), *order_by])


def dedup_stats(
    df: DataFrame, key: str, normalise: Normaliser = cpf, within: Sequence[str] = ()
) -> DataFrame:
    """Rows, distinct non-null keys and rows a first-per-key pass removes."""
    keyed = df.select(*within, normalise(column(key)).alias("_key"))
    per_key = keyed.groupBy(*within, "_key").agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.groupBy(*within).agg(
        F.sum("_rows").alias("rows"),
        F.count("_key").alias("unique_keys"),
        (F.sum("_rows") - F.count(F.lit(1))).alias("removed"),
    )


def distinct_ids(
    df: DataFrame, key: str, order_by: Column | str, normalise: Normaliser = cnpj_valid
) -> DataFrame:
    """Valid ids once each, with the position of their first row."""
    return (
        df.select(normalise(column(key)).alias("id"), column(order_by).alias("_order"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("_order").alias("first_row"))
    )


def distinct_keys(df: DataFrame, key: str, normalise: Normaliser = cpf) -> DataFrame:
    """Non-blank normalised keys once each, for membership tests."""
    return df.select(normalise(column(key)).alias("key")).where(F.col("key") != "").distinct()


def unique_count(df: DataFrame, key: str, normalise: Normaliser = cpf) -> DataFrame:
    return df.agg(F.countDistinct(normalise(column(key))).alias("unique_keys"))


SKETCH_LG = 14  # 2^14 registers: a standard error of 0.65 percent in 12 kB a sketch


def key_sketches(df: DataFrame, key: str, within: Sequence[str] = (), normalise: Normaliser = cpf, lg: int = SKETCH_LG) -> DataFrame:
    """Per group: rows and a HyperLogLog sketch of the keys, as binary that can be kept and united later.

    Every task sums up its rows in one sketch a group, so what is exchanged does not grow with the keys.
    """
    return df.groupBy(*within).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(normalise(column(key)), F.lit(lg)).alias("sketch"))


def sketched_count(sketches: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Rows and approximate number of distinct keys of united ``key_sketches``, kept ones of other days or files included."""
    return sketches.groupBy(*within).agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_keys")
    )


# Column names a branch register may use, first present wins.
CODE_NAMES = (
    "CodigoCompe", "Codigo_Compe", "CodigoCompensacao", "Numero_Codigo", "NumeroBanco",
    "Numero_Banco", "Codigo", "codigo", "CODIGO_COMPE",
)
BANK_NAMES = (
    "NomeIf", "NomeInstituicao", "Nome_Instituicao", "NomeExtenso", "Nome_Extenso", "NomeReduzido",
    "Nome_Reduzido", "Instituicao", "instituicao", "Nome", "nome", "NOME_INSTITUICAO",
)
STATE_NAMES = (
    "Uf", "UF", "uf", "Estado", "estado", "EstadoSigla", "Estado_Sigla", "MunicipioUf",
    "Municipio_Uf",
)


def _first_filled(df: DataFrame, names: Sequence[str], blank_counts: bool = False) -> Column:
    """First column of ``names`` with a value; ``blank_counts`` stops at the first non-null one."""
    present = [n for n in names if n in df.columns]
    pick = strip if blank_counts else blank_to_null
    return F.coalesce(*[pick(n) for n in present], F.lit(None).cast("string"))


def branch_banks(agencies: DataFrame, order_by: Column | str, uf: str | None = None) -> DataFrame:
    """Banks with at least one branch (in state ``uf`` if given): numeric code and first name."""
    rows = agencies
    if uf is not None:
        state = F.upper(_first_filled(rows, STATE_NAMES, blank_counts=True))
        rows = rows.where(strip(F.substring_index(state, "/", -1)) == uf.strip().upper())
    found = rows.select(
        _first_filled(rows, CODE_NAMES).alias("codigo_banco"),
        _first_filled(rows, BANK_NAMES).alias("nome_banco"),
        column(order_by).alias("_order"),
    )
    return (
        digits_code_only(found, "codigo_banco", "nome_banco")
        .groupBy("codigo_banco")
        .agg(F.min_by("nome_banco", "_order").alias("nome_banco"))
        .orderBy(F.col("codigo_banco").cast("decimal(38,0)"), "codigo_banco")
    )


def digits_code_only(df: DataFrame, code: str, name: str) -> DataFrame:
    """Rows with a code made only of digits and a non-blank name."""
    return df.where(column(code).rlike("^[0-9]+$") & (strip(name) != ""))


def bank_codes(df: DataFrame, code: str) -> DataFrame:
    return distinct_keys(df, code, bank_code)
