"""Finding columns by name and by content."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.functions.text import column, strip, text
from roster.session import ship

ship(__name__)

# Name parts that mark columns, in order of trust.
PHONE_WORDS = ("telefone", "fone", "phone", "celular", "mobile", "numero", "num", "number")
PHONE_WORDS_SECOND = ("id", "codigo", "code")
BANK_WORDS = (
    "codigo_banco", "codigo_comp", "codigo_compe", "banco_codigo", "bank_code", "comp", "compe",
)
BANK_WORDS_SECOND = ("banco", "codigo", "code", "bank", "instituicao", "inst", "numero", "num")
PHONE_MIN_DIGITS, PHONE_SHARE = 8, 0.7
BANK_THREE_DIGIT_SHARE, BANK_SHORT_SHARE = 0.6, 0.5
USED_TOTAL, BALANCE_TOTAL = "Total_Utilizado", "Total_Saldo"
USED_PARTS = ("Utilizado_5", "Utilizado_Beneficio_5", "Utilizado_35")
BALANCE_PARTS = ("Saldo_5", "Saldo_Beneficio_5", "Saldo_35")


def _share(condition: Column, of: Column) -> Column:
    return F.try_divide(F.count_if(of.isNotNull() & condition), F.count(of))


def _looks_like_phone(name: str) -> Column:
    bare = F.translate(strip(name), "()- ", "")
    return bare.rlike(f"^[0-9]{{{PHONE_MIN_DIGITS},}}$")


def phone_ratio(df: DataFrame, name: str) -> DataFrame:
    """Share of the non-null values that read as phone numbers."""
    return df.agg(_share(_looks_like_phone(name), text(name)).alias("ratio"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column, over all rows in one pass: non-null values and the shares the finders use."""
    def shares(i: int, name: str) -> list[Column]:
        value = text(name)
        return [
            F.count(value).alias(f"_n{i}"),
            _share(_looks_like_phone(name), value).alias(f"_p{i}"),
            _share(value.rlike("^[0-9]{3}$"), value).alias(f"_b{i}"),
            _share(value.rlike("^[0-9]{1,4}$"), value).alias(f"_c{i}"),
        ]

    wide = df.agg(*[s for i, c in enumerate(df.columns) for s in shares(i, c)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.col(f"_n{i}").alias("filled"),
            F.col(f"_p{i}").alias("phone_share"),
            F.col(f"_b{i}").alias("three_digit_share"),
            F.col(f"_c{i}").alias("short_code_share"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _plain_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def _named(names: Sequence[str], words: Sequence[str]) -> list[str]:
    return [n for n in names if any(w in _plain_name(n) for w in words)]


def find_phone_column(df: DataFrame) -> str | None:
    """Phone column: trusted names first, then weaker names, then any; most values must be phones."""
    good = {
        r["column"]
        for r in profile_columns(df).where(F.col("phone_share") >= PHONE_SHARE).collect()  # one row per column
    }
    tiers = (_named(df.columns, PHONE_WORDS), _named(df.columns, PHONE_WORDS_SECOND), df.columns)
    return next((c for tier in tiers for c in tier if c in good), None)


def find_bank_code_column(df: DataFrame) -> str:
    """Bank-code column: by trusted name, by weaker name, else by short numeric content."""
    for words in (BANK_WORDS, BANK_WORDS_SECOND):
        named = _named(df.columns, words)
        if named:
            return named[0]
    fits = (F.col("three_digit_share") >= BANK_THREE_DIGIT_SHARE) | (
        F.col("short_code_share") >= BANK_SHORT_SHARE
    )
    first = profile_columns(df).where(fits).orderBy("position").first()
    if first is None:
        raise ValueError("no bank-code column found; name it")
    return first["column"]


def find_key_column(df: DataFrame, words: Sequence[str] = ("cnpj", "cpf")) -> str:
    """The one column whose name holds one of ``words``."""
    found = [c for c in df.columns if any(w in c.lower() for w in words)]
    if len(found) != 1:
        raise ValueError(f"expected one column named like {'/'.join(words)}, found {found}; name it")
    return found[0]


def find_birth_column(names: Sequence[str]) -> str | None:
    """Birth-date column by name, in order of trust."""
    known = {n.strip().lower(): n for n in names}
    wanted = ("nasc", "data_nascimento", "data nascimento", "datanascimento")  # fixed values
    return next((known[w] for w in wanted if w in known), None)


def find_total_columns(names: Sequence[str]) -> dict[str, list[str]]:
    """The used and balance totals with their part columns: first name holding each fragment."""
    def first(fragment: str) -> str | None:
        return next((n for n in names if fragment.lower() in n.lower()), None)

    found = {}
    for total, parts in ((USED_TOTAL, USED_PARTS), (BALANCE_TOTAL, BALANCE_PARTS)):
        target = first(total)
        if target is not None:
            found[target] = [p for p in map(first, parts) if p is not None]
    return found


def _first_values(names: Sequence[str], examples: int):
    """A task's first distinct values of each column: at most ``examples`` rows a column, however many rows it reads."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in names]  # value: the least order it has

        def sortable(order):
            return tuple(order.values()) if isinstance(order, dict) else (order,)

        schema = None
        for batch in batches:
            schema = batch.schema
            orders = batch.column("_order").to_pylist()
            keys = [sortable(o) for o in orders]
            ready = sorted(range(len(keys)), key=keys.__getitem__)
            for i, best in enumerate(kept):
                limit = max(k for k, _ in best.values()) if len(best) == examples else None
                if not ready or (limit is not None and keys[ready[0]] >= limit):
                    continue  # this batch begins after all that is kept
                values = batch.column(f"_v{i}").to_pylist()
                for n in ready:
                    if limit is not None and keys[n] >= limit:
                        break
                    value = values[n]
                    if value is None or (value in best and best[value][0] <= keys[n]):
                        continue
                    best[value] = (keys[n], orders[n])
                    if len(best) > examples:
                        del best[max(best, key=lambda v: (best[v][0], v))]
                    limit = max(k for k, _ in best.values()) if len(best) == examples else None
        if schema is not None:
            order_type = schema.field("_order").type
            rows = [(i, value, order) for i, best in enumerate(kept) for value, (_, order) in best.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], order_type)],
                ["position", "value", "_first"],
            )

    return first


def column_preview(df: DataFrame, order_by: Column | str, examples: int = 5) -> DataFrame:
    """Per column: type and up to ``examples`` distinct values, first seen first.

    Every task hands on its own first values only, at most ``examples`` a column: a value among the first of all is among
    the first of the task that has it first. ``order_by`` must not be null.
    """
    types = dict(df.dtypes)
    ordered = df.select(column(order_by).alias("_order"), *[text(c).alias(f"_v{i}") for i, c in enumerate(df.columns)])
    kind = ordered.schema["_order"].dataType.simpleString()
    firsts = ordered.mapInArrow(_first_values(df.columns, examples), f"position int, value string, _first {kind}")
    seen = firsts.groupBy("position", "value").agg(F.min("_first").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("position").orderBy("_first", "value"))
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type")) for c in df.columns])
    ranked = seen.select("position", F.get(names, F.col("position")).alias("_c"), "value", rank.alias("rank"))
    return ranked.where(F.col("rank") <= examples).select("position", "_c.column", "_c.type", "value", "rank")


def preview(df: DataFrame, order_by: Sequence[Column | str], rows: int = 5) -> DataFrame:
    """First rows in an order, for a look; every task hands on its own first rows only."""
    return df.orderBy(*order_by).limit(rows)
