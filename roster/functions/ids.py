"""Person, company, phone and bank identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roster.functions.numbers import plain_number
from roster.functions.text import is_blank, strip, text

CPF_DIGITS = 11
CNPJ_DIGITS = 14
DDI = "55"  # fixed value: country prefix of a dialled number
DDI_MIN_DIGITS = 12


def digits(c: Column | str) -> Column:
    """Only the digits; full-width digits count as ASCII ones. Null stays null."""
    found = F.regexp_replace(text(c), "[^0-9０-９]", "")
    return F.translate(found, "０１２３４５６７８９", "0123456789")


def cpf(c: Column | str, blank_is_null: bool = False) -> Column:
    """Person id: digits padded to 11, never cut. Blank gives eleven zeros unless ``blank_is_null``."""
    d = digits(c)
    padded = F.lpad(d, F.greatest(F.length(d), F.lit(CPF_DIGITS)), "0")
    return F.when(d != "", padded) if blank_is_null else padded


def cpf_strict(c: Column | str) -> Column:
    """Person id of exactly 11 digits, or empty text when there is no digit."""
    d = digits(c)
    return F.coalesce(F.lpad(d, _width(d, CPF_DIGITS), "0"), F.lit(""))


def _width(d: Column, width: int) -> Column:
    """Pad width that keeps empty text empty."""
    return F.when(F.length(d) > 0, width).otherwise(0)


def cnpj14(c: Column | str) -> Column:
    """Company id padded and cut to 14 digits; blank gives empty text."""
    return F.when(is_blank(c), "").otherwise(F.lpad(digits(c), CNPJ_DIGITS, "0"))


def cnpj_valid(c: Column | str) -> Column:
    """Company id digits when there are exactly 14 of them, else null."""
    d = digits(c)
    return F.when(F.length(d) == CNPJ_DIGITS, d)


def cnpj_mask(c: Column | str) -> Column:
    """Company id as ``00.000.000/0000-00``; empty text when there is no digit."""
    d = digits(c)
    padded = F.lpad(d, _width(d, CNPJ_DIGITS), "0")
    masked = F.regexp_replace(padded, "^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")
    return F.coalesce(masked, F.lit(""))


def cnpj_text(c: Column | str) -> Column:
    """Company id cell as stripped text; null gives empty text."""
    return F.coalesce(strip(c), F.lit(""))


def phone(c: Column | str, null_as_blank: bool = False) -> Column:
    """Phone digits. ``null_as_blank`` is the dialler-list form."""
    d = digits(c)
    return F.coalesce(d, F.lit("")) if null_as_blank else d


def phone_no_ddi(c: Column | str) -> Column:
    """Phone digits without the country prefix (numbers of 12 or more digits)."""
    d = phone(c, null_as_blank=True)
    rest = DDI_MIN_DIGITS - len(DDI)
    return F.regexp_replace(d, f"^{DDI}(?=[0-9]{{{rest}}})", "")


def bank_code(c: Column | str) -> Column:
    """Bank code text: ``626.0`` becomes ``626``; leading zeros and unparsable text stay."""
    code = strip(c)
    whole = plain_number(code).try_cast("bigint").cast("string")
    return F.when(F.contains(code, F.lit(".")), F.coalesce(whole, code)).otherwise(code)
