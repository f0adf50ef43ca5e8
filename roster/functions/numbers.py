"""Number text (Brazilian and US forms) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roster.functions.text import column, strip, text

# Fixed values.
NUMBER_SIGNS = "0123456789.+-eE"
SUSPICIOUS = 100000.0  # amounts above this are taken as reading errors
TARIFF_PER_MINUTE = 0.05
TARIFF_MINIMUM = 0.025
MISSING = "—"
DECIMAL_PLACES = 6  # decimals of up to so many places are never shown with an exponent
MONTH, WEEK, DAY, HOUR, MINUTE = 30 * 86400, 7 * 86400, 86400, 3600, 60


def plain_number(c: Column | str) -> Column:
    """Double for plain decimal text (point, optional exponent), else null.

    Of texts with other characters a cast would take some, such as ``1d``, ``NaN`` or ``Infinity``.
    """
    return stripped_number(strip(c))


def stripped_number(c: Column | str) -> Column:
    """``plain_number`` of a text without white space around it."""
    value = text(c)
    # an empty text is no number either way, but a cast that fails is slow
    signs_only = (value != "") & (F.translate(value, NUMBER_SIGNS, "") == "")
    return F.when(signs_only, value.try_cast("double"))


def _swap(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def _localised(value: Column) -> Column:
    """With a comma the points are thousand marks and the comma is the decimal mark."""
    dotted = _swap(_swap(value, ".", ""), ",", ".")
    return F.when(F.contains(value, F.lit(",")), dotted).otherwise(value)


def parse_br_number(c: Column | str) -> Column:
    """Brazilian or US number text, with or without a currency sign, as double; bad text is null."""
    return plain_number(_localised(_swap(_swap(text(c), "R$", ""), "$", "")))


def parse_decimal(c: Column | str) -> Column:
    """Number text with a decimal comma or point (no thousand marks) as double; bad text is null."""
    return plain_number(_swap(text(c), ",", "."))


def _off_tie(value: Column, places: int) -> Column:
    """The number, cut to ``places`` where half-up rounding of its text would be wrong.

    Spark rounds the shortest decimal form of a double half up. Rounding the exact binary value
    with ties to even differs only when this form ends in a 5 right after the wanted places (2.675
    is really a little less). For those values the double is split into two parts whose scaled
    values are exact, which tells on which side of the tie it lies. Below it, the kept digits
    themselves are the answer. Exact up to 2^53 units of the place after the last: 9e12 for two places,
    9e11 for three; beyond, a double has no digits left for a tie and Spark's rounding stands.
    """
    size = F.abs(value)
    scale = F.lit(float(10 ** (places + 1)))
    head = size.cast("float").cast("double")
    whole = F.rint(head * scale)  # the large part by itself, as the product of both would lose digits
    units = whole + F.rint((head * scale - whole) + (size - head) * scale)
    last = units % 20  # 5: the kept digit is even, 15: it is odd
    beyond = (head * scale - units) - (head - size) * scale
    limit = F.when(last == 5, 1e-300).when(last == 15, 0.0).otherwise(float("-inf"))
    down = (units / scale == size) & (beyond < limit)
    return F.when(down, F.signum(value) * ((units - 5) / scale)).otherwise(value)


def rounded(x: Column | str, places: int) -> Column:
    """Double rounded from its exact binary value, ties to even."""
    return F.round(_off_tie(column(x).cast("double"), places), places)


def fixed(x: Column | str, places: int) -> Column:
    """Fixed-point text of a double, rounded from its exact binary value, ties to even."""
    value = column(x).cast("double")
    moved = _off_tie(value, places)
    shown = F.format_string(f"%.{places}f", moved)
    if places <= DECIMAL_PLACES:  # a decimal is the cheaper way, but its sign goes with a zero
        sign = F.when(value < 0, "-").otherwise("")
        plain = F.abs(moved).try_cast(f"decimal(38,{places})").cast("string")
        shown = F.coalesce(F.concat(sign, plain), shown)
    # two sure references make the generated code compute the number once
    return F.when(F.greatest(value, F.abs(value)).isNotNull(), shown)


def excel_number(c: Column | str, places: int = 2) -> Column:
    """Number text with a decimal point and fixed places; unreadable gives empty text."""
    return excel_text(parse_br_number(c), places)


def excel_text(amount: Column | str, places: int = 2) -> Column:
    """``excel_number`` of an amount that is already read."""
    return F.coalesce(fixed(amount, places), F.lit(""))


def amount_text(c: Column | str) -> Column:
    """The text that ``stripped_number`` reads as the number for totals."""
    return strip(_localised(text(c)))


def capped(amount: Column | str, limit: float | None = SUSPICIOUS) -> Column:
    """``to_float_capped`` of a text whose amount is already read."""
    value = column(amount)
    if limit is None:
        return F.coalesce(value, F.lit(0.0))
    kept = value * (F.abs(value) <= limit).cast("double") + 0.0
    return F.coalesce(kept, F.lit(0.0))


def to_float_capped(c: Column | str, limit: float | None = SUSPICIOUS) -> Column:
    """Number for totals: blank and bad text count 0, and so does anything above ``limit``, if there is one."""
    return capped(stripped_number(amount_text(c)), limit)


def over_limit(amount: Column | str, limit: float | None = SUSPICIOUS) -> Column:
    """Is this amount a number that ``capped`` takes as 0 because of its size?"""
    if limit is None:
        return F.lit(False)
    return F.coalesce(F.abs(column(amount)) > limit, F.lit(False))


def br_money2(c: Column | str) -> Column:
    """Two places with a decimal comma; blank gives ``0,00``, unreadable text stays."""
    return money2_text(c, money2_amount(c))


def money2_amount(c: Column | str) -> Column:
    """The number ``br_money2`` reads."""
    return plain_number(_localised(text(c)))


def money2_text(c: Column | str, amount: Column | str) -> Column:
    """``br_money2`` of a text whose amount is already read."""
    shown = _swap(fixed(amount, 2), ".", ",")
    return F.coalesce(shown, F.nullif(strip(c), F.lit("")), F.lit("0,00"))


def price3(c: Column | str) -> Column:
    """Three places with a decimal comma; unreadable gives empty text."""
    return F.coalesce(_swap(fixed(parse_decimal(c), 3), ".", ","), F.lit(""))


def decimal_br(c: Column | str) -> Column:
    """Up to twelve places with a decimal comma, no trailing zeros; unreadable gives empty text."""
    short = F.regexp_replace(fixed(parse_decimal(c), 12), r"\.?0+$", "")
    signless = F.when(short == "-0", "0").otherwise(short)
    return F.coalesce(_swap(signless, ".", ","), F.lit(""))


def decimal_comma(c: Column | str) -> Column:
    """Points become commas; null and the text ``nan`` become empty."""
    value = text(c)
    return F.when(value.isNull() | (value == "nan"), "").otherwise(_swap(value, ".", ","))


def int_br(c: Column | str) -> Column:
    """Whole number with point thousand marks, such as ``63.416``."""
    grouped = F.translate(F.format_number(column(c).try_cast("bigint"), 0), ",", ".")
    return F.coalesce(grouped, F.lit(MISSING))


def money_br(c: Column | str, places: int = 3) -> Column:
    """Money text such as ``R$ 72.262,262``; missing gives a dash."""
    value = column(c).cast("double")
    amount = fixed(F.abs(value), places)
    sign = F.when(value < 0, "R$ -").otherwise("R$ ")
    whole = F.regexp_replace(F.substring_index(amount, ".", 1), r"(?<=\d)(?=(\d{3})+$)", ".")
    tail = F.concat(F.lit(","), F.substring_index(amount, ".", -1)) if places else F.lit("")
    return F.coalesce(F.concat(sign, whole, tail), F.lit(MISSING))


def tariff(seconds: Column | str) -> Column:
    """Charge for a call: per minute, with a minimum from one second on, nothing below that."""
    s = column(seconds).cast("double")
    charge = F.greatest(F.lit(TARIFF_MINIMUM), s / 60.0 * TARIFF_PER_MINUTE)
    return F.when(s >= 1, charge).otherwise(0.0)


def duration_text(seconds: Column | str) -> Column:
    """Seconds as ``months:weeks:days:hours:minutes:seconds``, two digits each; missing is a dash."""
    total = F.greatest(F.bround(column(seconds).cast("double"), 0).cast("bigint"), F.lit(0))
    parts, left = [], total
    for unit in (MONTH, WEEK, DAY, HOUR, MINUTE):
        parts.append(F.floor(left / unit).cast("bigint"))
        left = left % unit
    shown = F.format_string(":".join(["%02d"] * 6), *parts, left)
    return F.when(total.isNull() | column(seconds).isNull(), MISSING).otherwise(shown)
