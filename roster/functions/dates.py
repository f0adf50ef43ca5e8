"""Date text as Column expressions.

Dates come in day-first, year-first and two-digit-year forms. Each form is rewritten to ISO order
by a pattern and cast; a form whose date does not exist gives null, so the next form is tried.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from roster.functions.text import column, strip, text

_TIME = r"(?: (?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01]))"
_D, _Y = r"(\d{1,2})", r"(\d{4})"
_OLD, _NEW = r"(69|[7-9]\d)", r"([0-5]\d|6[0-8])"  # two-digit years: 69-99 are 19xx, 00-68 are 20xx


def _iso_date(value: Column, pattern: str, iso: str) -> Column:
    return F.when(value.rlike(pattern), F.regexp_replace(value, pattern, iso).try_cast("date"))


def _short_year(value: Column, pattern: str, iso: str) -> list[Column]:
    """The two centuries of a two-digit-year form; at most one of them matches."""
    return [
        _iso_date(value, pattern.format(y=_OLD), iso.format(century="19")),
        _iso_date(value, pattern.format(y=_NEW), iso.format(century="20")),
    ]


def birth_date(c: Column | str) -> Column:
    """Date from the twelve birth-date forms, tried in order.

    ``d/m/Y d-m-Y Y-m-d Y/m/d``, the same with two-digit years, and the first four with a time.
    """
    v = text(c)
    forms = [
        _iso_date(v, f"^{_D}/{_D}/{_Y}$", "$3-$2-$1"),
        _iso_date(v, f"^{_D}-{_D}-{_Y}$", "$3-$2-$1"),
        _iso_date(v, f"^{_Y}-{_D}-{_D}$", "$1-$2-$3"),
        _iso_date(v, f"^{_Y}/{_D}/{_D}$", "$1-$2-$3"),
        *_short_year(v, "^(\\d{{1,2}})/(\\d{{1,2}})/{y}$", "{century}$3-$2-$1"),
        *_short_year(v, "^(\\d{{1,2}})-(\\d{{1,2}})-{y}$", "{century}$3-$2-$1"),
        *_short_year(v, "^{y}-(\\d{{1,2}})-(\\d{{1,2}})$", "{century}$1-$2-$3"),
        *_short_year(v, "^{y}/(\\d{{1,2}})/(\\d{{1,2}})$", "{century}$1-$2-$3"),
        _iso_date(v, f"^{_D}/{_D}/{_Y}{_TIME}$", "$3-$2-$1"),
        _iso_date(v, f"^{_D}-{_D}-{_Y}{_TIME}$", "$3-$2-$1"),
        _iso_date(v, f"^{_Y}-{_D}-{_D}{_TIME}$", "$1-$2-$3"),
        _iso_date(v, f"^{_Y}/{_D}/{_D}{_TIME}$", "$1-$2-$3"),
    ]
    return F.coalesce(*forms)


def _years_between(born: Column, as_of: Column) -> Column:
    """Full years by calendar fields (29 February counts from 1 March in common years)."""
    def day_of_year(d: Column) -> Column:
        return F.month(d) * 100 + F.day(d)

    return F.year(as_of) - F.year(born) - (day_of_year(as_of) < day_of_year(born)).cast("int")


def _day(as_of: dt.date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def age(c: Column | str, as_of: dt.date | str | Column | None = None) -> Column:
    """Age in full years from birth-date text, no range check; unreadable is null."""
    return _years_between(birth_date(c), _day(as_of))


_REST = r"((?:[ T].*?)?)\s*$"  # time of day, checked by the cast
_FULL = rf"^\s*{_D}[/.-]{_D}[/.-]{_Y}{_REST}"
_SHORT = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]" + "{y}" + _REST


def parse_ts(c: Column | str, dayfirst: bool = True, lenient: bool = True) -> Column:
    """Timestamp without zone from ISO or slash/dash/dot dates, with or without a time.

    Year-first text is read as it stands. Otherwise ``dayfirst`` sets the order; ``lenient`` takes
    the other order when the first gives no date (``08/17/1952``). The forms are tried from the
    most to the least common; a form that fits ends the search.
    """
    v = text(c)

    def read(pattern: str, iso: str) -> Column:
        return F.when(v.rlike(pattern), F.regexp_replace(v, pattern, iso).try_cast("timestamp_ntz"))

    day_month = [("$3-$2-$1$4", _FULL)]
    month_day = [("$3-$1-$2$4", _FULL)]
    for century, years in (("19", _OLD), ("20", _NEW)):
        day_month.append((century + "$3-$2-$1$4", _SHORT.replace("{y}", years)))
        month_day.append((century + "$3-$1-$2$4", _SHORT.replace("{y}", years)))
    first, second = (day_month, month_day) if dayfirst else (month_day, day_month)
    forms = [first[0], ("$1-$2-$3$4", rf"^\s*{_Y}[/.-]{_D}[/.-]{_D}{_REST}"), *first[1:]]
    if lenient:
        forms += second
    return F.coalesce(*[read(pattern, iso) for iso, pattern in forms])


def age_checked(
    c: Column | str, as_of: dt.date | str | Column | None = None, dayfirst: bool = True
) -> Column:
    """Age in full years, null outside 0 to 150."""
    years = _years_between(parse_ts(c, dayfirst).cast("date"), _day(as_of))
    inside = F.greatest(years, F.lit(0)) == F.least(years, F.lit(150))  # refers to it twice for sure
    return F.when(inside, years)


def date_br(c: Column | str, dayfirst: bool = True) -> Column:
    """Date text as ``dd/MM/yyyy``; blank gives empty text, unreadable text stays."""
    shown = F.date_format(parse_ts(c, dayfirst), "dd/MM/yyyy")
    return F.coalesce(shown, strip(c), F.lit(""))


def ts_br(c: Column | str) -> Column:
    """Timestamp as ``dd/MM/yyyy HH:mm:ss``; null gives empty text."""
    return F.coalesce(F.date_format(column(c), "dd/MM/yyyy HH:mm:ss"), F.lit(""))


def wall_micros(c: Column | str) -> Column:
    """Microseconds since 1970 by wall clock, the same in every session time zone."""
    since = column(c).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")
