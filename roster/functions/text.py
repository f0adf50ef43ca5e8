"""Text clean-up as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text strip removes (Unicode white space).
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def column(c: Column | str) -> Column:
    """Column for a name (dots and spaces in the name allowed) or a Column as it is."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return column(c).cast("string")


def strip(c: Column | str) -> Column:
    return F.btrim(text(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only values."""
    return F.coalesce(strip(c) == "", F.lit(True))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def slug(c: Column | str) -> Column:
    """File-name form of a value: lower case, stripped, spaces and slashes become ``_``."""
    return F.translate(strip(F.lower(text(c))), " /\\", "___")


def strip_quotes(c: Column | str) -> Column:
    """Remove every double quote; the text ``nan`` and null become empty."""
    plain = F.replace(text(c), F.lit('"'), F.lit(""))
    return F.when(plain.isNull() | (plain == "nan"), "").otherwise(plain)


def _latin_accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from canonical decomposition."""
    accented, base = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        plain = "".join(
            ch for ch in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(ch) != "Mn"
        )
        if len(plain) == 1 and plain != chr(code):
            accented.append(chr(code))
            base.append(plain)
    return "".join(accented), "".join(base)


def strip_accents(c: Column | str) -> Column:
    """Drop accents: pre-composed Latin letters by table, loose combining marks by class."""
    accented, base = _latin_accents()
    return F.regexp_replace(F.translate(text(c), accented, base), r"\p{Mn}", "")


def company_key(c: Column | str) -> Column:
    """Comparable company name: upper case, no accents, dots gone, ``- , &`` to single spaces."""
    bare = F.translate(strip_accents(F.upper(strip(c))), "-,&.", "   ")
    squeezed = strip(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.coalesce(squeezed, F.lit(""))


def _single_byte_marks() -> tuple[str, str]:
    """Characters that windows-1252 puts at 0x80-0x9F and the latin-1 characters of those bytes."""
    shown, raw = [], []
    for byte in range(0x80, 0xA0):
        try:
            shown.append(bytes([byte]).decode("cp1252"))
        except UnicodeDecodeError:
            continue
        raw.append(chr(byte))
    return "".join(shown), "".join(raw)


def windows_1252(c: Column | str) -> Column:
    """Text read as ISO-8859-1 with the characters windows-1252 has at 0x80-0x9F."""
    shown, raw = _single_byte_marks()
    return F.translate(text(c), raw, shown)


def fix_mojibake(c: Column | str) -> Column:
    """Repair UTF-8 text that was read as a single-byte charset; anything else stays as it is."""
    value = text(c)
    shown, raw = _single_byte_marks()
    single = F.translate(value, shown, raw)
    suspect = single.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~single.rlike("[^\u0000-\u00ff]")
    repaired = F.try_validate_utf8(F.encode(single, "ISO-8859-1").cast("string"))
    return F.when(suspect, F.coalesce(repaired, value)).otherwise(value)
