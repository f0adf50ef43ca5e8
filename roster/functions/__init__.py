"""Column expressions; none of them needs a Python worker."""

from roster.functions.dates import (
    age, age_checked, birth_date, date_br, parse_ts, ts_br, wall_micros,
)
from roster.functions.ids import (
    bank_code, cnpj14, cnpj_mask, cnpj_text, cnpj_valid, cpf, cpf_strict, digits, phone, phone_no_ddi,
)
from roster.functions.numbers import (
    br_money2, decimal_br, decimal_comma, duration_text, excel_number, fixed, int_br, money_br,
    parse_br_number, parse_decimal, plain_number, price3, rounded, tariff, to_float_capped,
)
from roster.functions.text import (
    blank_to_null, column, company_key, fix_mojibake, is_blank, slug, strip, strip_accents,
    strip_quotes, text, windows_1252,
)

__all__ = [name for name in dir() if not name.startswith("_")]
