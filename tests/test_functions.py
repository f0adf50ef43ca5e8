import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roster import functions as R
from roster.operators import links, shape

CASES = [
    (R.cpf, ["123", "529.982.247-25", "", None, "123456789012", "１２3", "x"],
     ["00000000123", "52998224725", "00000000000", None, "123456789012", "00000000123", "00000000000"]),
    (lambda c: R.cpf(c, blank_is_null=True), ["", "x", "7"], [None, None, "00000000007"]),
    (R.cpf_strict, ["123", "", None, "x", "123456789012", "0"],
     ["00000000123", "", "", "", "12345678901", "00000000000"]),
    (R.cnpj14, ["12", " ", None, "abc", "123456789012345"],
     ["00000000000012", "", "", "00000000000000", "12345678901234"]),
    (R.cnpj_valid, ["11.222.333/0001-81", "123", None], ["11222333000181", None, None]),
    (R.cnpj_mask, ["11222333000181", "nan", "", None, "１１222333000181"],
     ["11.222.333/0001-81", "", "", "", "11.222.333/0001-81"]),
    (R.cnpj_text, [" 1 ", None], ["1", ""]),
    (R.phone, ["(51) 9-88", None, "x"], ["51988", None, ""]),
    (R.phone_no_ddi, ["5551987654321", "551234567890", "5512345", None, "5151987654321"],
     ["51987654321", "1234567890", "5512345", "", "5151987654321"]),
    (R.slug, [" São Paulo/SP\\x "], ["são_paulo_sp_x"]),
    (R.company_key, [" São João & Cia. Ltda - ME ", "a.b,c", None, "  ", "é"],
     ["SAO JOAO CIA LTDA ME", "AB C", "", "", "E"]),
    (R.bank_code, ["626.0", " 001 ", "x.y", None, "1.9", "237"], ["626", "001", "x.y", None, "1", "237"]),
    (R.fix_mojibake, ["AÃ§Ã£o", "Ã‡a", "Ação", "Â£", None, "Ã"], ["Ação", "Ça", "Ação", "£", None, "Ã"]),
    (R.strip_quotes, ['a""b"', "nan", None], ["ab", "", ""]),
    (R.parse_br_number, ["1.456,00", "R$ 1.456,7", "$12", "1456.00", "nan", "", "1_0", "inf", "1d", "1.2.3"],
     [1456.0, 1456.7, 12.0, 1456.0, None, None, None, None, None, None]),
    (R.excel_number, ["1.456,00", "x", "2,675", "-0,001"], ["1456.00", "", "2.67", "-0.00"]),
    (R.to_float_capped, ["100000", "100000,01", "", None, "x", "1.234,5", "-200000"],
     [100000.0, 0.0, 0.0, 0.0, 0.0, 1234.5, 0.0]),
    (R.br_money2, ["", None, "1.234,5", "12.5", "abc", "nan", "1000000"],
     ["0,00", "0,00", "1234,50", "12,50", "abc", "nan", "1000000,00"]),
    (R.price3, ["0,0125", "1.456,00", "0.0375", "2"], ["0,013", "", "0,037", "2,000"]),
    (R.decimal_br, ["0.0250", "-0", "12", "x", "100"], ["0,025", "0", "12", "", "100"]),
    (R.decimal_comma, ["1.5", None, "nan"], ["1,5", "", ""]),
    (R.date_br, ["1952-08-17 00:00:00", "03/04/1990", "", None, "x", "1990/3/4", " 1-2-1990 "],
     ["17/08/1952", "03/04/1990", "", "", "x", "04/03/1990", "01/02/1990"]),
    (lambda c: R.date_br(c, dayfirst=False), ["03/04/1990"], ["04/03/1990"]),
    (lambda c: R.age(c, "2024-02-28"), ["29/02/2000", "28-02-2000", "17/08/52", "68/01/02", "30/02/1990", "99-12-31"],
     [23, 24, -29, -44, None, 24]),
    (lambda c: R.age_checked(c, "2024-06-30"), ["01/07/2024", "30/06/2024", "1873-01-01", "x", "08/17/1952"],
     [None, 0, None, None, 71]),
]


@pytest.mark.parametrize("function, values, expected", CASES)
def test_golden_values(apply, function, values, expected):
    assert apply(function, values) == expected


def test_numbers_as_text(apply):
    assert apply(R.money_br, [72262.262, -1234.5, None, 0.0], "double") == ["R$ 72.262,262", "R$ -1.234,500", "—", "R$ 0,000"]
    assert apply(R.int_br, [63416, None, 5], "bigint") == ["63.416", "—", "5"]
    assert apply(R.tariff, [45.0, 0.5, None, 10.0], "double") == [(45 / 60) * 0.05, 0.0, 0.0, 0.025]
    assert apply(R.duration_text, [8278.0, 2.5, -5.0, None], "double") == [
        "00:00:00:02:17:58", "00:00:00:00:00:02", "00:00:00:00:00:00", "—",
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.floats(-1e9, 1e9, allow_nan=False).filter(lambda v: v != 0),
            st.integers(-10**7, 10**7).filter(bool).map(lambda n: n / 1000),
            st.integers(1, 10**6).map(lambda n: n / 16),
        ),
        min_size=50, max_size=200,
    )
)
def test_fixed_rounds_like_exact_formatting(apply, values):
    for places in (0, 2, 3):
        assert apply(lambda c: R.fixed(c, places), values, "double") == [f"{v:.{places}f}" for v in values]
    assert apply(lambda c: R.rounded(c, 2), values, "double") == [round(v, 2) for v in values]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(10**9, 9 * 10**11), st.integers(0, 99), st.booleans()), min_size=50, max_size=200))
def test_large_ties_round_like_exact_formatting(apply, parts):
    twos = [(n * 10 + (n % 10) + (c + 0.5) / 100) * (-1 if s else 1) for n, c, s in parts]
    assert apply(lambda c: R.fixed(c, 2), twos, "double") == [f"{v:.2f}" for v in twos]
    threes = [(n + (c + 0.5) / 1000) * (-1 if s else 1) for n, c, s in parts]
    assert apply(lambda c: R.fixed(c, 3), threes, "double") == [f"{v:.3f}" for v in threes]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(dt.datetime(1969, 1, 1), dt.datetime(2068, 12, 31)), min_size=30, max_size=100))
def test_dates_are_read_in_every_form(apply, moments):
    days = [m.date() for m in moments]
    for form in ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%y", "%d-%m-%y"):
        texts = [m.strftime(form) for m in moments]
        assert apply(R.birth_date, texts) == days
        assert [t.date() for t in apply(R.parse_ts, texts)] == days
    assert apply(R.parse_ts, [m.strftime("%d/%m/%Y %H:%M:%S.%f") for m in moments]) == moments


def test_wall_clock_does_not_depend_on_the_zone(spark):
    moment = spark.sql("SELECT timestamp_ntz'2018-11-04 00:30:00.5' AS t")
    seen = set()
    for zone in ("America/Sao_Paulo", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.add(moment.select(R.wall_micros("t")).first()[0])
    assert len(seen) == 1


def test_alpha_names():
    assert [shape.alpha_name(i) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_id_columns_by_whole_word():
    names = ["Telefone 1", "codigo_banco", "cidade", "idade", "Margem_RMC", "id_cliente", "CPF", "num"]
    assert shape.id_columns(names) == ["Telefone 1", "codigo_banco", "id_cliente", "CPF", "num"]


def test_links(apply):
    assert apply(links.drive_id, ["https://drive.google.com/file/d/a-B_1/view", "x?id=9&y", "/drive/folders/F1", "none"]) == ["a-B_1", "9", "F1", None]
    assert apply(links.is_folder, ["/drive/folders/x", "/file/d/x"]) == [True, False]
    assert apply(links.strip_query, ["a?b?c", "a"]) == ["a", "a"]
    assert apply(links.site_url_ok, ["https://sites.google.com/x", "ftp://sites.google.com", None]) == [True, False, False]
    assert apply(links.page_title, ["<TITLE> x </TITLE>", "<title></title>", "no"]) == ["x", links.UNTITLED, links.UNTITLED]
    assert apply(links.mentions_bank, ["Convênio Itau", "outro", None]) == [True, False, False]


def test_no_function_needs_python(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("x"))
    plan = rows.select(R.cpf("x"), R.price3("x"), R.company_key("x"), R.age("x"), R.fix_mojibake("x"))
    assert "Python" not in plan._jdf.queryExecution().toString()
