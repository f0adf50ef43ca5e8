"""Scalar functions."""

from pyspark.sql import functions as F

from queries.registry import query, sql_br, sql_cpf, sql_digits
from roster import functions as R
from roster.operators import ages


def joined(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def br_text(c, places=2):
    """Brazilian text of a number column: 1.234,56."""
    return F.translate(F.format_number(c, places), ",.", ".,")


# person, company and phone ids: messy text made from clean keys

MESSY_ID = "c_custkey || '.' || c_nationkey || '-X'"


def messy_id(c="c_custkey"):
    return joined(F.col(c).cast("string"), ".", F.col("c_nationkey").cast("string"), "-X")


@query("cpf", f"SELECT c_custkey, {sql_cpf(MESSY_ID)} AS cpf FROM customer")
def _(t):
    return t.customer.select("c_custkey", R.cpf(messy_id()).alias("cpf"))


SPARSE = "CASE c_mktsegment WHEN 'BUILDING' THEN ' ' WHEN 'MACHINERY' THEN 'n/a' WHEN 'FURNITURE' THEN NULL ELSE {} END"


def sparse(value):
    """Text that is blank, without digits or missing in some segments."""
    kind = F.col("c_mktsegment")
    return (
        F.when(kind == "BUILDING", " ").when(kind == "MACHINERY", "n/a")
        .when(kind == "FURNITURE", F.lit(None)).otherwise(value)
    )


@query(
    "cpf_strict",
    f"""SELECT c_custkey, CASE WHEN coalesce(d, '') = '' THEN '' ELSE lpad(d, 11, '0') END AS cpf
    FROM (SELECT c_custkey, {sql_digits(SPARSE.format("c_custkey || '/' || c_name"))} AS d FROM customer)""",
)
def _(t):
    raw = sparse(joined(F.col("c_custkey").cast("string"), "/", F.col("c_name")))
    return t.customer.select("c_custkey", R.cpf_strict(raw).alias("cpf"))


MESSY_COMPANY = "c_nationkey || '.' || c_custkey || '/0001-' || c_nationkey"


def messy_company():
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    return joined(nation, ".", key, "/0001-", nation)


@query(
    "cnpj_forms",
    f"""WITH raw AS (SELECT c_custkey, {SPARSE.format(MESSY_COMPANY)} AS x FROM customer),
    d AS (SELECT *, {sql_digits("x")} AS d FROM raw)
    SELECT c_custkey,
      CASE WHEN coalesce(trim(x), '') = '' THEN '' ELSE lpad(d, 14, '0') END AS cnpj14,
      CASE WHEN length(d) = 14 THEN d END AS cnpj_valid,
      CASE WHEN coalesce(d, '') = '' THEN '' ELSE regexp_replace(lpad(d, 14, '0'),
        '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5') END AS cnpj_mask,
      coalesce(trim(x), '') AS cnpj_text
    FROM d""",
)
def _(t):
    raw = t.customer.select("c_custkey", sparse(messy_company()).alias("x"))
    return raw.select(
        "c_custkey", R.cnpj14("x").alias("cnpj14"), R.cnpj_valid("x").alias("cnpj_valid"),
        R.cnpj_mask("x").alias("cnpj_mask"), R.cnpj_text("x").alias("cnpj_text"),
    )


@query(
    "phone",
    f"""SELECT event_id, {sql_digits("'+55 (51) ' || user_id || '-' || event_id")} AS phone,
    coalesce({sql_digits("CASE WHEN event_type <> 'view' THEN '(51) ' || user_id END")}, '') AS dialled
    FROM events""",
)
def _(t):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    dialled = F.when(F.col("event_type") != "view", joined("(51) ", user))
    return t.events.select(
        "event_id", R.phone(joined("+55 (51) ", user, "-", event)).alias("phone"),
        R.phone(dialled, null_as_blank=True).alias("dialled"),
    )


@query(
    "phone_no_ddi",
    f"""SELECT event_id, CASE WHEN length(d) >= 12 AND d LIKE '55%' THEN substr(d, 3) ELSE d END AS phone
    FROM (SELECT event_id, {sql_digits("'55 ' || user_id || ' ' || event_id || CASE WHEN event_type IN ('click', 'view') THEN '00000000' ELSE '' END")} AS d FROM events)""",
)
def _(t):
    tail = F.when(F.col("event_type").isin("click", "view"), "00000000").otherwise("")
    raw = joined("55 ", F.col("user_id").cast("string"), " ", F.col("event_id").cast("string"), tail)
    return t.events.select("event_id", R.phone_no_ddi(raw).alias("phone"))


@query(
    "bank_code",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag
      WHEN 'A' THEN CAST(l_partkey AS VARCHAR) WHEN 'R' THEN '00' || l_partkey ELSE 'B.' || l_partkey END AS code
    FROM lineitem""",
)
def _(t):
    key, flag = F.col("l_partkey").cast("string"), F.col("l_returnflag")
    raw = F.when(flag == "A", joined(" ", key, ".0 ")).when(flag == "R", joined("00", key)).otherwise(joined("B.", key))
    return t.lineitem.select("l_orderkey", "l_linenumber", R.bank_code(raw).alias("code"))


# text

@query("slug", "SELECT p_partkey, translate(lower(p_brand || ' ' || p_type || '/' || p_name), ' /', '__') AS slug FROM part")
def _(t):
    raw = joined("  ", F.col("p_brand"), " ", F.col("p_type"), "/", F.col("p_name"), " ")
    return t.part.select("p_partkey", R.slug(raw).alias("slug"))


@query(
    "company_key",
    """SELECT doc_id, md5(trim(regexp_replace(translate(replace(strip_accents(upper(replace(text, 'ß', 'SS'))), '.', ''), '-,&', '   '),
    '\\s+', ' ', 'g'))) AS key_hash FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.md5(R.company_key("text").cast("binary")).alias("key_hash"))


@query("fix_mojibake", "SELECT doc_id, md5(text) AS text_hash FROM documents")
def _(t):
    """Texts decoded with the wrong charset on purpose come back as they were."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    fixed = t.documents.select("doc_id", R.fix_mojibake(broken).alias("text"))
    return fixed.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"))


@query(
    "strip_quotes",
    """SELECT page_id, md5(replace(html, '"', '')) AS html_hash FROM pages""",
)
def _(t):
    return t.pages.select("page_id", F.md5(R.strip_quotes("html").cast("binary")).alias("html_hash"))


# numbers

@query("parse_br_number", "SELECT l_orderkey, l_linenumber, l_extendedprice AS value FROM lineitem")
def _(t):
    flag = F.col("l_returnflag")
    raw = (
        F.when(flag == "A", joined("R$ ", br_text("l_extendedprice")))
        .when(flag == "R", joined(" $", F.format_string("%.2f", "l_extendedprice")))
        .otherwise(br_text("l_extendedprice"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", R.parse_br_number(raw).alias("value"))


@query(
    "excel_number",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN '' ELSE
    printf('%.2f', l_extendedprice * l_tax) END AS value FROM lineitem""",
)
def _(t):
    from roster.operators.shape import apply_excel_numbers

    amount = F.col("l_extendedprice") * F.col("l_tax")
    raw = F.when(F.col("l_returnflag") == "N", "n/d").otherwise(amount.cast("decimal(38,18)").cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", raw.alias("value"))
    return apply_excel_numbers(rows, ["value"])


@query(
    "to_float_capped",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 0.0::DOUBLE ELSE o_totalprice END AS value
    FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", R.to_float_capped(br_text("o_totalprice")).alias("value"))


@query(
    "br_money",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0,00' WHEN 'O' THEN 'pend.'
    ELSE replace(printf('%.2f', o_totalprice), '.', ',') END AS "Saldo_5" FROM orders""",
)
def _(t):
    from roster.operators.shape import normalize_money

    status = F.col("o_orderstatus")
    raw = F.when(status == "F", " ").when(status == "O", "pend.").otherwise(br_text("o_totalprice"))
    return normalize_money(t.orders.select("o_orderkey", raw.alias("Saldo_5")))


@query(
    "price3",
    """SELECT l_orderkey, l_linenumber, replace(printf('%.3f', CAST(printf('%.4f', l_extendedprice * l_tax) AS DOUBLE)),
    '.', ',') AS price FROM lineitem""",
)
def _(t):
    raw = F.translate(R.fixed(F.col("l_extendedprice") * F.col("l_tax"), 4), ".", ",")
    return t.lineitem.select("l_orderkey", "l_linenumber", R.price3(raw).alias("price"))


@query(
    "decimal_br",
    """SELECT event_id, replace(regexp_replace(printf('%.12f', value), '\\.?0+$', ''), '.', ',') AS price FROM events""",
)
def _(t):
    return t.events.select("event_id", R.decimal_br(F.format_string("%.4f", "value")).alias("price"))


@query("int_br", "SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1000), ',', '.') AS shown FROM orders")
def _(t):
    return t.orders.select("o_orderkey", R.int_br(F.col("o_orderkey") * 1000).alias("shown"))


@query(
    "money_br",
    f"""SELECT c_custkey, CASE WHEN x < 0 THEN 'R$ -' ELSE 'R$ ' END || {sql_br("abs(x)", 3)} AS shown
    FROM (SELECT c_custkey, c_acctbal - 5000.0 AS x FROM customer)""",
)
def _(t):
    return t.customer.select("c_custkey", R.money_br(F.col("c_acctbal") - 5000.0).alias("shown"))


@query(
    "tariff",
    """SELECT event_id, CASE WHEN value >= 1 THEN greatest(0.025::DOUBLE, value / 60.0::DOUBLE * 0.05::DOUBLE)
    ELSE 0.0::DOUBLE END AS charge FROM events""",
)
def _(t):
    return t.events.select("event_id", R.tariff("value").alias("charge"))


@query(
    "duration_text",
    """SELECT o_orderkey, printf('%02d:%02d:%02d:%02d:%02d:%02d', s // 2592000, s % 2592000 // 604800,
      s % 2592000 % 604800 // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) AS shown
    FROM (SELECT o_orderkey, CAST(round_even(o_totalprice * 10, 0) AS BIGINT) AS s FROM orders)""",
)
def _(t):
    return t.orders.select("o_orderkey", R.duration_text(F.col("o_totalprice") * 10).alias("shown"))


# dates: the order date written in a form that depends on the priority

FORMS = {
    "1-URGENT": ("dd/MM/yyyy", "%d/%m/%Y"), "2-HIGH": ("dd-MM-yyyy", "%d-%m-%Y"),
    "3-MEDIUM": ("yyyy-MM-dd", "%Y-%m-%d"), "4-NOT SPECIFIED": ("dd/MM/yy", "%d/%m/%y"),
    "5-LOW": ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
}
AS_OF = "2024-06-30"
SQL_AGE = f"""(2024 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0630' THEN 1 ELSE 0 END)::INTEGER"""


def date_text(c="o_orderdate"):
    shown = F.lit(None).cast("string")
    for priority, (form, _) in FORMS.items():
        shown = F.when(F.col("o_orderpriority") == priority, F.date_format(c, form)).otherwise(shown)
    return shown


@query("age", f"SELECT o_orderkey, {SQL_AGE} AS idade FROM orders")
def _(t):
    dated = t.orders.select("o_orderkey", date_text().alias("nasc"))
    return ages.add_age(dated, "nasc", AS_OF).select("o_orderkey", "idade")


@query(
    "age_checked",
    f"SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'P' THEN {SQL_AGE} END AS DOUBLE) AS idade FROM orders",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "P", "1790-01-01").otherwise(date_text())
    dated = t.orders.select("o_orderkey", raw.alias("nasc"))
    return ages.add_age_checked(dated, "nasc", AS_OF).select("o_orderkey", F.col("idade").cast("double"))


@query("refresh_age", f"SELECT o_orderkey, {SQL_AGE} AS \"Idade\" FROM orders")
def _(t):
    dated = t.orders.select("o_orderkey", date_text().alias("Data_Nascimento"), F.lit("?").alias("Idade"))
    return ages.refresh_age(dated, as_of=AS_OF).select("o_orderkey", "Idade")


@query(
    "date_br",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'sem data' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day
    FROM orders""",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "P", " sem data ").otherwise(date_text())
    return ages.format_date_column(t.orders.select("o_orderkey", raw.alias("day")), "day")


@query(
    "parse_ts",
    """SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS day_first, strftime(ts, '%d/%m/%Y %H:%M:%S') AS month_first,
    epoch_us(date_trunc('second', ts)) AS micros FROM events""",
)
def _(t):
    brazil, us = F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
    return t.events.select(
        "event_id",
        R.ts_br(R.parse_ts(brazil)).alias("day_first"),
        R.ts_br(R.parse_ts(us, dayfirst=False)).alias("month_first"),
        R.wall_micros(R.parse_ts(brazil)).alias("micros"),
    )
