"""Column selection, layouts, unions and value clean-up."""

from pyspark.sql import functions as F

from queries.functions import joined
from queries.registry import query
from roster.operators import merge, shape


@query(
    "keep_alpha",
    """SELECT p_partkey AS "A", p_brand AS "B", p_retailprice AS "C" FROM part""",
)
def _(t):
    return shape.keep_columns_alpha(t.part, ["p_retailprice", "p_partkey", "p_brand"])


@query("identifier_to_cpf", """SELECT CAST(c_custkey AS VARCHAR) AS "CPF" FROM customer""")
def _(t):
    return shape.identifier_to_cpf(t.customer.select("c_name", F.col("c_custkey").cast("string").alias("identifier")))


LAYOUT_SOURCE = {  # layout column: customer column
    "CEL1": "c_custkey", "Nome": "c_name", "CPF": "c_custkey", "UF": "c_nationkey", "Valor_Parcela": "c_acctbal",
    "Municipio": "c_mktsegment",
}


@query(
    "conform_layout",
    "SELECT " + ", ".join(
        f"""{LAYOUT_SOURCE.get(c, "''")} AS "{c}" """ for c in shape.INSS_LAYOUT
    ) + " FROM customer",
)
def _(t):
    rows = t.customer.select(
        F.lit("x").alias("extra"),
        *[
            F.col(LAYOUT_SOURCE[c]).alias(c) if c in LAYOUT_SOURCE else F.lit("").alias(c)
            for c in sorted(shape.INSS_LAYOUT) if c != "nome_banco"
        ],
    )
    return shape.conform_layout(rows)


@query("map_columns", """SELECT c_name AS "Nome", c_acctbal AS "Saldo", '' AS "UF" FROM customer""")
def _(t):
    return shape.map_columns(t.customer, {"Nome": "c_name", "Saldo": "c_acctbal", "Fone": "", "UF": "c_state"})


@query(
    "mapping_report",
    """SELECT 'Nome' AS model_column, 'c_name' AS data_column, count(*) AS rows, count(nullif(c_name, '')) AS filled FROM customer
    UNION ALL SELECT 'Fone', NULL, count(*), 0 FROM customer
    UNION ALL SELECT 'UF', 'c_state', count(*), 0 FROM customer""",
)
def _(t):
    return shape.mapping_report(t.customer, ["Nome", "Fone", "UF"], {"Nome": "c_name", "UF": "c_state"})


@query("add_constant", "SELECT c_custkey, 'lote 7' AS c_mktsegment, 'x' AS origem FROM customer")
def _(t):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return shape.add_constant(shape.add_constant(rows, "c_mktsegment", "lote 7"), "origem", "x")


@query(
    "clean_id_columns",
    """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS "Telefone 1",
      c_custkey || '.05' AS codigo_banco, c_custkey || '.0' AS cidade FROM customer""",
)
def _(t):
    key = F.col("c_custkey").cast("string")
    rows = t.customer.select(
        F.when(F.col("c_mktsegment") == "BUILDING", "nan").otherwise(joined(key, ".0")).alias("Telefone 1"),
        joined(key, ".05").alias("codigo_banco"),
        joined(key, ".0").alias("cidade"),
    )
    return shape.clean_id_columns(rows)


@query(
    "decimal_comma",
    """SELECT event_id, replace(printf('%.2f', value), '.', ',') AS value FROM events""",
)
def _(t):
    rows = t.events.select("event_id", F.format_string("%.2f", "value").alias("value"))
    return shape.decimal_comma_columns(rows, ["value"])


@query(
    "merge_sources",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, '' AS balance FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', printf('%.2f', s_acctbal) FROM supplier""",
)
def _(t):
    first = t.customer.select(
        joined(F.col("c_custkey").cast("string"), ".0").alias("id"), joined('"', F.col("c_name"), '"').alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    second = t.supplier.select(
        F.format_string("%.2f", "s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return merge.merge_sources([first, second])
