"""Bank names by code and banks with branches. Nations stand in for banks."""

from pyspark.sql import functions as F

from queries.functions import joined
from queries.registry import query
from roster.operators import dedupe, enrich, reports


def base(t):
    """Customers with a bank code as text; some codes come as ``7.0``."""
    code = F.col("c_nationkey").cast("string")
    return t.customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", joined(code, ".0")).otherwise(code).alias("Codigo_Banco")
    )


def primary(t):
    """The register: banks of the first three regions."""
    code = F.col("n_nationkey").cast("string")
    return t.nation.where("n_regionkey <= 2").select(
        code.alias("Código COMPE"), F.col("n_name").alias("Banco"), joined("Banco ", F.col("n_name")).alias("Nome Completo"),
        F.lpad(code, 8, "0").alias("ISPB"), F.col("n_nationkey").alias("line"),
    )


def fallback(t):
    """The short table: every bank of regions 1 to 3, twice, the second time under another name."""
    banks = t.nation.where("n_regionkey BETWEEN 1 AND 3").select(
        F.col("n_nationkey").cast("string").alias("Código COMPE"), F.col("n_name").alias("Banco"), F.lit("").alias("Site"),
        F.col("n_nationkey").alias("line"),
    )
    return banks.unionByName(banks.withColumns({"Banco": joined(F.col("Banco"), " S.A."), "line": F.col("line") + 100}))


@query(
    "bank_last_wins",
    """SELECT c_custkey, CASE WHEN n_regionkey BETWEEN 1 AND 3 THEN n_name || ' S.A.' END AS nome_banco
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    named = enrich.bank_names(base(t), fallback(t), "Codigo_Banco", "Código COMPE", "Banco", "line")
    return named.select("c_custkey", "nome_banco")


LAYERED = """SELECT c_custkey, c_nationkey,
  CASE WHEN n_regionkey <= 2 THEN n_name WHEN n_regionkey = 3 THEN n_name || ' S.A.' ELSE '' END AS nome_banco,
  CASE WHEN n_regionkey <= 2 THEN 'Banco ' || n_name WHEN n_regionkey = 3 THEN n_name || ' S.A.' ELSE '' END AS nome_completo_banco,
  CASE WHEN n_regionkey <= 2 THEN lpad(CAST(n_nationkey AS VARCHAR), 8, '0') ELSE '' END AS ispb,
  CASE WHEN n_regionkey <= 2 THEN 'BRASIL_API' WHEN n_regionkey = 3 THEN 'CSV_LOCAL' ELSE '' END AS fonte_informacao
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def layered(t):
    return enrich.bank_names_layered(base(t), primary(t), fallback(t), "Codigo_Banco", "line")


@query("bank_layered", f"SELECT * EXCLUDE (c_nationkey) FROM ({LAYERED})")
def _(t):
    return layered(t).drop("Codigo_Banco")


@query("bank_one_source", f"SELECT c_custkey, CASE WHEN fonte_informacao = 'BRASIL_API' THEN nome_banco ELSE '' END AS nome_banco, ispb FROM ({LAYERED})")
def _(t):
    named = enrich.bank_names_layered(base(t), primary(t), None, "Codigo_Banco", "line", tag_source=False)
    return named.select("c_custkey", "nome_banco", "ispb")


@query(
    "lookup_coverage",
    f"""SELECT fonte_informacao, count(*) AS rows, count(nullif(nome_banco, '')) AS rows_with_name,
    count(*) - count(nullif(nome_banco, '')) AS rows_without_name, count(DISTINCT c_nationkey) AS codes FROM ({LAYERED}) GROUP BY 1""",
)
def _(t):
    return reports.lookup_coverage(layered(t), "Codigo_Banco")


@query("codes_not_found", f"SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS key FROM ({LAYERED}) WHERE nome_banco = ''")
def _(t):
    return reports.codes_without_name(layered(t), "Codigo_Banco")


def agencies(t):
    """Branches: suppliers with a state, a bank code in one of two columns and a name."""
    code = F.col("s_nationkey").cast("string")
    return t.supplier.select(
        F.when(F.col("s_suppkey") >= 0, joined(F.col("s_name"), "/", F.when(F.col("s_acctbal") < 5000, "rs").otherwise("sp"))).alias("MunicipioUf"),
        F.when(F.col("s_acctbal") > 1000, code).otherwise(" ").alias("CodigoCompe"),
        F.when(F.col("s_acctbal") > 500, joined(code, "")).otherwise("x9").alias("Codigo"),
        F.col("s_name").alias("NomeIf"), "s_suppkey",
    )


@query(
    "branch_banks",
    """SELECT CAST(s_nationkey AS VARCHAR) AS codigo_banco, min_by(s_name, s_suppkey) AS nome_banco FROM supplier
    WHERE s_acctbal < 5000 AND s_acctbal > 500 GROUP BY 1""",
)
def _(t):
    return dedupe.branch_banks(agencies(t), "s_suppkey", "RS")


@query(
    "branch_banks_all",
    """SELECT CAST(s_nationkey AS VARCHAR) AS codigo_banco, min_by(s_name, s_suppkey) AS nome_banco FROM supplier
    WHERE s_acctbal > 500 GROUP BY 1""",
)
def _(t):
    return dedupe.branch_banks(agencies(t), "s_suppkey")
