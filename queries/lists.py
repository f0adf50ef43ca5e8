"""Deny lists, allow lists and enrichment by id or name."""

from pyspark.sql import functions as F

from queries.functions import joined
from queries.registry import query
from roster import functions as R
from roster.operators import enrich, lists


def person(name, tail=""):
    return joined(F.col(name).cast("string"), tail)


def customers(t):
    return t.customer.withColumn("cpf", person("c_custkey", "-X"))


def finished(t):
    """Ids of customers with a finished order, many of them repeated."""
    return t.orders.where("o_orderstatus = 'F'").select(person("o_custkey", " ").alias("CPF"))


def sided(marked, flag="denied", names=("kept", "denied")):
    return marked.withColumn("side", F.when(F.col(flag), names[1]).otherwise(names[0]))


FINISHED = "c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
SIDES = f"SELECT c_custkey, c_acctbal, CASE WHEN {FINISHED} THEN '{{}}' ELSE '{{}}' END AS side FROM customer"


@query("deny_split", SIDES.format("denied", "kept"))
def _(t):
    return sided(lists.mark_denied(customers(t), finished(t), "cpf", "CPF")).select("c_custkey", "c_acctbal", "side")


@query(
    "deny_split_null_ids",
    """WITH ids AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k IS NULL OR k IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    THEN 'denied' ELSE 'kept' END AS side FROM ids""",
)
def _(t):
    """Two rows in three have no id; the deny list has missing ids too, which match them."""
    base = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", person("o_custkey")).alias("cpf"))
    deny = t.customer.select(F.when(F.col("c_mktsegment") == "BUILDING", person("c_custkey")).alias("cpf"))
    return sided(lists.mark_denied(base, deny, "cpf", "cpf")).select("o_orderkey", "side")


@query("deny_marked", f"SELECT c_custkey, {FINISHED} AS listed FROM customer")
def _(t):
    """Both sides in one pass, as a flag."""
    marked = lists.mark_listed(customers(t), [R.cpf("cpf")], finished(t), [R.cpf("CPF")])
    return marked.select("c_custkey", "listed")


@query("deny_split_folder", SIDES.format("denied", "kept"))
def _(t):
    """A folder of two lists: one has ``CPF``, the other ``identifier``."""
    base = t.customer.withColumn("CPF", person("c_custkey"))
    ids = finished(t)
    odd = F.col("CPF").rlike("[13579] $")
    deny = [ids.where(odd), ids.where(~odd).select(F.col("CPF").alias("identifier"), F.lit("x").alias("other"))]
    return sided(lists.mark_denied_folder(base, deny)).select("c_custkey", "c_acctbal", "side")


@query("allow_split", SIDES.format("listed", "absent"))
def _(t):
    marked = lists.mark_allowed(customers(t), finished(t), "cpf", "CPF")
    return sided(marked, "allowed", ("absent", "listed")).select("c_custkey", "c_acctbal", "side")


@query("remove_cnpj", f"SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT {FINISHED}")
def _(t):
    """Blank ids stay although the list has blank ids."""
    own = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(person("c_custkey", "/0001"))
    deny = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", person("o_custkey", ".0001")).otherwise("").alias("cnpj")
    )
    kept = lists.remove_by_cnpj(t.customer.withColumn("cnpj", own), deny, "cnpj", "cnpj")
    return kept.select("c_custkey", "c_name")


@query(
    "remove_phone",
    """SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000 OR s_suppkey NOT IN
    (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)""",
)
def _(t):
    own = F.when(F.col("s_acctbal") >= 1000, joined("(51) ", person("s_suppkey")))
    deny = t.lineitem.where("l_returnflag = 'R' AND l_quantity = 50").select(joined("51-", person("l_suppkey")).alias("fone"))
    kept = lists.remove_by_phone(t.supplier.withColumn("fone", own), deny, "fone", "fone")
    return kept.select("s_suppkey")


@query(
    "remove_number",
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)",
)
def _(t):
    base = t.orders.withColumn("numero", person("o_custkey", "  "))
    deny = t.customer.where("c_acctbal < 2000").select(person("c_custkey").alias("numero"))
    return lists.remove_by_number_batch(base, deny, "numero", "numero").select("o_orderkey")


@query(
    "denied_numbers_report",
    """WITH m AS (SELECT o_orderpriority, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) AS hit FROM orders)
    SELECT o_orderpriority AS source_file, count(*) AS rows_in, count(*) FILTER (WHERE NOT hit) AS rows_kept,
      count(*) FILTER (WHERE hit) AS rows_removed, count(DISTINCT CASE WHEN hit THEN o_custkey END) AS numbers_removed,
      count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*) AS rate FROM m GROUP BY 1""",
)
def _(t):
    base = t.orders.select(F.col("o_orderpriority").alias("source_file"), person("o_custkey", " ").alias("numero"))
    deny = t.customer.where("c_acctbal < 2000").select(person("c_custkey").alias("numero"))
    return lists.denied_numbers_report(base, deny, "numero", "numero")


@query(
    "mask_numbers",
    """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN (l_orderkey, l_partkey) IN
      (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN '-' ELSE CAST(l_partkey AS VARCHAR) END AS numero
    FROM lineitem""",
)
def _(t):
    rows = t.lineitem.withColumns({"cpf": person("l_orderkey", "-"), "numero": person("l_partkey")})
    deny = t.lineitem.where("l_returnflag = 'R'").select(person("l_orderkey").alias("cpf"), person("l_partkey").alias("numero"))
    masked = lists.mask_denied_numbers(rows, deny, "cpf", "numero", "cpf", "numero")
    return masked.select("l_orderkey", "l_linenumber", "l_suppkey", "numero")


@query(
    "removed_keys",
    "SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def _(t):
    before = t.orders.select(person("o_custkey").alias("cpf"))
    after = t.orders.where("o_orderstatus = 'F'").select(person("o_custkey").alias("cpf"))
    return lists.removed_keys(before, after, "cpf")


@query(
    "union_keys",
    """SELECT lpad(CAST(k AS VARCHAR), 11, '0') AS key FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
    UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_suppkey FROM supplier)""",
)
def _(t):
    parts = [
        t.orders.where("o_orderstatus = 'F'").select(person("o_custkey").alias("cpf")),
        t.customer.select(F.when(F.col("c_acctbal") < 0, person("c_custkey")).alias("cpf")),
        t.supplier.select(person("s_suppkey", ".").alias("cpf")),
    ]
    return lists.union_keys(parts, "cpf")


# enrichment

@query(
    "enrich_matched",
    """SELECT c_custkey, c_acctbal AS value_x, o_orderkey, o_totalprice AS value_y FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def _(t):
    base = t.customer.select("c_custkey", person("c_custkey", "-X").alias("cpf"), F.col("c_acctbal").alias("value"))
    data = t.orders.select(person("o_custkey").alias("id"), "o_orderkey", F.col("o_totalprice").alias("value"))
    matched, _ = enrich.enrich_by_cpf(base, data, "cpf", "id")
    return matched.select("c_custkey", "value_x", "o_orderkey", "value_y")


@query("enrich_unmatched", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    base = t.customer.select("c_custkey", person("c_custkey", "-X").alias("cpf"))
    _, unmatched = enrich.enrich_by_cpf(base, finished(t).withColumn("x", F.lit(1)), "cpf", "CPF")
    return unmatched.select("c_custkey")


@query(
    "enrich_first",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey""",
)
def _(t):
    data = t.orders.select(person("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    matched, _ = enrich.enrich_by_cpf(customers(t), data, "cpf", "id", dedup_by=["o_orderkey"])
    return matched.select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "company_join",
    """SELECT lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS "CNPJ", o_orderkey, c_name, c_mktsegment FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 3000) ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""",
)
def _(t):
    """Short ids are invalid on both sides; customers below the balance have a short id."""
    ids = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", "12").otherwise(F.lpad(person("o_custkey"), 14, "0")).alias("CNPJ"), "o_orderkey"
    )
    data = t.customer.select(
        F.when(F.col("c_acctbal") >= 3000, F.lpad(person("c_custkey"), 14, "0")).otherwise("7").alias("nr_cnpj"), "c_name", "c_mktsegment"
    )
    return enrich.join_companies(ids, data).drop("nr_cnpj")


IDS = """ids AS (SELECT upper(p_name) AS k, p_type AS id, min(p_partkey) AS f FROM part GROUP BY 1, 2)"""
PART_KEY = "upper(p_name)"


def names_to_fill(t):
    """Part names as company names, with a few that have no match."""
    name = F.when(F.col("p_size") == 1, joined("no-", F.col("p_name"))).otherwise(joined(" ", F.col("p_name"), "."))
    return t.part.select("p_partkey", name.alias("company"), F.when(F.col("p_brand") == "Brand#2", "old").otherwise("").alias("CNPJ"))


FILL_NAME = "CASE WHEN p_size = 1 THEN 'NO ' || upper(p_name) ELSE upper(p_name) END"


@query(
    "fill_by_name",
    f"""WITH {IDS}, cells AS (SELECT k, string_agg(id, '; ' ORDER BY f) AS cell FROM ids GROUP BY 1)
    SELECT p_partkey, coalesce(cell, CASE WHEN p_brand = 'Brand#2' THEN 'old' ELSE '' END) AS "CNPJ"
    FROM part LEFT JOIN cells ON k = {FILL_NAME}""",
)
def _(t):
    filled = enrich.fill_cnpj_by_name(names_to_fill(t), t.part, "company", "p_name", "p_type", "p_partkey")
    return filled.select("p_partkey", "CNPJ")


@query(
    "split_match_count",
    f"""WITH {IDS}, n AS (SELECT k, count(*) AS n FROM ids GROUP BY 1),
    j AS (SELECT p_partkey, n.n, ids.id, CASE WHEN p_brand = 'Brand#2' THEN 'old' ELSE '' END AS own
      FROM part LEFT JOIN n ON n.k = {FILL_NAME} LEFT JOIN ids ON ids.k = n.k)
    SELECT p_partkey, coalesce(id, own) AS "CNPJ",
      CASE WHEN n > 1 THEN 'several' WHEN n = 1 OR own <> '' THEN 'one' ELSE 'none' END AS side FROM j""",
)
def _(t):
    tagged = enrich.tag_match_count(names_to_fill(t), t.part, "company", "p_name", "p_type", "p_partkey", tag="side")
    return tagged.select("p_partkey", "CNPJ", "side")
