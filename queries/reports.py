"""Totals, checks and per-source figures."""

from pyspark.sql import functions as F

from queries.functions import AS_OF, SQL_AGE, br_text, date_text
from queries.registry import query
from roster import functions as R
from roster.operators import discover, lists, reports


def margins(t):
    """Rows with the part columns of the two totals as Brazilian text."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        br_text("l_extendedprice").alias("Utilizado_5"),
        br_text(F.col("l_quantity") * 100).alias("Utilizado_Beneficio_5"),
        F.when(F.col("l_returnflag") == "R", "erro").otherwise(br_text("l_tax")).alias("Utilizado_35"),
        br_text("l_discount").alias("Saldo_5"),
        F.when(F.col("l_returnflag") == "A", " ").otherwise(br_text("l_extendedprice")).alias("Saldo_35"),
        F.lit("?").alias("Total_Utilizado"), F.lit("?").alias("Total_Saldo"),
    )


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t):
    return discover.preview(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query(
    "recompute_totals",
    """WITH s AS (SELECT l_orderkey, l_linenumber,
        CASE WHEN l_extendedprice > 100000 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS price,
        CAST(l_quantity * 100 AS DECIMAL(18,2)) AS q, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_tax AS DECIMAL(18,2)) END AS tax,
        CAST(l_discount AS DECIMAL(18,2)) AS disc, l_returnflag FROM lineitem),
    x AS (SELECT l_orderkey, l_linenumber, price + q + tax AS used, disc + CASE WHEN l_returnflag = 'A' THEN 0 ELSE price END AS saldo FROM s)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN used > 100000 THEN 0 ELSE used END AS DOUBLE) AS "Total_Utilizado",
      CAST(CASE WHEN saldo > 100000 THEN 0 ELSE saldo END AS DOUBLE) AS "Total_Saldo" FROM x""",
)
def _(t):
    return reports.recompute_totals(margins(t)).select("l_orderkey", "l_linenumber", "Total_Utilizado", "Total_Saldo")


@query(
    "zeroed_amounts",
    """WITH s AS (SELECT CASE WHEN l_extendedprice > 100000 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS price,
        l_extendedprice > 100000 AS over, CAST(l_quantity * 100 AS DECIMAL(18,2)) AS q,
        CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_tax AS DECIMAL(18,2)) END AS tax,
        CAST(l_discount AS DECIMAL(18,2)) AS disc, l_returnflag = 'A' AS blank FROM lineitem)
    SELECT 'Total_Utilizado' AS "column", count(*) AS rows, count(*) FILTER (WHERE over) AS zeroed_parts,
        count(*) FILTER (WHERE price + q + tax > 100000) AS zeroed_totals FROM s
    UNION ALL SELECT 'Total_Saldo', count(*), count(*) FILTER (WHERE over AND NOT blank),
        count(*) FILTER (WHERE disc + CASE WHEN blank THEN 0 ELSE price END > 100000) FROM s""",
)
def _(t):
    return reports.zeroed_amounts(margins(t))


@query(
    "conversion_check",
    """SELECT 'Utilizado_5' AS "column", count(*) AS rows, count(*) FILTER (WHERE l_extendedprice > 100000) AS errors FROM lineitem
    UNION ALL SELECT 'Utilizado_35', count(*), count(*) FILTER (WHERE l_returnflag = 'R' OR l_tax = 0) FROM lineitem
    UNION ALL SELECT 'Saldo_35', count(*), count(*) FILTER (WHERE l_returnflag <> 'A' AND l_extendedprice > 100000) FROM lineitem""",
)
def _(t):
    return reports.conversion_check(margins(t), ["Utilizado_5", "Utilizado_35", "Saldo_35"])


MARKED = "SELECT o_orderpriority, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) AS hit FROM orders"
STATS = f"""SELECT o_orderpriority AS source_file, count(*) AS rows_in, count(*) FILTER (WHERE NOT hit) AS rows_kept,
  count(*) FILTER (WHERE hit) AS rows_removed, count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*) AS rate FROM ({MARKED}) GROUP BY 1"""


def stats(t):
    base = t.orders.select(F.col("o_orderpriority").alias("source_file"), F.col("o_custkey").cast("string").alias("cpf"))
    deny = t.customer.where("c_acctbal < 2000").select(F.col("c_custkey").cast("string").alias("cpf"))
    marked = lists.mark_listed(base, [R.cpf("cpf")], deny, [R.cpf("cpf")])
    return reports.batch_stats(marked, "listed")


@query("batch_stats", STATS)
def _(t):
    return stats(t)


@query(
    "batch_totals",
    f"""SELECT count(*) AS sources, count(*) AS processed, 0::BIGINT AS failed, sum(rows_in)::BIGINT AS rows_in,
    sum(rows_kept)::BIGINT AS rows_kept, sum(rows_removed)::BIGINT AS rows_removed,
    sum(rows_removed)::BIGINT * 100.0::DOUBLE / sum(rows_in)::BIGINT AS rate FROM ({STATS})""",
)
def _(t):
    return reports.batch_totals(stats(t))


@query("top_sources", f"SELECT * FROM ({STATS}) ORDER BY rate DESC, source_file LIMIT 3")
def _(t):
    return reports.top_sources(stats(t), 3)


@query("worst_sources", f"SELECT * FROM ({STATS}) ORDER BY rate, source_file LIMIT 3")
def _(t):
    return reports.top_sources(stats(t), 3, worst=True)


@query(
    "age_stats",
    f"""SELECT min(a) AS youngest, max(a) AS oldest, round(avg(a), 6) AS mean, count(a) AS valid, count(*) - count(a) AS invalid
    FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN {SQL_AGE} END AS a FROM orders)""",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "P", "?").otherwise(date_text())
    aged = t.orders.select(R.age_checked(raw, AS_OF).alias("idade"))
    return reports.age_stats(aged, "idade").withColumn("mean", F.round("mean", 6))


@query(
    "format_counts",
    "SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS filled, count(*) FILTER (WHERE o_orderstatus = 'P') AS blank FROM orders",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "P", "--").otherwise(F.col("o_custkey").cast("string"))
    return reports.format_counts(t.orders.select(R.cpf_strict(raw).alias("cpf")), "cpf")
