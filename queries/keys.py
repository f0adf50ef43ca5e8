"""Duplicates, distinct keys, filters, order and parts."""

from pyspark.sql import functions as F

from queries.functions import joined
from queries.registry import query, sql_cpf
from roster import functions as R
from roster.operators import clean, dedupe, discover, enrich, order, reports
from roster.session import scratch_path
from roster.sources import readers

PERSON = "o_custkey || '-X'"


def orders_with_person(t):
    return t.orders.withColumn("cpf", joined(F.col("o_custkey").cast("string"), "-X"))


@query(
    "dedup_first",
    f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY {sql_cpf(PERSON)} ORDER BY o_orderkey) = 1""",
)
def dedup_first(t):
    kept = dedupe.dedup_first(orders_with_person(t), "cpf", ["o_orderkey"])
    return kept.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "dedup_first_null_key",
    """SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lpad(CAST(o_custkey AS VARCHAR), 11, '0') END AS k FROM orders)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1""",
)
def _(t):
    """Two rows in three have no id and make one group."""
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).alias("k")
    )
    return dedupe.dedup_first(rows, "k", ["o_orderkey"]).select("o_orderkey", R.cpf("k").alias("k"))


@query(
    "dedup_per_source",
    """SELECT o_orderkey, o_custkey, o_orderpriority AS source_file FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) = 1""",
)
def _(t):
    rows = orders_with_person(t).withColumnRenamed("o_orderpriority", "source_file")
    kept = dedupe.dedup_first(rows, "cpf", ["o_orderkey"], within=["source_file"])
    return kept.select("o_orderkey", "o_custkey", "source_file")


@query(
    "dedup_max",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def _(t):
    kept = dedupe.dedup_max(orders_with_person(t), "cpf", "o_totalprice", ["o_orderkey"])
    return kept.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "dedup_max_text",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'
    QUALIFY row_number() OVER (PARTITION BY l_partkey
      ORDER BY CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1""",
)
def _(t):
    """Missing ids are dropped; unreadable values count 0."""
    flag = F.col("l_returnflag")
    rows = t.lineitem.withColumns({
        "cpf": F.when(flag != "N", F.col("l_partkey").cast("string")),
        "value": F.when(flag == "A", F.col("l_extendedprice").cast("string")).otherwise("1,5"),
    })
    kept = dedupe.dedup_max(rows, "cpf", "value", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return kept.select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "dedup_stats",
    """SELECT o_orderpriority AS source_file, count(*) AS rows, count(DISTINCT o_custkey) AS unique_keys,
    count(*) - count(DISTINCT o_custkey) AS removed FROM orders GROUP BY 1""",
)
def _(t):
    rows = orders_with_person(t).withColumnRenamed("o_orderpriority", "source_file")
    return dedupe.dedup_stats(rows, "cpf", within=["source_file"])


CNPJ = "lpad(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderstatus = 'P' THEN 12 ELSE 14 END, '0')"


def orders_with_company(t):
    width = F.when(F.col("o_orderstatus") == "P", 12).otherwise(14)
    return t.orders.withColumn("cnpj", F.lpad(F.col("o_custkey").cast("string"), width, F.lit("0")))


@query(
    "distinct_ids",
    f"""SELECT {CNPJ} AS id, min(o_orderkey) AS first_row FROM orders WHERE length({CNPJ}) = 14 GROUP BY 1""",
)
def _(t):
    return dedupe.distinct_ids(orders_with_company(t), "cnpj", "o_orderkey")


@query("distinct_keys", "SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS key FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    rows = t.orders.select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(" ").alias("cpf"))
    return dedupe.distinct_keys(rows, "cpf", R.cpf_strict)


@query("unique_count", "SELECT count(DISTINCT o_custkey) AS unique_keys FROM orders")
def _(t):
    return dedupe.unique_count(orders_with_person(t), "cpf")


@query("valid_cnpj", f"SELECT o_orderkey, {CNPJ} AS cnpj FROM orders WHERE length({CNPJ}) = 14")
def _(t):
    return clean.valid_cnpj_only(orders_with_company(t), "cnpj").select("o_orderkey", "cnpj")


@query("drop_zero", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0")
def _(t):
    return clean.drop_empty_or_zero(t.lineitem, "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "drop_zero_text",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS value FROM lineitem
    WHERE l_returnflag <> 'N' AND l_discount <> 0""",
)
def _(t):
    raw = F.when(F.col("l_returnflag") == "N", " ").when(F.col("l_discount") == 0, "0.0").otherwise(F.col("l_quantity").cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", raw.alias("value"))
    return clean.drop_empty_or_zero(rows, "value")


@query(
    "date_range",
    """SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""",
)
def _(t):
    return clean.filter_date_range(t.events, "ts", "2024-01-12", "2024-01-05").select("event_id", "user_id")


@query(
    "row_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number FROM orders",
)
def _(t):
    return order.number_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "row_number")


@query(
    "split_parts",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 + 1 AS part FROM orders",
)
def _(t):
    return order.split_in_parts(t.orders, 5000, ["o_orderkey"]).select("o_orderkey", "part")


@query(
    "split_parts_files",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS part FROM orders",
)
def _(t):
    """Parts of list files in the order in which rows stand in them."""
    path = scratch_path(t.spark, "ordered")
    t.orders.select("o_orderkey", "o_orderpriority").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.options(
        sep=";", header=True
    ).csv(path)
    return order.split_in_parts(readers.read_lists(t.spark, path), 1000).select("o_orderkey", "part")


@query(
    "unique_count_sketch",
    """SELECT o_orderpriority AS grp, count(*) AS rows, true AS near FROM orders GROUP BY 1
    UNION ALL SELECT 'all', count(*), true FROM orders""",
)
def _(t):
    """Distinct ids from sketches kept per status and united per priority and overall; ``near``: within four standard errors."""
    rows = t.orders.select(F.col("o_orderpriority").alias("grp"), "o_orderstatus", F.col("o_custkey").cast("string").alias("cpf"))
    kept = dedupe.key_sketches(rows, "cpf", ["grp", "o_orderstatus"])
    every = F.explode(F.array("grp", F.lit("all"))).alias("grp")
    counted = dedupe.sketched_count(kept.select(every, "rows", "sketch"), ["grp"])
    exact = rows.select(every, "cpf").groupBy("grp").agg(F.countDistinct("cpf").alias("_exact"))
    near = F.abs(F.col("unique_keys") - F.col("_exact")) <= F.greatest(F.lit(1.0), F.col("_exact") * 4 * 1.04 / 128)
    return counted.join(exact, "grp").select("grp", "rows", near.alias("near"))


@query("split_by_value", "SELECT o_orderpriority AS value, count(*) AS rows FROM orders GROUP BY 1")
def _(t):
    return reports.value_counts(t.orders, "o_orderpriority")


@query(
    "bucket_names",
    """SELECT o_orderkey, translate(lower(o_orderpriority), ' ', '_') AS bucket FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", R.slug("o_orderpriority").alias("bucket"))


@query(
    "profile_columns",
    """WITH tall AS (
      SELECT 0 AS position, 'c_custkey' AS "column", CAST(c_custkey AS VARCHAR) AS v FROM customer
      UNION ALL SELECT 1, 'c_name', c_name FROM customer
      UNION ALL SELECT 2, 'phone', '(51) 9' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer
      UNION ALL SELECT 3, 'bank', CAST(100 + c_nationkey AS VARCHAR) FROM customer)
    SELECT position::INTEGER AS position, "column", count(v) AS filled,
      count(*) FILTER (WHERE regexp_full_match(translate(v, '()- ', ''), '[0-9]{8,}')) / count(v)::DOUBLE AS phone_share,
      count(*) FILTER (WHERE regexp_full_match(v, '[0-9]{3}')) / count(v)::DOUBLE AS three_digit_share,
      count(*) FILTER (WHERE regexp_full_match(v, '[0-9]{1,4}')) / count(v)::DOUBLE AS short_code_share
    FROM tall GROUP BY 1, 2""",
)
def _(t):
    key = F.col("c_custkey").cast("string")
    rows = t.customer.select(
        "c_custkey", "c_name", joined("(51) 9", F.lpad(key, 8, "0")).alias("phone"), (F.lit(100) + F.col("c_nationkey")).alias("bank")
    )
    return discover.profile_columns(rows)


@query(
    "phone_ratio",
    """SELECT count(*) FILTER (WHERE length(CAST(event_id * 1000000 AS VARCHAR)) >= 8) / count(*)::DOUBLE AS ratio FROM events""",
)
def _(t):
    return discover.phone_ratio(t.events.select((F.col("event_id") * 1000000).alias("fone")), "fone")


@query(
    "found_columns",
    """SELECT 'fone' AS phone_column, 'Banco Cod' AS bank_column, max(event_id) AS last_row FROM events""",
)
def _(t):
    """The finders pick the columns by name and content; a ``telefone`` without phones is passed over."""
    rows = t.events.select(
        F.col("event_id"),
        F.col("event_type").alias("telefone"),
        joined("(51) 9", F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("fone"),
        F.lpad(F.col("user_id").cast("string"), 3, "0").alias("Banco Cod"),
    )
    return rows.agg(
        F.lit(discover.find_phone_column(rows)).alias("phone_column"),
        F.lit(discover.find_bank_code_column(rows)).alias("bank_column"),
        F.max("event_id").alias("last_row"),
    )


@query(
    "bank_code_by_content",
    """SELECT c_custkey, n_name AS nome_banco FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    """No column is named like a bank code; the one with short numbers is found by its values and looked up."""
    rows = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("valor"), "c_mktsegment")
    found = discover.find_bank_code_column(rows.drop("c_custkey"))
    banks = t.nation.select(F.col("n_nationkey").cast("string").alias("cod"), "n_name", F.col("n_nationkey").alias("line"))
    return enrich.bank_names(rows, banks, found, "cod", "n_name", "line").select("c_custkey", "nome_banco")


@query(
    "column_preview",
    """WITH tall AS (SELECT o_orderkey AS k, 0 AS position, 'o_orderpriority' AS "column", 'string' AS type, o_orderpriority AS value FROM orders
      UNION ALL SELECT o_orderkey, 1, 'o_custkey', 'bigint', CAST(o_custkey AS VARCHAR) FROM orders),
    seen AS (SELECT position, "column", type, value, min(k) AS first FROM tall GROUP BY 1, 2, 3, 4)
    SELECT position::INTEGER AS position, "column", type, value, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY first) AS rank FROM seen) WHERE rank <= 5""",
)
def _(t):
    shown = discover.column_preview(t.orders.select("o_orderpriority", "o_custkey", "o_orderkey"), "o_orderkey")
    return shown.where(F.col("column") != "o_orderkey")


@query("digit_codes", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS code FROM supplier WHERE s_acctbal > 1000")
def _(t):
    code = F.col("s_nationkey").cast("string")
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 1000, code).otherwise(joined("N", code)).alias("code"), "s_name")
    return dedupe.digits_code_only(rows, "code", "s_name").select("s_suppkey", "code")
