"""Sources and sinks: tables written as list files into the shared folder and read back."""

from pyspark.sql import functions as F

from queries.functions import joined
from queries.registry import query
from roster.operators.dedupe import distinct_ids
from roster.operators.reports import batch_stats
from roster.plans import jobs
from roster.session import scratch_path
from roster.sources import readers, writers


def people(t):
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        F.lpad(key, 11, "0").alias("cpf"), joined('Jo"ão; ', F.col("c_name")).alias("nome"), F.col("c_mktsegment").alias("grupo")
    )


PEOPLE = """SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf, 'Jo"ão; ' || c_name AS nome, c_mktsegment AS grupo FROM customer"""


@query("list_round_trip", PEOPLE)
def _(t):
    path = scratch_path(t.spark, "list")
    writers.write_list(people(t), path)
    return readers.read_lists(t.spark, path).drop("source_file", "row_order")


@query("list_with_bom", PEOPLE)
def _(t):
    path = scratch_path(t.spark, "bom")
    writers.write_list(people(t), path, bom=True)
    return readers.read_lists(t.spark, path).drop("source_file", "row_order")


@query(
    "mixed_folder",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf, c_mktsegment || ' ç' AS nome, '' AS uf, '' AS saldo FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name || ' é', CAST(s_nationkey AS VARCHAR), '' FROM supplier
    UNION ALL SELECT '', n_name || ' ã', '', CAST(n_regionkey AS VARCHAR) FROM nation""",
)
def _(t):
    """One folder with three separators, two encodings and three headers."""
    path = scratch_path(t.spark, "mixed")
    customer = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("cpf"), joined(F.col("c_mktsegment"), " ç").alias("nome"))
    supplier = t.supplier.select(F.col("s_suppkey").alias("cpf"), joined(F.col("s_name"), " é").alias("nome"), F.col("s_nationkey").alias("uf"))
    nation = t.nation.select(joined(F.col("n_name"), " ã").alias("nome"), F.col("n_regionkey").alias("saldo"))
    for table, sep, code in ((customer, ";", "UTF-8"), (supplier, ",", "ISO-8859-1"), (nation, "\t", "UTF-8")):
        table.write.mode("append").options(sep=sep, header=True, encoding=code).csv(path)
    merged = readers.read_lists(t.spark, path)
    return merged.select("cpf", "nome", "uf", "saldo")


@query("merge_folder", PEOPLE.replace("""Jo"ão""", "João"))
def _(t):
    path = scratch_path(t.spark, "merge")
    writers.write_list(people(t), path)
    return readers.merge_folder(t.spark, path)


@query("junk_first_line", PEOPLE)
def _(t):
    """Line 1 is a caption; the header is on line 2."""
    path = scratch_path(t.spark, "junk")
    rows = people(t)
    junk_lines(rows).write.text(path)
    return readers.read_lists(t.spark, path, glob="*.txt", skip_first_line=True).drop("source_file", "row_order")


def junk_lines(rows):
    """Lines of the rows; every task, so every file, begins with a caption and the header."""
    line = F.concat_ws(";", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns])
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    top = F.array(F.lit("Relatório"), F.lit(";".join(rows.columns)), F.col("line"))
    spread = rows.select(line.alias("line"), place.alias("place"))
    return spread.select(F.explode(F.when(F.col("place") == 0, top).otherwise(F.array("line"))).alias("value"))


@query("merge_junk_folder", PEOPLE.replace("""Jo"ão""", "João"))
def _(t):
    """Union of files whose header is on line 2."""
    path = scratch_path(t.spark, "junk")
    junk_lines(people(t)).write.text(path)
    return readers.merge_folder(t.spark, path, glob="*.txt", skip_first_line=True)


@query("keep_alpha_folder", """SELECT CAST(s_name AS VARCHAR) AS "A", CAST(s_nationkey AS VARCHAR) AS "B" FROM supplier""")
def _(t):
    source, path = scratch_path(t.spark, "wide"), scratch_path(t.spark, "alpha")
    t.supplier.select("s_name", "s_acctbal", "s_nationkey").write.options(sep=";", header=True).csv(source)
    jobs.keep_columns_alpha(t.spark, source, ["s_nationkey", "s_name"], path)
    return t.spark.read.options(header=True, sep=";").schema("A string, B string, source_file string").csv(path).drop("source_file")


@query(
    "drop_zero_folder",
    """SELECT s_name, CAST(s_suppkey AS VARCHAR) AS valor FROM supplier WHERE s_suppkey % 3 <> 0""",
)
def _(t):
    """Files without their rows of blank and zero values."""
    source, path = scratch_path(t.spark, "values"), scratch_path(t.spark, "nonzero")
    key = F.col("s_suppkey")
    value = F.when(key % 3 != 0, key.cast("string")).otherwise(F.when(key % 2 == 0, "0").otherwise(" "))
    t.supplier.select("s_name", value.alias("valor")).write.options(sep=";", header=True).csv(source)
    jobs.drop_empty_or_zero(t.spark, source, path, "valor")
    return t.spark.read.options(header=True, sep=";").schema("s_name string, valor string, source_file string").csv(path).drop("source_file")


@query("key_list", """SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS "CNPJ" FROM customer""")
def _(t):
    path = scratch_path(t.spark, "keys")
    t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 14, "0")).write.csv(path)
    return readers.read_key_list(t.spark, path).select("CNPJ")


@query("id_text", """SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS "CNPJ" FROM orders""")
def _(t):
    """Distinct ids written as comma-joined lines of 500 and read back."""
    path = scratch_path(t.spark, "ids")
    ids = distinct_ids(t.orders.select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("id")), "id", "o_orderkey")
    writers.write_id_text(ids, "id", ["first_row"], path, ids_per_file=500)
    return readers.read_id_text(t.spark, path).select("CNPJ")


@query(
    "id_lines",
    """WITH ids AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS id, row_number() OVER (ORDER BY min(o_orderkey)) AS n
      FROM orders GROUP BY o_custkey)
    SELECT (n - 1) // 200 + 1 AS part, md5(string_agg(id, ',' ORDER BY n)) AS line FROM ids GROUP BY 1""",
)
def _(t):
    ids = distinct_ids(t.orders.select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("id")), "id", "o_orderkey")
    lines = writers.id_lines(ids, "id", ["first_row"], 200)
    return lines.select("part", F.md5(F.col("line").cast("binary")).alias("line"))


@query("by_value", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, translate(lower(o_orderpriority), ' ', '_') AS bucket FROM orders""")
def _(t):
    """One folder per priority; the folder name comes back as a column."""
    path = scratch_path(t.spark, "value")
    writers.write_by_value(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", path)
    return t.spark.read.options(header=True, sep=";").schema("o_orderkey string, o_orderpriority string, bucket string").csv(path).select("o_orderkey", "bucket")


@query("per_source", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'limpo_' || o_orderstatus AS source_file FROM orders""")
def _(t):
    path = scratch_path(t.spark, "source")
    rows = t.orders.select("o_orderkey", joined(F.col("o_orderstatus"), ".csv").alias("source_file"))
    writers.write_per_source(rows, path, "limpo_")
    return t.spark.read.options(header=True, sep=";").schema("o_orderkey string, source_file string").csv(path)


@query("convert_utf8", """SELECT s_name || ' ção' AS nome FROM supplier""")
def _(t):
    source, path = scratch_path(t.spark, "latin"), scratch_path(t.spark, "utf8")
    t.supplier.select(joined(F.col("s_name"), " ção").alias("nome"), "s_acctbal").write.options(sep=",", header=True, encoding="ISO-8859-1").csv(source)
    writers.convert_utf8(t.spark, source, path)
    return t.spark.read.options(header=True, sep=";").csv(path).select("nome")


@query(
    "quality_report",
    "SELECT 'missing columns: fone' AS status, count(*) AS rows FROM supplier",
)
def _(t):
    """Lines but the headers of several files, added up per status."""
    path = scratch_path(t.spark, "quality")
    t.supplier.select("s_name", "s_acctbal").write.options(sep=";", header=True).csv(path)
    report = readers.quality_report(t.spark, path, ["s_name", "fone"])
    return report.groupBy("status").agg((F.sum("lines") - F.count(F.lit(1))).alias("rows"))


RAGGED = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'long' WHEN s_suppkey % 7 = 1 THEN 'short' ELSE 'ok' END AS kind FROM supplier"""


def ragged(t):
    """A list some of whose lines have a field too many or too few."""
    path, key = scratch_path(t.spark, "ragged"), F.col("s_suppkey").cast("string")
    line = joined(key, ";", F.when(F.col("s_suppkey") % 7 == 1, F.lit("x")).otherwise(joined(F.col("s_name"), ";RS")))
    header = t.spark.range(1).select(F.lit("id;nome;uf").alias("value"))
    rows = t.supplier.select(F.concat(line, F.when(F.col("s_suppkey") % 7 == 0, ";more").otherwise("")).alias("value"))
    header.unionByName(rows).coalesce(1).write.text(path)
    return path


@query("ragged_folder", f"SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN kind = 'ok' THEN 'RS' END AS uf FROM ({RAGGED}) WHERE kind <> 'long'")
def _(t):
    """Rows with a field too many are rejected, rows with one too few are kept."""
    return readers.read_lists(t.spark, ragged(t)).select("id", "uf")


@query(
    "rejected_rows",
    f"""SELECT kind AS reason, CAST(s_suppkey AS VARCHAR) AS id FROM ({RAGGED}) WHERE kind <> 'ok'""",
)
def _(t):
    found = readers.read_rejects(t.spark, ragged(t))
    return found.select("reason", F.substring_index("record", ";", 1).alias("id"))


@query(
    "rejected_counts",
    f"""SELECT count(*) FILTER (WHERE kind = 'short') AS short, count(*) FILTER (WHERE kind = 'long') AS long, 0::BIGINT AS unclosed,
    'rejected rows: ' || count(*) FILTER (WHERE kind = 'long') AS status FROM ({RAGGED})""",
)
def _(t):
    return readers.quality_report(t.spark, ragged(t), ["id"]).select("short", "long", "unclosed", "status")


@query(
    "values_with_line_breaks",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || chr(10) || chr(10) || '"' || c_mktsegment || '";' AS nota, 'z' AS uf FROM customer""",
)
def _(t):
    """One file whose values hold line breaks, quotes and separators, cut into records by many tasks."""
    path = scratch_path(t.spark, "breaks")
    note = joined(F.col("c_name"), "\n\n\"", F.col("c_mktsegment"), "\";")
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), note.alias("nota"), F.lit("z").alias("uf"))
    writers.write_list(rows.coalesce(1), path, clean=False)
    return readers.read_lists(t.spark, path).select("id", "nota", "uf")


@query(
    "several_headers_written",
    """SELECT 'novo_c' AS side, count(*) AS rows FROM customer UNION ALL SELECT 'novo_s', count(*) FROM supplier""",
)
def _(t):
    """Tables of two headers, written in one job and read back: rows by the column only one of them has."""
    path = scratch_path(t.spark, "headers")
    customers = people(t).withColumn("source_file", F.lit("c.csv"))
    suppliers = t.supplier.select(F.col("s_suppkey").cast("string").alias("cpf"), F.col("s_name").alias("fornecedor"), F.lit("s.csv").alias("source_file"))
    writers.write_per_source([customers, suppliers], path, "novo_")
    back = readers.read_lists(t.spark, f"{path}/*")
    return back.groupBy(F.regexp_extract("source_file", "source_file=(.*)/", 1).alias("side")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "report_file",
    """SELECT o_orderpriority AS source_file, CAST(count(*) AS VARCHAR) AS rows_in FROM orders GROUP BY 1""",
)
def _(t):
    """Per-source figures written as a report file and read back."""
    path = scratch_path(t.spark, "report")
    marked = t.orders.select(F.col("o_orderpriority").alias("source_file"), F.lit(False).alias("gone"))
    writers.write_report(batch_stats(marked, "gone"), path)
    return t.spark.read.options(header=True, sep=";").csv(path).select("source_file", "rows_in")
