import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster import functions as R
from roster.operators import clean, dedupe, discover, enrich, links, lists, merge, order, reports, shape

relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_row_per_id_with_one_group_of_missing_ids(spark):
    df = spark.createDataFrame([(1, "7"), (2, None), (3, "007"), (4, None), (5, "")], "n int, cpf string")
    assert rows(dedupe.dedup_first(df, "cpf", ["n"]), "n") == [(1,), (2,), (5,)]
    assert dedupe.dedup_stats(df, "cpf").first().asDict() == {"rows": 5, "unique_keys": 2, "removed": 2}


def test_largest_value_per_id(spark):
    df = spark.createDataFrame(
        [(1, "7", "1.5"), (2, "7", "1,9"), (3, "7", "1.5"), (4, None, "9"), (5, "8", None)], "n int, cpf string, v string"
    )
    assert rows(dedupe.dedup_max(df, "cpf", "v", ["n"]), "n") == [(1,), (5,)]


def test_hot_key_is_cut_in_the_map_tasks(spark):
    """A key with a third of the rows must not be sorted in one task."""
    df = spark.range(0, 90_000, 1, 6).select(
        "id", F.when(F.col("id") % 3 == 0, "1").otherwise(F.col("id").cast("string")).alias("cpf")
    )
    first = dedupe.dedup_first(df, "cpf", ["id"])
    text = plan(first)
    assert text.index("row_number(), 1, Final") < text.index("Exchange") < text.index("row_number(), 1, Partial")
    assert first.count() == df.select(R.cpf("cpf")).distinct().count()


@relaxed
@given(st.lists(st.tuples(st.integers(0, 20), st.booleans()), min_size=1, max_size=60))
def test_kept_and_denied_make_the_base(spark, data):
    base = spark.createDataFrame([(n, str(k) if ok else None) for n, (k, ok) in enumerate(data)], "n int, cpf string")
    deny = spark.createDataFrame([("3",), ("3",), (None,), ("0005",), ("19",)], "cpf string")
    kept, denied = lists.split_by_denylist(base, deny, "cpf", "cpf")
    listed = {n for n, (k, ok) in enumerate(data) if not ok or k in (3, 5, 19)}
    assert {r.n for r in denied.collect()} == listed
    assert sorted([r.n for r in kept.collect()] + list(listed)) == list(range(len(data)))


def test_deny_rules_for_missing_ids(spark):
    base = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "51-9"), (5, "519")], "n int, k string")
    deny = spark.createDataFrame([(None,), ("--",), ("(51) 9",)], "k string")
    assert rows(lists.remove_by_phone(base, deny, "k", "k"), "n") == [(1,)]
    assert rows(lists.remove_by_cnpj(base, deny, "k", "k"), "n") == [(1,), (2,)]
    assert rows(lists.remove_by_number_batch(base, deny, "k", "k"), "n") == [(2,), (3,), (4,), (5,)]
    assert rows(lists.split_by_allowlist(base, deny, "k", "k")[0], "n") == [(4,), (5,)]


def test_mask_needs_id_and_number(spark):
    base = spark.createDataFrame([(1, "1", "9"), (2, "2", "9"), (3, "1", None)], "n int, cpf string, numero string")
    deny = spark.createDataFrame([("001", "9"), ("1", "9"), ("1", None)], "cpf string, numero string")
    masked = lists.mask_denied_numbers(base, deny, "cpf", "numero", "cpf", "numero")
    assert rows(masked, "n", "numero") == [(1, "-"), (2, "9"), (3, None)]


def test_folder_denylist_needs_a_known_column(spark):
    base = spark.createDataFrame([("1",)], "CPF string")
    with pytest.raises(ValueError):
        lists.split_by_denylist_folder(base, spark.createDataFrame([("1",)], "x string"))


def test_enrich_fans_out_and_renames(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "cpf string, v string")
    data = spark.createDataFrame([("01", "x", 1), ("1", "y", 2), (None, "z", 3)], "id string, v string, w int")
    matched, unmatched = enrich.enrich_by_cpf(base, data, "cpf", "id")
    assert matched.columns == ["cpf", "v_x", "v_y", "w"]
    assert rows(matched, "v_x", "v_y") == [("a", "x"), ("a", "y")]
    assert rows(unmatched, "v") == [("b",), ("c",)]
    both, _ = enrich.enrich_by_cpf(base, data, "cpf", "id", null_safe=True)
    assert rows(both, "v_x", "v_y") == [("a", "x"), ("a", "y"), ("c", "z")]
    once, _ = enrich.enrich_by_cpf(base, data, "cpf", "id", dedup_by=["w"])
    assert rows(once, "v_y") == [("x",)]


def test_fill_by_company_name(spark):
    base = spark.createDataFrame([(1, "São X", ""), (2, "Y.", "old"), (3, "W", ""), (4, "V", "5; 6"), (5, None, "")], "n int, nome string, CNPJ string")
    ref = spark.createDataFrame([(1, "SAO  X", "b"), (2, "sao x", "a"), (3, "São X", "b"), (4, "Y", "c"), (5, "W", " ")], "o int, nome string, id string")
    filled = enrich.fill_cnpj_by_name(base, ref, "nome", "nome", "id", "o")
    assert rows(filled, "n", "CNPJ") == [(1, "b; a"), (2, "c"), (3, ""), (4, "5; 6"), (5, "")]
    one, several, none = enrich.split_by_match_count(base, ref, "nome", "nome", "id", "o")
    assert rows(one, "n", "CNPJ") == [(2, "c")]
    assert rows(several, "n", "CNPJ") == [(1, "a"), (1, "b"), (4, "5"), (4, "6")]
    assert rows(none, "n") == [(3,), (5,)]


def test_company_join_keeps_ids_without_data(spark):
    ids = spark.createDataFrame([("11222333000181",), ("12",), ("99222333000181",)], "CNPJ string")
    data = spark.createDataFrame([("11.222.333/0001-81", "A"), ("11222333000181", "B"), ("3", "C")], "CNPJ string, nome string")
    joined = enrich.join_companies(ids, data)
    assert joined.columns == ["CNPJ_x", "CNPJ_y", "nome"]
    assert rows(joined, "CNPJ_x", "nome") == [("11222333000181", "A"), ("11222333000181", "B"), ("99222333000181", None)]


def test_last_bank_wins(spark):
    base = spark.createDataFrame([("280.0",), ("001",), (None,)], "cod string")
    banks = spark.createDataFrame([("280", "old", 1), ("280", "new", 2), ("1", "BB", 3)], "c string, b string, o int")
    assert rows(enrich.bank_names(base, banks, "cod", "c", "b", "o"), "cod", "nome_banco") == [("001", None), ("280.0", "new"), (None, None)]


@relaxed
@given(st.integers(1, 400), st.integers(1, 70))
def test_parts_have_exactly_n_rows(spark, total, size):
    df = spark.range(0, total, 1, 5).withColumn("k", F.hash("id"))
    parts = order.split_in_parts(df, size, ["k", "id"])
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    full, rest = divmod(total, size)
    assert counts == {n + 1: size for n in range(full)} | ({full + 1: rest} if rest else {})


def test_row_numbers_need_no_one_task_window(spark):
    df = spark.range(0, 5000, 1, 4).withColumn("v", F.rand(1))
    numbered = order.number_rows(df, ["v"])
    first = [r.id for r in df.orderBy("v").collect()]
    assert [r.id for r in numbered.orderBy("row_number").collect()] == first


def test_filters(spark):
    df = spark.createDataFrame([(1, "0"), (2, "0.0"), (3, ""), (4, None), (5, "x"), (6, "0,5"), (7, " "), (8, "00")], "n int, v string")
    assert rows(clean.drop_empty_or_zero(df, "v"), "n") == [(5,), (6,)]
    numbers = spark.createDataFrame([(1, 0.0), (2, None), (3, -1.0)], "n int, v double")
    assert rows(clean.drop_empty_or_zero(numbers, "v"), "n") == [(3,)]
    days = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 23:00:00', timestamp_ntz'2024-01-05 23:00:00', interval 1 day)) AS t")
    assert clean.filter_date_range(days, "t", "2024-01-04", "2024-01-02").count() == 3


def test_branch_banks(spark):
    df = spark.createDataFrame(
        [(1, "237", " ", "Bradesco", "Porto Alegre/RS"), (2, "237", None, "Outro", "rs"), (3, None, "33", "Santander", "RS "), (4, "x1", "", "X", "RS"), (5, "9", "", "Y", "SP"), (6, "8", "", " ", "RS"), (7, "7", "", "Z", None)],
        "n int, CodigoCompe string, Codigo string, NomeIf string, Uf string",
    )
    assert [tuple(r) for r in dedupe.branch_banks(df, "n", "rs").collect()] == [("33", "Santander"), ("237", "Bradesco")]
    assert dedupe.branch_banks(df, "n").count() == 4


def test_layouts(spark):
    df = spark.createDataFrame([("1", "a", "x")], "c string, a string, b string")
    assert shape.keep_columns_alpha(df, ["b", "c"]).columns == ["A", "B"]
    with pytest.raises(ValueError):
        shape.keep_columns_alpha(df, ["z"])
    with pytest.raises(ValueError, match="CEL1"):
        shape.conform_layout(df)
    assert shape.conform_layout(df, ["b", "d"], {"d": "?"}).first() == ("x", "?")
    assert merge.merge_sources([df.select("c", "a"), df.select("b", "a")]).columns == ["c", "a", "b"]


def test_totals_found_by_name():
    names = ["Utilizado_5", "Utilizado_Beneficio_5", "Utilizado_35", "Saldo_5", "Total_Utilizado", "Total_Saldo"]
    assert discover.find_total_columns(names) == {
        "Total_Utilizado": ["Utilizado_5", "Utilizado_Beneficio_5", "Utilizado_35"], "Total_Saldo": ["Saldo_5"],
    }


def test_totals_above_the_limit_are_zero(spark):
    df = spark.createDataFrame([("60.000,00", "50.000,00", "?"), ("1,10", "2,20", "?"), ("200000", "1", "?")], "Utilizado_5 string, Utilizado_35 string, Total_Utilizado string")
    assert rows(reports.recompute_totals(df), "Total_Utilizado") == [(0.0,), (1.0,), (3.3,)]


def test_finders(spark):
    df = spark.createDataFrame([("x", "51999999999", "341"), ("y", "(51) 9999-9999", "1")], "numero string, contato string, banco string")
    assert discover.find_phone_column(df) == "contato"
    assert discover.find_bank_code_column(df) == "numero"  # the first column with any of the weaker names
    assert discover.find_bank_code_column(df.drop("numero")) == "banco"
    assert discover.find_bank_code_column(df.toDF("a", "b", "c")) == "c"
    with pytest.raises(ValueError):
        discover.find_key_column(df)
    assert discover.find_birth_column(["IDADE", " Nasc "]) == " Nasc "


def test_file_names_of_all_or_the_first_ten(spark):
    data = [(1, "u", n, "h", f"f{n}.PDF" if n % 2 else "page") for n in range(30)]
    anchors = spark.createDataFrame(data, "page_id int, url string, position int, href string, text string")
    assert sorted(r.position for r in links.file_names(anchors).collect()) == list(range(1, 30, 2))
    assert sorted(r.position for r in links.file_names(anchors, per_page=10).collect()) == [1, 3, 5, 7, 9]


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 1.5 AS v", "timestamp_ntz'2024-01-01' AS t", "'wide' AS w").write.parquet(path)
    df = spark.read.parquet(path)
    zero = plan(clean.drop_empty_or_zero(df, "v").select("id"))
    assert "IsNotNull(v)" in zero and "Not(EqualTo(v," in zero and "w:string" not in zero
    days = plan(clean.filter_date_range(df, "t", "2024-01-01", "2024-01-02").select("id"))
    assert "GreaterThanOrEqual(t," in days and "LessThan(t," in days and "cast(t" not in days


@pytest.fixture
def small_skew_limits(spark):
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_keys_are_split_in_every_join(spark, small_skew_limits):
    """A key with a third of the rows: adaptive execution must be able to split it."""
    key = F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string"))
    base = spark.range(0, 90_000, 1, 12).select("id", key.alias("cpf"))
    deny = spark.range(0, 60_000, 1, 6).select(key.alias("cpf"))
    ref = spark.range(0, 60_000, 1, 6).select("id", F.col("id").cast("string").alias("n"))
    twice = ref.withColumn("c", F.lit("x")).unionByName(ref.withColumn("c", F.lit("y")))
    data = deny.distinct().select(F.col("cpf").alias("k"), F.lit(1).alias("v"))
    numbers = [d.withColumn("numero", F.col("cpf")) for d in (base, deny)]
    kept, denied = lists.split_by_denylist(base, deny, "cpf", "cpf")
    matched, unmatched = enrich.enrich_by_cpf(base, data, "cpf", "k")
    frames = {
        "mark": lists.mark_listed(base, [R.cpf("cpf")], deny, [R.cpf("cpf")]), "kept": kept, "denied": denied,
        "mask": lists.mask_denied_numbers(*numbers, "cpf", "numero", "cpf", "numero"),
        "matched": matched, "unmatched": unmatched,
        "fill": enrich.fill_cnpj_by_name(base, twice, "cpf", "n", "c", "id"),
        "several": enrich.split_by_match_count(base, twice, "cpf", "n", "c", "id")[1],
        "bank": enrich.bank_names(base, ref, "cpf", "n", "n", "id"),
    }
    for name, frame in frames.items():
        total = frame.agg(F.sum(F.hash(*frame.columns)))
        total.collect()
        assert "skew=true" in plan(total), name


def test_no_cross_join_and_no_python_in_the_list_operators(spark):
    base = spark.createDataFrame([("1", "2")], "cpf string, numero string")
    frames = [
        lists.mask_denied_numbers(base, base, "cpf", "numero", "cpf", "numero"),
        *lists.split_by_denylist(base, base, "cpf", "cpf"),
        *enrich.enrich_by_cpf(base, base, "cpf", "cpf"),
        dedupe.distinct_ids(base, "cpf", "numero"),
    ]
    for frame in frames:
        text = plan(frame)
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def test_deny_folder_with_mixed_key_columns(spark):
    base = spark.createDataFrame([("111",), ("222",), ("333",), (None,)], "CPF string")
    deny = [
        spark.createDataFrame([(" 111", "333")], "CPF string, identifier string"),
        spark.createDataFrame([("222",)], "identifier string"),
        spark.createDataFrame([("333",)], "other string"),
    ]
    kept, denied = lists.split_by_denylist_folder(base, deny)
    assert rows(denied, "CPF") == [("111",), ("222",)]
    assert kept.count() == 2


def test_both_sides_take_one_join_and_two_scans(spark, tmp_path):
    spark.range(100).selectExpr("string(id) AS cpf", "id AS v").write.parquet(str(tmp_path / "base"))
    spark.range(10).selectExpr("string(id) AS CPF").write.parquet(str(tmp_path / "deny"))
    base, deny = spark.read.parquet(str(tmp_path / "base")), spark.read.parquet(str(tmp_path / "deny"))
    for marked in (lists.mark_denied(base, deny, "cpf", "CPF"), lists.mark_allowed(base, deny, "cpf", "CPF")):
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Join") == 1


def test_anchor_forms(spark):
    html = """<a class=x href=plain.html>one</a> <A title="a > b" HREF='two.html?x=1&amp;y=2'>t<b>w</b>o</A>
    <a data-href="no">none</a> <abbr href="no">no</abbr> <a href="//host/x">3</a> <a href="/root">4</a><a
    href="#part">5</a> <a href = "http://else/where">6</a> <a href="">7</a>"""
    df = spark.createDataFrame([(1, "https://site.org/dir/page.html?q#f", html)], "page_id int, url string, html string")
    got = [(r.position, r.href, r.target, r.text) for r in links.extract_links(df).orderBy("position").collect()]
    assert got == [
        (0, "plain.html", "https://site.org/dir/plain.html", "one"),
        (1, "two.html?x=1&y=2", "https://site.org/dir/two.html?x=1&y=2", "two"),
        (2, "//host/x", "https://host/x", "3"),
        (3, "/root", "https://site.org/root", "4"),
        (4, "#part", "https://site.org/dir/page.html?q#part", "5"),
        (5, "http://else/where", "http://else/where", "6"),
        (6, "", "https://site.org/dir/page.html?q#f", "7"),
    ]


def test_resolved_addresses(spark):
    """Golden pages: dot segments, numeric entities, a base element, entities that are none."""
    pages = [
        (1, "http://h.org/a/b/c.html", '<a href="../x">1</a><a href="./y/./z?q=../r">2</a><a href="/../../w/..">3</a><a href="..">4</a>'
         '<a href="http://o.org/p/../q/#f/../g">5</a><a href="mailto:a/../b">6</a>'),
        (2, "http://h.org", '<base target="_top"><BASE HREF="/root/sub/"><a href="n&#38;m&#x26;o">A&#233;&#x1F600;&amp;#38;&lt;</a><a href="&#0;&#xD800;&#9999999;&bad;">x</a>'),
        (3, "http://h.org/d/e", '<a href="f">&nbsp;t&#8364;</a>'),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = [(r.page_id, r.href, r.target, r.text) for r in links.extract_links(df).orderBy("page_id", "position").collect()]
    assert got == [
        (1, "../x", "http://h.org/a/x", "1"), (1, "./y/./z?q=../r", "http://h.org/a/b/y/z?q=../r", "2"), (1, "/../../w/..", "http://h.org/", "3"),
        (1, "..", "http://h.org/a/", "4"), (1, "http://o.org/p/../q/#f/../g", "http://o.org/q/#f/../g", "5"), (1, "mailto:a/../b", "mailto:a/../b", "6"),
        (2, "n&m&o", "http://h.org/root/sub/n&m&o", "Aé😀&#38;<"),
        (2, "&#0;&#xD800;&#9999999;&bad;", "http://h.org/root/sub/&#0;&#xD800;&#9999999;&bad;", "x"), (3, "f", "http://h.org/d/f", "t€"),
    ]


def test_bounded_preview(spark):
    """A task hands on at most ``examples`` values a column."""
    df = spark.range(0, 10_000, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.concat(F.lit("v"), 9_999 - F.col("id")).alias("b"))
    shown = discover.column_preview(df.repartition(4, "a").select("a", "b", "k"), "k")
    found = sorted((r.column, r.rank, r.value) for r in shown.where("column <> 'k'").collect())
    assert found == [("a", i + 1, str(i)) for i in range(5)] + [("b", i + 1, f"v{9_999 - i}") for i in range(5)]
    placed = df.withColumn("o", F.struct("k"))
    assert [r.value for r in discover.column_preview(placed.select("a", "o"), "o", 2).where("position = 0").orderBy("rank").collect()] == ["0", "1"]
    firsts = [m for m in plan(shown).split("\n") if "MapInArrow" in m]
    assert firsts


def test_kept_sketches_are_united(spark):
    days = [spark.range(n * 3000, n * 3000 + 6000).select((F.col("id") % 20_000).cast("string").alias("cpf"), F.lit(f"d{n}").alias("day")) for n in range(5)]
    kept = [dedupe.key_sketches(d, "cpf", ["day"]) for d in days]
    united = dedupe.sketched_count(reduce(DataFrame.unionByName, kept)).first()
    assert united.rows == 30_000 and abs(united.unique_keys - 18_000) < 18_000 * 4 * 1.04 / 128
    alone = {r.day: r.unique_keys for r in dedupe.sketched_count(reduce(DataFrame.unionByName, kept), ["day"]).collect()}
    assert all(abs(n - 6000) < 6000 * 4 * 1.04 / 128 for n in alone.values()) and len(alone) == 5


def test_sides_come_from_one_join(spark, tmp_path):
    spark.range(100).selectExpr("concat('Nome ', id) AS nome", "string(id) AS cpf").write.parquet(str(tmp_path / "base"))
    spark.range(300).selectExpr("concat('nome ', id % 50) AS n", "lpad(string(id % 120), 14, '0') AS c", "string(id % 40) AS k", "id").write.parquet(str(tmp_path / "ref"))
    base, ref = spark.read.parquet(str(tmp_path / "base")), spark.read.parquet(str(tmp_path / "ref"))
    tagged = enrich.tag_match_count(base, ref, "nome", "n", "c", "id")._jdf.queryExecution().executedPlan().toString()
    assert tagged.count("FileScan") == 1 and tagged.count("Join") == 2  # the other scan made the pairs
    marked = enrich.mark_enriched(base, ref, "cpf", "k")._jdf.queryExecution().executedPlan().toString()
    assert marked.count("FileScan") == 2 and marked.count("Join") == 1


def test_blank_ids_match_nothing(spark):
    base = spark.createDataFrame([("", "a"), (" ", "b"), (None, "c"), ("7", "d")], "cpf string, v string")
    data = spark.createDataFrame([("", 1), ("-", 2), (None, 3), ("07", 4)], "cpf string, w int")
    matched, unmatched = enrich.enrich_by_cpf(base, data, "cpf", "cpf")
    assert rows(matched, "v", "w") == [("d", 4)] and rows(unmatched, "v") == [("a",), ("b",), ("c",)]
    zeros, _ = enrich.enrich_by_cpf(base, data, "cpf", "cpf", normalise=R.cpf)
    assert zeros.count() == 5


def test_zeroed_amounts_are_counted(spark):
    df = spark.createDataFrame([("1", "200000", "x"), ("90000", "90000", "x")], "a string, b string, t string")
    assert rows(reports.zeroed_amounts(df, {"t": ["a", "b"]}), "rows", "zeroed_parts", "zeroed_totals") == [(2, 1, 1)]
    assert rows(reports.recompute_totals(df, {"t": ["a", "b"]}, limit=None), "t") == [(180000.0,), (200001.0,)]


def test_totals_read_each_part_once(spark, tmp_path):
    data = [(" 1.234,50 ", "10", "\u00a0", "x", "y"), ("-200000", "-0", "erro", "x", "y"), ("99.999,99", "0.01", None, "x", "y"), ("1e999", "1d", "", "x", "y")]
    spark.createDataFrame(data, "a string, b string, c string, t string, u string").write.parquet(f"{tmp_path}/parts")
    df = spark.read.parquet(f"{tmp_path}/parts")
    totals = {"t": ["a", "b", "c"], "u": ["b", "a", "b"]}
    out = reports.recompute_totals(df, totals)
    assert out.columns == df.columns
    assert rows(out, "a", "t", "u") == [
        (" 1.234,50 ", 1244.5, 1254.5), ("-200000", 0.0, 0.0), ("1e999", 0.0, 0.0), ("99.999,99", 100000.0, 0.0),
    ]
    assert rows(reports.recompute_totals(df, totals, limit=None).where("a <> '1e999'"), "t", "u") == [
        (-200000.0, -200000.0), (100000.0, 100000.01), (1244.5, 1254.5),
    ]
    assert rows(reports.recompute_totals(df, {"t": []}), "t", "u") == [(0.0, "y")] * 4
    assert rows(reports.zeroed_amounts(df, totals), "column", "rows", "zeroed_parts", "zeroed_totals") == [("t", 4, 2, 1), ("u", 4, 2, 2)]
    assert rows(reports.conversion_check(df, ["a", "b", "c"]), "column", "errors") == [("a", 1), ("b", 2), ("c", 1)]
    for read, parts in ((out, 3), (reports.zeroed_amounts(df, totals), 3)):
        assert plan(read).count("replace(replace(") == parts and plan(read).count("try_cast(") == parts
    assert plan(reports.conversion_check(df, ["a", "b", "c"])).count("replace(replace(") == 3
