import pytest

from roster import functions as R
from roster.operators import order
from roster.plans import jobs
from roster.sources import readers, writers


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in put"
    path.mkdir()
    (path / "a.csv").write_text('cpf;nome;fone\n012;"Jo;ão";55.0\n;x;\n', encoding="utf-8")
    (path / "b.csv").write_text('﻿cpf,nome,uf\n9,Zé,RS\n8,"a ""q""",SP\n', encoding="utf-8")
    (path / "c.csv").write_bytes("cpf;nome;fone\n7;Ação – €;1\n".encode("cp1252"))
    (path / "d.csv").write_text("")
    (path / "e.csv").write_text("cpf;nome;fone\n")
    return path


def test_mixed_folder(spark, folder):
    table = readers.read_lists(spark, str(folder))
    got = sorted((r.source_file, r.cpf, r.nome, r.fone, r.uf) for r in table.where("cpf IS NOT NULL").collect())
    assert got == [
        ("a.csv", "012", "Jo;ão", "55.0", ""), ("b.csv", "8", 'a "q"', "", "SP"), ("b.csv", "9", "Zé", "", "RS"),
        ("c.csv", "7", "Ação – €", "1", ""),
    ]
    assert [r.nome for r in table.orderBy(readers.ORDER).collect()] == ["Jo;ão", "x", "Zé", 'a "q"', "Ação – €"]


def test_quality_report(spark, folder):
    report = {r.source_file: (r.encoding, r.status) for r in readers.quality_report(spark, str(folder), ["fone"]).collect()}
    assert report == {
        "a.csv": ("UTF-8", "ok"), "b.csv": ("UTF-8", "missing columns: fone"), "c.csv": ("windows-1252", "ok"),
        "d.csv": ("UTF-8", "empty"), "e.csv": ("UTF-8", "no rows"),
    }


def test_junk_first_line(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Relatorio\ncpf;nome\n1;a\ncpf;nome\n")
    (tmp_path / "y.csv").write_text("Outro\ncpf;nome\n2;b\n")
    table = readers.read_lists(spark, str(tmp_path), skip_first_line=True)
    assert sorted((r.cpf, r.nome) for r in table.collect()) == [("1", "a"), ("2", "b"), ("cpf", "nome")]


def test_row_order_over_many_blocks(spark, tmp_path):
    lines = "\n".join(f"{n};v{n}" for n in range(20_000))
    (tmp_path / "big.csv").write_text(f"n;v\n{lines}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = readers.read_lists(spark, str(tmp_path))
        assert table.rdd.getNumPartitions() > 5
        assert [int(r.n) for r in table.orderBy(readers.ORDER).collect()] == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("line, sep", [("a;b,c;d", ";"), ("a,b", ","), ("a\tb\tc;d", "\t"), ("abc", ","), ("a;b,c", ";")])
def test_separator(line, sep):
    assert readers.find_separator(line) == sep


def test_sinks(spark, folder, tmp_path):
    table = readers.read_lists(spark, str(folder))
    writers.write_list(table, str(tmp_path / "bom"), bom=True)
    assert all(p.read_text().startswith("﻿cpf;nome;fone;uf\n") for p in (tmp_path / "bom").glob("*.csv"))
    writers.write_per_source(table, str(tmp_path / "per"), "limpo_")
    assert sorted(p.name for p in (tmp_path / "per").glob("source*")) == [f"source_file=limpo_{n}" for n in "abc"]
    writers.write_id_text(table.where("cpf <> ''"), "cpf", [readers.ORDER], str(tmp_path / "ids"), 3)
    assert sorted((p.parent.name, p.read_text().strip()) for p in (tmp_path / "ids").glob("*/*.txt")) == [("part=001", "012,9,8"), ("part=002", "7")]
    writers.convert_utf8(spark, str(folder), str(tmp_path / "utf8"))
    headers = {p.parent.name: p.read_text(encoding="utf-8").split("\n")[0] for p in (tmp_path / "utf8").glob("*/part-*")}
    assert headers == {"source_file=a_utf8": "cpf;nome;fone", "source_file=b_utf8": "cpf;nome;uf", "source_file=c_utf8": "cpf;nome;fone"}


def test_id_text(spark, tmp_path):
    (tmp_path / "k.txt").write_text(" 1 , 2,,3\n4\n")
    assert [r.CNPJ for r in readers.read_id_text(spark, str(tmp_path / "k.txt")).collect()] == ["1", "2", "3", "4"]


def read(spark, path):
    return spark.read.options(header=True, sep=";").csv(str(path))


def test_jobs(spark, folder, tmp_path):
    deny = tmp_path / "deny"
    deny.mkdir()
    (deny / "d.csv").write_text("CPF;numero\n9;55.0\n12;1\n")
    stats = jobs.remove_duplicates(spark, str(folder), "cpf", str(tmp_path / "o1")).first()
    assert (stats.rows, stats.unique_keys, stats.removed) == (5, 4, 0)
    jobs.remove_denied(spark, str(folder), str(deny), "cpf", "CPF", str(tmp_path / "o2"))
    assert {r.cpf for r in read(spark, tmp_path / "o2/side=blacklist").collect()} == {"012", "9"}
    figures = jobs.remove_denied_numbers_per_file(spark, str(folder / "a.csv"), str(deny), "numero", str(tmp_path / "o3"), "fone")
    assert [(r.rows_in, r.rows_removed, r.numbers_removed) for r in figures.collect()] == [(2, 1, 1)]
    jobs.split_in_parts(spark, str(folder), 2, str(tmp_path / "o4"))
    assert sorted(p.name for p in (tmp_path / "o4").glob("part=*")) == ["part=1", "part=2", "part=3"]
    counts = jobs.format_column(spark, str(folder), "cpf", str(tmp_path / "o5"), R.cpf_strict).first()
    assert (counts.filled, counts.blank) == (4, 1)
    jobs.merge_folder(spark, str(folder), str(tmp_path / "o6"))
    assert read(spark, tmp_path / "o6").count() == 5
    jobs.keep_columns_alpha(spark, str(folder), ["nome", "uf"], str(tmp_path / "o7"))
    assert {p.parent.name: p.read_text().split("\n")[0] for p in (tmp_path / "o7").glob("*/part-*")} == {
        "source_file=a": "A", "source_file=b": "A;B", "source_file=c": "A",
    }
    report = jobs.remove_duplicates_per_file(spark, str(folder), "uf", str(tmp_path / "o8"))
    assert {r.source_file: (r.status, r.rows) for r in report.collect()}["b.csv"] == ("ok", 2)
    jobs.enrich_folder_by_cpf(spark, str(folder), str(deny), "cpf", "CPF", str(tmp_path / "o9"))
    assert {p.name for p in (tmp_path / "o9/side=com_").glob("source*")} == {"source_file=com_a", "source_file=com_b"}


def test_call_job(spark, tmp_path):
    voip, dialer = tmp_path / "v", tmp_path / "d"
    voip.mkdir()
    dialer.mkdir()
    (voip / "v.csv").write_text("fone;inicio;price;seg\n5551999990001;01/02/2024 10:00:00;0,025;30\n51777;01/02/2024 10:00:00;1;1\n")
    (dialer / "d.csv").write_text("Relatorio\ntel;hora;seg;agente\n51999990001;01/02/2024 10:01:00;45;Ana\n51666;01/02/2024 10:00:00;60;Bia\n")
    merged, absent = jobs.match_calls(
        spark, str(voip), str(dialer), str(tmp_path / "out"), "fone", "inicio", "price", "seg", "tel", "hora", "seg",
        dialer_skip_first_line=True,
    )
    got = {r.fone: (r.agente, r.seg_voip, r.seg_discador) for r in read(spark, tmp_path / "out/mesclado_voip_discador").collect()}
    assert got == {"51999990001": ("Ana", "30", "45"), "51777": (None, "1", None)}
    assert {r.cohort: r.calls for r in merged.collect()} == {"all": 2, "unmatched": 1, "matched": 1}
    assert absent.first().charge == 0.05


def test_bank_job(spark, tmp_path):
    for name in ("base", "register", "table"):
        (tmp_path / name).mkdir()
    (tmp_path / "base/b.csv").write_text("cpf;Codigo_Banco\n1;280.0\n2;1\n3;9\n")
    (tmp_path / "register/r.csv").write_text("Código COMPE;Banco;Nome Completo;ISPB;Site\n1;BB;Banco do Brasil;00000000;\n")
    (tmp_path / "table/t.csv").write_text("﻿Código COMPE;Banco;Site\n280;Velho;\n280;Novo;\n1;Outro;\n")
    jobs.bank_names_layered(spark, str(tmp_path / "base"), str(tmp_path / "register"), str(tmp_path / "table"), str(tmp_path / "out"))
    got = sorted((r.cpf, r.nome_banco, r.ispb, r.fonte_informacao) for r in read(spark, tmp_path / "out").collect())
    assert got == [("1", "Novo", None, "CSV_LOCAL"), ("2", "BB", "00000000", "BRASIL_API"), ("3", None, None, None)]


def test_odd_file_names_and_line_breaks(spark, tmp_path):
    """Names with pattern characters and percent signs, quoted line breaks, ids with other white space."""
    for name, value in (("a[1].csv", "x"), ("a1.csv", "y"), ("50%.csv", "z"), ("p+q {1}.csv", "w")):
        (tmp_path / name).write_text(f'k;v\n1;"{value}\nnext ""line"""\n', encoding="utf-8")
    found = {(r.source_file, r.k, r.v) for r in readers.read_lists(spark, str(tmp_path)).collect()}
    assert found == {
        ("a[1].csv", "1", 'x\nnext "line"'), ("a1.csv", "1", 'y\nnext "line"'),
        ("50%.csv", "1", 'z\nnext "line"'), ("p+q {1}.csv", "1", 'w\nnext "line"'),
    }
    (tmp_path / "ids.txt").write_text("1,\t2, 3 ,,\n", encoding="utf-8")
    assert {r.CNPJ for r in readers.read_id_text(spark, str(tmp_path / "ids.txt")).collect()} == {"1", "2", "3"}


def test_id_text_in_one_stream(spark, tmp_path):
    ids = spark.range(1000).selectExpr("lpad(string(id), 5, '0') AS id", "id AS n")
    writers.write_id_text(ids, "id", ["n"], str(tmp_path / "all"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    assert text == "".join(f"{i:05d}," for i in range(1000))


def lists_of(spark, path, size=None, **how):
    """Rows of a folder in order, as the reader and as a reader of whole files has them."""
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = readers.read_lists(spark, str(path), **how)
        return rows, [tuple(r)[:-2] for r in rows.orderBy(readers.ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("sep, code", [(";", "utf-8"), (",", "cp1252"), ("\t", "utf-8")])
def test_line_breaks_in_values_of_one_large_file(spark, tmp_path, sep, code):
    """Every block cuts its own records; those that go over blocks come together."""
    import csv
    import random

    rng = random.Random(5)
    pieces = ["a", "ção", '"', "\n", "\n\n", sep, " ", '"\n"', "x" * 30, "'", "\r\n"]
    rows = [(str(i), "".join(rng.choices(pieces, k=rng.randrange(1, 9))) + ".", f"z{i}") for i in range(3000)]
    rows[1500] = ("1500", "long\n" * 4000 + "end", "z")  # over several blocks
    path = tmp_path / "one"
    path.mkdir()
    with open(path / "l.csv", "w", encoding=code, newline="") as f:
        writer = csv.writer(f, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        writer.writerows([("k", "v", "w"), *rows])
    table, found = lists_of(spark, path, 5000)
    assert found == rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert readers.read_lists(spark, str(path)).rdd.getNumPartitions() > 10
        assert readers.read_rejects(spark, str(path)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_with_and_without_line_breaks(spark, tmp_path):
    """Several headers, so blocks are sized anew for the files with line breaks; strays and empty values; a junk line."""
    (tmp_path / "a.csv").write_text('R\nk;v\n1;"x\ny"\n2;5" pipe\n3;"q"r\n4;""\n')
    (tmp_path / "b.csv").write_text("R\nk,w\n5,z\n")
    (tmp_path / "c.csv").write_text('R\nk;v\n"6";"""\n\n"""\n')
    rows = readers.read_lists(spark, str(tmp_path), skip_first_line=True)
    found = [(r.source_file, r.k, r.v, r.w) for r in rows.orderBy(readers.ORDER).collect()]
    assert found == [
        ("a.csv", "1", "x\ny", ""), ("a.csv", "2", '5" pipe', ""), ("a.csv", "3", '"q"r', ""), ("a.csv", "4", None, ""),
        ("b.csv", "5", "", "z"), ("c.csv", "6", '"\n\n"', ""),
    ]


def test_rejected_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;nome;uf\n1;ana;SP\n2;bia;20;30\n3\n4;eva;RS;;\n\n5;;\n")
    (tmp_path / "b.csv").write_text('id;nome;uf\n6;"um\ndois";SP\n7;"open;RJ\n8;x;MG\n')
    (tmp_path / "c.csv").write_text('id;nome;uf\n9;"a;b";PR\n')
    (tmp_path / "d.csv").write_text('id;nome;uf\n10;"a\nb";PR;"x\ny"\n')
    folder = readers.probe(spark, str(tmp_path))
    rows = readers.read_lists(spark, folder)
    assert [(r.id, r.nome, r.uf) for r in rows.orderBy(readers.ORDER).collect()] == [
        ("1", "ana", "SP"), ("3", None, None), ("4", "eva", "RS"), ("5", None, None), ("6", "um\ndois", "SP"), ("9", "a;b", "PR"),
    ]
    assert rows.count() == 6
    rejects = {(r.source_file, r.reason, r.lines, r.record) for r in readers.read_rejects(spark, folder).collect()}
    assert rejects == {
        ("a.csv", "long", 1, "2;bia;20;30"), ("a.csv", "short", 1, "3"), ("b.csv", "unclosed", 2, '"'),
        ("d.csv", "long", 3, '10;"a\nb";PR;"x\ny"'),
    }
    report = {r.source_file: (r.lines, r.short, r.long, r.unclosed, r.status) for r in readers.quality_report(spark, folder).collect()}
    assert report == {
        "a.csv": (7, 1, 1, 0, "rejected rows: 1"), "b.csv": (5, 0, 0, 1, "rejected rows: 1"),
        "c.csv": (2, 0, 0, 0, "ok"), "d.csv": (4, 0, 1, 0, "rejected rows: 1"),
    }


def test_equal_names_in_two_folders_and_old_line_ends(spark, tmp_path):
    for folder, end in (("x", "\r"), ("y", "\r\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "l.csv").write_bytes(end.join(["k;v", "1;a", "2;b", ""]).encode())
    table = readers.read_lists(spark, str(tmp_path / "*"))
    assert sorted((r.source_file, r.k, r.v) for r in table.collect()) == [
        ("x/l.csv", "1", "a"), ("x/l.csv", "2", "b"), ("y/l.csv", "1", "a"), ("y/l.csv", "2", "b"),
    ]
    assert {r.source_file: r.lines for r in readers.quality_report(spark, str(tmp_path / "*")).collect()} == {"x/l.csv": 3, "y/l.csv": 3}


def test_one_line_of_ids_is_read_by_many_tasks(spark, tmp_path):
    ids = spark.range(5000).selectExpr("lpad(string(id), 14, '0') AS id", "id AS n")
    writers.write_id_text(ids.coalesce(1), "id", ["n"], str(tmp_path / "all"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    (tmp_path / "one.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        back = readers.read_id_text(spark, str(tmp_path / "one.txt"))
        assert back.rdd.getNumPartitions() > 5
        assert sorted(r.CNPJ for r in back.collect()) == [f"{i:014d}" for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_several_headers_in_one_write(spark, tmp_path):
    """Line breaks, quotes, blanks and blank lines come back as they were, in file order, below their own header."""
    rows = {"a.csv": [("1", ' x "y"\n\n;z '), ("2", None), ("3", "ç")], "b.csv": [("9",), ("8",)]}
    names = {"a.csv": "id;v", "b.csv": "id"}
    for name, lines in rows.items():
        text = "".join(";".join('"' + (v or "").replace('"', '""') + '"' for v in line) + "\n" for line in lines)
        (tmp_path / name).write_text(names[name] + "\n" + text, encoding="utf-8")
    folder = readers.probe(spark, str(tmp_path))
    writers.write_per_source(readers.tables(folder), str(tmp_path / "out"), "novo_", clean=False)
    back = readers.read_lists(spark, str(tmp_path / "out" / "*"))
    found = [(r.source_file.split("/")[0], r.id, r.v) for r in back.orderBy(readers.ORDER).collect()]
    assert found == [
        ("source_file=novo_a", "1", 'x "y"\n\n;z'), ("source_file=novo_a", "2", None), ("source_file=novo_a", "3", "ç"),
        ("source_file=novo_b", "9", ""), ("source_file=novo_b", "8", ""),
    ]


def test_file_order_needs_no_exchange(spark, tmp_path):
    for n in range(4):
        lines = "".join(f'{n}-{i};"a\nb"\n' if i % 50 == 7 and n == 2 else f"{n}-{i};x\n" for i in range(300))
        (tmp_path / f"f{n}.csv").write_text("k;v\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        table = readers.read_lists(spark, str(tmp_path))
        numbered = order.number_file_rows(table, "n")
        expected = [f"{n}-{i}" for n in range(4) for i in range(300)]
        assert [r.k for r in numbered.orderBy("n").collect()] == expected
        assert [r.n for r in numbered.select("n").orderBy("n").collect()] == list(range(1, 1201))
        plain = readers.read_lists(spark, str(tmp_path / "f[013].csv"))
        parts = order.split_in_parts(plain, 250)
        text = parts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text and "Exchange range" not in text and "SortMergeJoin" not in text
        assert sorted(r["count"] for r in parts.groupBy("part").count().collect()) == [150, 250, 250, 250]
        # rows that were exchanged fall back to sorting
        moved = order.number_file_rows(plain.repartition(5, "k"), "n")
        assert [r.k for r in moved.orderBy("n").collect()] == [k for k in expected if not k.startswith("2")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_without_the_column_does_not_end_a_job(spark, tmp_path):
    base = tmp_path / "base"
    base.mkdir()
    (base / "a.csv").write_text("CPF;valor;tel\n1;2;51999990001\n1;3;51999990001\n2;1;51888880001\n")
    (base / "b.csv").write_text("nome;uf\nx;RS\n")
    deny = tmp_path / "deny"
    deny.mkdir()
    (deny / "d.csv").write_text("num\n51888880001\n")
    report = jobs.keep_largest_per_file(spark, str(base), "CPF", "valor", str(tmp_path / "o1"))
    assert {r.source_file: r.status for r in report.collect()} == {"a.csv": "ok", "b.csv": "missing columns: CPF, valor"}
    assert read(spark, tmp_path / "o1").count() == 2
    figures = jobs.remove_denied_numbers_per_file(spark, str(base), str(deny), "num", str(tmp_path / "o2"))
    found = {r.source_file: (r.status, r.rows_in, r.rows_removed) for r in figures.collect()}
    assert found == {"a.csv": ("ok", 3, 1), "b.csv": ("no fitting column", None, None)}
    report = jobs.enrich_folder_by_cpf(spark, str(base), str(base / "a.csv"), "CPF", "CPF", str(tmp_path / "o3"))
    assert {r.source_file: r.status for r in report.collect()}["b.csv"] == "missing columns: CPF"


def test_a_job_scans_a_folder_twice(spark, tmp_path, monkeypatch):
    """The probe reads all bytes once, and so do the rows; the report and the rows share the probe."""
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_text("CPF;v\n1;2\n")
    scans = []
    for name in ("text_lines", "_scan"):
        real = getattr(readers, name)
        monkeypatch.setattr(readers, name, lambda *a, _real=real, _name=name, **k: scans.append(_name) or _real(*a, **k))
    folder = readers.probe(spark, str(tmp_path))
    assert len(folder.readings) == 1 and len(folder.readings[0].paths) == 3  # one row at the driver for three equal files
    assert readers.read_lists(spark, folder).count() == 3
    assert scans == ["text_lines", "_scan"]
