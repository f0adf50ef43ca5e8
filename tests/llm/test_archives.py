import hashlib

import pytest
from pyspark.sql import functions as F

from roster.llm import warc


def expected(rows):
    best = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            best[data] = max(page, best.get(data, page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        owner = best.get(data) if [h for _, h in rows].count(html) > 1 else None
        again = owner is not None and owner != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def record(kind, length, payload):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: {length}\r\n\r\n{payload}\r\n\r\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_round_trip_with_magic_in_payloads(spark, small_splits):
    fake = record("response", 5, "hello")
    rows = [(i, f"<html>é😀 {i} " + "x" * (37 * i % 2500)) for i in range(60)]
    rows += [
        (100, fake), (101, "start " + fake * 3 + " end"), (102, "WARC/1.1\r\n" * 5), (103, "a\r\n\r\nWARC/1.1\r\n\r\n"),
        (104, "y" * 1500 + fake), (105, record("response", 10**6, "cut")), (106, ""), (107, None), (108, "WARC/1.1\r\n"),
        (109, fake + "z" * 9000 + fake), (110, "\r\n\r\n"), (111, "x" * 999), (112, "x" * 999), (113, "ä" * 500), (114, "ä" * 500),
    ]
    rows += [(200 + i, "same " * 300) for i in range(40)]
    pages = spark.createDataFrame([(p, f"http://h/{p}\r\nX: y", h) for p, h in rows], "page_id long, url string, html string")
    found = warc.round_trip(pages.withColumn("offset", F.lit(1)).repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None), (1, None, "b" * 2000), (1, None, "b" * 2000), (0, "u", "b" * 2000), (None, "u", "b" * 2000)]
    found = sorted((tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect()), key=str)
    kinds = [(r[0], r[1], r[3], r[4]) for r in found]
    assert kinds == [(0, 2000, "revisit", 1), (1, 2000, "response", None), (1, 2000, "response", None), (None, 0, "response", None), (None, 2000, "revisit", 1)]


def test_chain_follows_only_pointers_from_the_start(spark):
    steps = [("f", 10 * i, 10 * i + 10) for i in range(37)] + [("f", 5, 15), ("f", 15, 20), ("g", 0, 7), ("g", 8, 9), ("h", 3, 4)]
    found = warc.chain(spark.createDataFrame(steps, "file string, offset long, next long")).collect()
    assert sorted((r.file, r.offset) for r in found) == [("f", 10 * i) for i in range(37)] + [("g", 0)]
