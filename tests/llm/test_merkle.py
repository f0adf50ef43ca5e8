import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from roster.llm import merkle, ranks
from roster.llm.common import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout=16):
    """The root of a list of digests, and of each the siblings (left, right) on its way there."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(place):
            run = at // fanout * fanout
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        place = [at // fanout for at in place]
    return (level[0] if level else None), paths


def order(value):
    return (value is not None, value if value is not None else 0)


def expected(rows):
    """By plain lists: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: sorted(((r, leaf(r)) for r in groups[s]), key=lambda x: (order(x[0][0]), x[1])) for s in names}
    trees = {s: tree([h for _, h in low[s]]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for (row, h), path in zip(low[s], trees[s][1]):
            path = path + upper[at]
            now = h
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = row[4]
                now = leaf((*row[:4], None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
            for left, right in path:
                now = sha(left + now + right)
            out.append((row[0], h, trees[s][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def found(docs):
    lowered = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted((tuple(r) for r in merkle.verified(docs, {"text": lowered}, touched).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [300, 1, 15, 16, 17, 257], [2] * 20])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(i * 7 % 1000 + 1000 * s, f"s{s:02}", "en", i, f"Text {i} É") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(docs) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (None, None, None, None, ""), (1, "", "x", 0, "A\nB"), (1, "", "x", 0, "A\nB"),
        (1, "", "x", 0, "b"), (-5, "é", None, -1, "😀 " * 9000), (10**15, "z", "x", 2, "ABC"), (3, "Z", "x", 2, "abc"), (None, "Z", "x", 2, "ABC"),
    ] + [(7, "same", "l", 1, "COPY")] * 40
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("leaf", "now", "path", "root", "_h", "_place", "subroot")})
    assert found(clashing) == expected(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_values_do_not_run_into_each_other(spark):
    rows = [(1, "a", "b", 1, "c"), (1, "a", "b1:c", 1, ""), (1, "a", None, 1, "c"), (1, "a", "-", 1, "c"), (1, "a", "", 1, "c")]
    assert len({r[1] for r in found(spark.createDataFrame(rows, SCHEMA))}) == len(rows)


def test_any_change_is_seen(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"t{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for changed, when in (({"n_chars": F.lit(2)}, F.col("doc_id") == 31), ({"lang": F.lit(None).cast("string")}, F.col("doc_id") == 31)):
        bad = [r.doc_id for r in merkle.verified(docs, changed, when).where("NOT verified").collect()]
        assert bad == [31]


def test_small_fanout_and_proofs(spark):
    rows = [(i, "g" if i % 2 else None, hashlib.sha256(bytes([i])).hexdigest()) for i in range(23)]
    leaves = spark.createDataFrame(rows, "k int, g string, h string")
    got = merkle.proofs(leaves, "g", "k", "h", fanout=3).withColumn("r", merkle.fold(F.col("h"), F.col("path"))).collect()
    assert len(got) == 23 and {r.r for r in got} == {got[0].root}
    for group in (None, "g"):
        want, paths = tree([h for _, g, h in rows if g == group], 3)
        mine = sorted((r.k, r.subroot, [tuple(p) for p in r.path]) for r in got if r.g == group)
        assert {m[1] for m in mine} == {want} and [m[2][: len(p)] for m, p in zip(mine, paths)] == paths
    with pytest.raises(ValueError):
        merkle.proofs(leaves, "g", "k", "h", fanout=1)


def test_places_in_groups(spark):
    """A hot group and many equal rows are spread over tasks; places are still exact."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, 'g' || id % 50) AS g", "if(id % 2 = 0, 5, id) AS k").repartition(7)
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    got = ranks.ranked(kept, ["k"], ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.place, r.k, r.size))
    for group in by.values():
        group.sort()
        assert [p for p, _, _ in group] == list(range(len(group))) and {s for _, _, s in group} == {len(group)}
        assert [k for _, k, _ in group] == sorted(k for _, k, _ in group)


def test_query_is_registered():
    assert {"op11_spelling", "op12_manifest", "op13_url_filters"} <= set(QUERIES)
