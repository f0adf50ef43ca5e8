"""The pipeline against its stages' own contracts, and the queries against their SQL."""

from pathlib import Path

import pytest

import corpus_pipeline
from roster.llm import ORACLES, QUERIES
from roster.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def test_stages(spark):
    from test_join import brute
    from test_mixing import brute_targets
    from test_packing import check
    from test_texts import base_spans

    docs = table(spark, FOLDER, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        kept.append(docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or tuple(docs.columns) == corpus_pipeline.COLUMNS
    classified, single, clean, mixed, packed = kept
    assert 0 < len(single) <= len(classified)
    classes = brute([(r.doc_id, r.text) for r in classified])
    assert sorted(r.doc_id for r in single) == sorted({c for c, _ in classes.values()})
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single)
    assert not any(base_spans(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    sizes = {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    target, taken = brute_targets(sizes), {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, want in target.items():
        assert abs(taken.get(source, 0) - want) <= max(len(r.text.split()) for r in clean if r.source == source)
    check(packed, [(r.doc_id, r.text) for r in mixed])


def test_run_returns_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, FOLDER).columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(ORACLES[name]).df()[list(ours.columns)]
    key = ours.columns[0]
    ours, theirs = (x.sort_values(key, ignore_index=True).astype(object).where(lambda y: y.notna(), None) for x in (ours, theirs))
    assert ours.equals(theirs)


def test_names():
    assert [int(n.split("_")[0][2:]) for n in sorted(QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == list(range(1, 14))
