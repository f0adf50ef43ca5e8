"""Every query against its SQL at the smallest scale."""

import importlib.util
from pathlib import Path

import pytest

from queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


def load(path):
    spec = importlib.util.spec_from_file_location(path.stem.strip("_"), path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def check():
    return load(ROOT / "tools/check_queries.py")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def test_entry(spark):
    entry = load(ROOT / "__spark_entry__.py")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, check, name):
    ours = QUERIES[name](spark, str(FOLDER)).toPandas()
    assert name not in ORACLES or check.compare(ours, db.execute(ORACLES[name]).df()).startswith("ok")


def test_queries_run_from_another_folder(tmp_path):
    """Workers don't find the package by their folder or path; its functions are sent to them."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from queries import QUERIES
from roster.session import local_session
spark = local_session("elsewhere", 2, "2g")
for name in ("match_calls", "values_with_line_breaks", "column_preview", "several_headers_written"):
    assert QUERIES[name](spark, {str(FOLDER)!r}).count() > 0
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
