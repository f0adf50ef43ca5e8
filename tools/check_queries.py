"""Run every query and its SQL on the same tables and compare rows, columns and values.

    python tools/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from queries import ORACLES, QUERIES  # noqa: E402
from roster.session import local_session  # noqa: E402


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value."""
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first", ignore_index=True) if len(frame.columns) else frame


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    ours, theirs = normal(ours), normal(theirs)
    for name in ours.columns:
        a, b = ours[name], theirs[name]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).to_numpy().argmax()
            return f"{name}: {a[at]!r} != {b[at]!r} ({(~same).sum()} rows)"
        if str(a.dtype) != str(b.dtype):
            return f"ok, but {name} is {a.dtype} here and {b.dtype} there"
    return "ok"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            ours = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            verdict = compare(ours, db.execute(ORACLES[name]).df()) if name in ORACLES else "no SQL"
            rows = len(ours)
        except Exception as error:  # one failing query must not hide the others
            verdict, rows, took = f"{type(error).__name__}: {str(error)[:600]}", 0, time.time() - start
        bad += not verdict.startswith(("ok", "no SQL"))
        print(f"{'  ' if verdict == 'ok' else '! '}{name:26} {rows:7} rows {took:6.2f} s  {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
