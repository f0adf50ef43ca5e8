"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1). BENCH_CPUS: local cores (default 8).
Each query runs once to warm up and then three times; the median counts. Every result row is
produced (sink ``noop``), nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from queries import QUERIES  # noqa: E402
from roster.session import local_session  # noqa: E402

HEADLINE = (
    "dedup_first", "dedup_max", "dedup_per_source", "deny_split", "allow_split", "mask_numbers",
    "denied_numbers_report", "enrich_matched", "company_join", "fill_by_name", "bank_layered",
    "match_calls", "call_report", "price_report", "recompute_totals", "parse_br_number", "age",
    "split_parts", "page_links", "mixed_folder",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
        "cores": int(cores) if cores.isdigit() else cores,
    }))


if __name__ == "__main__":
    main()
