"""Benchmark: headline queries over the derived run tables at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query seconds), "unit", "queries", "sf"}.
Each query is timed end to end (plan + full execution, result consumed with a count-free
``write.format("noop")`` so nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_error_report", "daily_error_report_rootmode", "error_report_all_projects", "error_summary",
    "error_detail", "error_detail_summary", "error_signatures", "symbol_of_run",
    "storage_stats", "recent_runs", "qualified_traces", "dedup_requests",
    "dataset_token_name", "dataset_website", "dataset_availability",
    "curate_best_100", "upsert_latest", "flatten_children",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from runlens.plans import catalog
    from runlens.session import build_session
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    # warm-up: JVM, codegen caches and the parquet footers of the inputs
    catalog.QUERIES["storage_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
