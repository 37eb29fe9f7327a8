"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from check import session
from workload.queries import REGISTRY

HEADLINE = (
    "compare_keyed",
    "compare_keyed_composite",
    "compare_keyed_join_strategy",
    "compare_row_order",
    "ge_compare",
    "compare_one_to_many",
    "expected_standard",
    "expected_expansion",
    "summary_report",
    "mismatch_breakdown",
    "result_page",
    "row_numbers",
    "norm_text",
    "norm_all_options",
    "scan_csv",
    "export_results",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    for name in ("compare_keyed", "norm_text"):
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
