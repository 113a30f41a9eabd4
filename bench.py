"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. One small query warms the session up;
each query then runs once and is read in full.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.queries import QUERIES  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINE = [
    "column_profile_lineitem", "column_profile_orders", "column_profile_documents", "duplicate_rows_all_tables", "value_kinds",
    "quality_flags", "mapping_checks", "corrected_mapping", "typed_load_lineitem", "reconciliation_lineitem",
    "content_digests", "keyed_differences", "orphan_rows", "schema_drift", "run_folds", "trailing_run_counts",
    "attempt_history", "refinement_decisions", "best_runs", "baseline_medians", "timing_stats", "delimited_to_parquet",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    QUERIES["column_profile_labels"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
