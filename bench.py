"""Times the headline queries and prints one JSON line.

Every run plans and computes its query anew: nothing is kept from the run before. A query is run once to warm the JVM
up, and the best of the following runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from outpulse.registry import QUERIES  # noqa: E402
from outpulse.session import build_session  # noqa: E402

HEADLINE = [
    "organizations",
    "candidate_mart",
    "feed_parse_json",
    "scd2_history",
    "scd2_incremental",
    "event_observations",
    "event_lifecycle",
    "source_reliability",
    "upsert_final_state",
    "request_feasible",
    "request_scores",
    "request_explained",
    "favorites_flag",
    "quality_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app_name="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus) if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        best = None
        for run in range(repeats + 1):
            spark.catalog.clearCache()
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if run and (best is None or took < best):
                best = took
        timings[name] = round(best, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
