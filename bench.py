"""Benchmark of the headline queries.

Runs each query of ``HEADLINE`` over the tables in ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON
line: total seconds (``value``) and per-query seconds.  Every query is
executed in full through the ``noop`` sink (no collect to the driver); each
is run ``$BENCH_REPS`` times (default 2) and the fastest run is kept, after
one warm-up query that pays JVM start-up and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assetlens.plans.queries import QUERIES  # noqa: E402
from assetlens.session import get_session  # noqa: E402

HEADLINE = [
    "summary_with_total", "summary_filtered", "metric_cards", "dashboard_grouping_sets", "count_units",
    "top_units_value", "top_agencies_value", "top_agencies_count", "place_layer", "filter_agency_semi",
    "unit_overview", "search_rows", "facet_options", "k3_rows", "problem_pivot", "completion_summary",
    "composition", "merge_spans", "achievement_kpis", "igt_kpi", "informative_columns", "sheet_roundtrip",
    "header_uniqueness", "latest_good_snapshot",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="assetlens-bench",
                        extra={"spark.driver.memory": "16g"})
    run(QUERIES["metric_cards"](spark, sf_dir))  # warm-up
    times = {}
    for name in names:
        best = None
        for _ in range(reps):
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
