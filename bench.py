"""Time the headline queries at ``$BENCH_SF_DIR``; prints one JSON line.

Each query runs once untimed on the smallest tables (class loading, code generation),
then ``$BENCH_RUNS`` times on the timed folder; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "treatment_episodes", "user_type", "asof_latest", "asof_nearest", "asof_timestamp", "baseline_labs_wide",
    "phenotype_onset", "interval_overlap_count", "clean_labs", "median_disc", "baseline_table", "tv_asof",
    "tv_overlap_cumulative", "table_one", "ps_logistic", "risk_curves",
]
WARM_DIR = "/root/testdata/sf0.001"


def main() -> None:
    from cohortweave.catalog import QUERIES
    from cohortweave.session import build_local

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_local(cores, memory=os.environ.get("BENCH_MEMORY", "12g"), partitions=int(cores), name="bench")
    warm = WARM_DIR if os.path.isdir(WARM_DIR) else folder

    def run(name: str, where: str) -> None:
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name, warm)
        seen = []
        for _ in range(runs):
            began = time.perf_counter()
            run(name, folder)
            seen.append(time.perf_counter() - began)
        times[name] = round(statistics.median(seen), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
