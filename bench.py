"""Benchmark the headline marts on one driver directory; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_QUERIES (comma list; default the headline set). Each query is fully materialised with the
``noop`` sink (all rows computed, nothing collected); the reported time per query is the best of
BENCH_RUNS runs, ``value`` is their sum. One small query runs first, uncounted, to warm up the JVM.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arrears.catalog import QUERIES, load_all  # noqa: E402
from arrears.session import local_session  # noqa: E402

HEADLINE = [
    "strategy_effectiveness_7d",  # C1
    "last_contact_payment_5d",  # C2
    "promise_funnel",  # C3
    "collection_summary",  # C4
    "feature_mart",  # C6
    "top20_contacted_unpaid",  # C7
    "tests_table",  # C5
    "segment_model_metrics",  # M12
    "strategy_comparison",  # B3
    "psi_bins",  # B4
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    load_all()
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))  # sets a checkpoint dir only if unset
    # one uncounted run first: JVM class loading and JIT warm-up would otherwise land on query 1
    QUERIES["cases_by_strategy"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_marts_total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
                "cpus": cpus,
                "runs": runs,
                "stat": "min",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
