"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional).  Every query is executed in full with
the ``noop`` sink (no collect), after forgetting stored dimension tables so
each timing includes all of its own work.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from railpulse.plans import queries as Q  # noqa: E402
from railpulse.session import get_spark  # noqa: E402

HEADLINE = [
    "q_latest_per_train",   # C2 latest row per train (window group limit)
    "q_resolve_names",      # C3 fuzzy resolution without a theta join
    "q_apply_times",        # C19-C22 edge + travel-time build (ordered folds)
    "q_train_features",     # C10 flagship end to end
    "q_coverage_summary",   # C13 diagnosis
    "q_trajectory",         # C14 time grid
    "q_overlap_spread",     # C17
    "q_flatten_xml",        # C1 XML -> rows
    "q_eta_reconcile",      # C15 keyed state fold
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_spark(app="railpulse-bench", master=f"local[{cpus}]",
                      shuffle_partitions=int(cpus) * 2)
    # warm up the JVM and the parquet readers (not timed)
    Q.QUERIES["q_countdown"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        if name not in Q.QUERIES:
            continue
        Q.clear_tables()
        t = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
