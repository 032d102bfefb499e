"""Wall time of the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3, best run is reported). Each query is executed in
full through the ``noop`` sink (no collect to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from covenant.session import get_spark  # noqa: E402
from covenant.plans.catalog import REGISTRY  # noqa: E402

HEADLINE = [
    "location_dashboard",          # scenario 2 (flagship)
    "location_dashboard_items",    # scenario 2, item-store form
    "risk_analysis_fanout",        # scenario 5
    "location_profitability",      # benchmark 5
    "location_dashboard_joined",   # benchmark 2
    "profile_joined",              # scenario 1 / benchmark 1
    "profile_full",
    "batch_get",                   # scenario 4
    "apply_commands_ledger",       # scenario 3 (write bundle)
    "audit_after_commands",
    "running_totals",
    "parity_ledger",
    "parity_contracts",
    "summary_stats",
    "two_sample_ttest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_spark(f"local[{cpus}]", app="covenant-bench", shuffle_partitions=max(8, 2 * cpus))
    # warm-up: JVM, code paths, file listing
    REGISTRY["location_dashboard"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for name in HEADLINE:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as ex:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = str(ex).splitlines()[0][:200]
            print(f"bench: {name} failed: {failed[name]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_wall_time_headline_queries", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
