"""Summarize the physical plan of every registered query (for PLANS.md).

usage: python tools_plans.py [sf_dir] > PLANS.md
Broadcast is switched off so the plans show the at-scale shape (per-contract
aggregates of a 100 TB store are far above any broadcast threshold).
"""

from __future__ import annotations

import re
import sys

from covenant.plans.catalog import REGISTRY
from covenant.session import get_spark


def summarize(plan: str) -> dict:
    own = "\n".join(line for line in plan.splitlines() if "ReusedExchange" not in line)
    return {
        "hash_exch": len(re.findall(r"Exchange hashpartitioning", own)),
        "range_exch": len(re.findall(r"Exchange rangepartitioning", own)),
        "single_exch": len(re.findall(r"Exchange SinglePartition", own)),
        "reused": plan.count("ReusedExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "partial_agg": len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan)),
        "window": plan.count("Window ["),
        "scans": plan.count("FileScan parquet"),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "python": plan.count("EvalPython") + plan.count("InPandas"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # show the static plan
    cols = ["hash_exch", "range_exch", "single_exch", "reused", "smj", "bhj", "partial_agg", "window", "scans", "pushed",
            "python"]
    print("# PLANS\n")
    print("Physical plan shape of every registered query (`python tools_plans.py`), broadcast off and AQE off, i.e.")
    print("the static plan a 100 TB run starts from (AQE then coalesces partitions and splits skewed joins).")
    print("`single_exch` appears only for global aggregates and for ranks over locations or days (bounded rows);")
    print("`reused` counts exchanges Spark computes once and reads again. Operators that write an intermediate (positions,")
    print("running totals, ranks, the item store that command batches are applied to) show the plan above the written table.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name in sorted(REGISTRY):
        if name.startswith("stream_"):
            continue   # runs a streaming query when called; its plan is a file scan of the deltas
        plan = REGISTRY[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    co_located(spark, sf, cols)


def co_located(spark, sf, cols):
    """The per-contract queries over the same tables written with ``write_bucketed``."""
    import tempfile

    from covenant.operators import analytics as A
    from covenant.operators import profile as P
    from covenant.sources.binding import load_tables
    from covenant.sources.store import write_bucketed
    b = write_bucketed(spark, load_tables(spark, sf), tempfile.mkdtemp(prefix="plans-bucketed-"), 16)
    print("\n## Co-located store (`write_bucketed`, 16 buckets)\n")
    print("The same operators over contracts, events and ledger bucketed by contract id: the per-contract")
    print("aggregations and joins need no exchange; what remains is the per-location aggregate and the bounded sort.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, df in (("location_dashboard", A.location_dashboard(b)), ("risk_analysis_fanout", A.risk_analysis_fanout(b)),
                     ("risk_analysis", A.risk_analysis(b)), ("fanout_join_metrics", A.fanout_join_metrics(b)),
                     ("location_dashboard_joined", A.location_dashboard_joined(b)), ("audit_latest", P.audit_latest(b))):
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
