"""Plan-shape regression tests: the properties the at-scale design relies on."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_dimension_broadcast_and_pruned_scans(spark, no_auto_broadcast):
    p = plan(spark, "location_dashboard")
    assert "BroadcastHashJoin" in p                       # nation, behind the row-count check
    assert "hashpartitioning(c_nationkey" not in p        # customers never shuffled by nation
    customer_schema = re.search(r"customer\.parquet.*?ReadSchema: (struct<[^>]*>)", p, re.S).group(1)
    assert "c_name" not in customer_schema and "c_acctbal" not in customer_schema
    assert "partial_sum" in p                             # map-side pre-aggregation of the ledger


def test_fanout_is_never_built(spark, no_auto_broadcast):
    p = plan(spark, "risk_analysis_fanout")
    # both child tables are aggregated before any join with the contracts
    assert p.count("partial_count") >= 2
    joins = p.count("SortMergeJoin") + p.count("BroadcastHashJoin")
    assert joins == 3                                     # nation, event stats, ledger stats


def test_lookups_push_filters_into_parquet(spark):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_custkey,", plan(spark, "point_get"))
    p = plan(spark, "lookup_by_date")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,[^\]]*LessThan\(ts,", p)
    p = plan(spark, "batch_get")
    assert "LeftSemi" in p


def test_positions_are_sliced_not_grouped_whole(spark):
    p = plan(spark, "summary_stats_sorted")
    # the slices were range-partitioned and written: the numbering scans them
    assert "rangepartitioning" not in p and re.search(r"FileScan parquet \[[^\]]*_slice[^\]]*\][^\n]*positions-", p)
    numbering = [line for line in p.splitlines() if "Window [row_number()" in line]
    assert numbering
    for line in numbering:
        # a row-numbering window partitioned by the slice as well as the group
        partition_spec = line.split("], [")[1]
        assert "_slice" in partition_spec, line


def test_no_python_and_no_cartesian(spark):
    for name in ("location_dashboard", "parity_ledger", "apply_commands_items", "summary_stats", "audit_latest"):
        p = plan(spark, name)
        assert "EvalPython" not in p and "InPandas" not in p
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_co_located_store_needs_no_exchange(spark, no_auto_broadcast):
    import tempfile

    from covenant.operators.analytics import fanout_join_metrics
    from covenant.operators.profile import audit_latest
    from covenant.sources.binding import load_tables
    from covenant.sources.store import write_bucketed
    b = write_bucketed(spark, load_tables(spark, SF), tempfile.mkdtemp(prefix="plans-colocated-"), 8)
    for df in (fanout_join_metrics(b), audit_latest(b)):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in p, p


def test_parity_summary_counts_the_events(spark, monkeypatch):
    from covenant.plans import catalog
    from covenant.sources.binding import right_store
    right = right_store(catalog._t(spark, SF))
    drifted = right.with_(events=right.events.where("id % 50 <> 0"))

    def mismatches():
        return (catalog.REGISTRY["parity_summary"](spark, SF).first()["mismatches"],
                catalog.REGISTRY["parity_issue_counts"](spark, SF).where("n_issues > 0").agg({"n_issues": "sum"}).first()[0])

    same = mismatches()
    monkeypatch.setattr(catalog, "_r", lambda s, d: drifted)
    assert mismatches()[0] > same[0] and mismatches()[1] > same[1]


def test_replay_checks_never_shuffle_the_store(spark, no_auto_broadcast):
    p = plan(spark, "apply_commands_events")
    assert "hashpartitioning(id#" not in p.replace("_held_", "") or "LeftSemi" in p
    assert re.search(r"BroadcastHashJoin \[[^\]]*\], \[[^\]]*\], LeftSemi", p)
