import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from covenant.operators.lookups import batch_get, readiness, resolve_ids, table_inventory
from covenant.sources.generate import generate, validate_counts
from covenant.sources.history import run_by_name, run_history
from covenant.sources.store import read_store, resolve_targets, write_store
from tests.conftest import SF, make_tables


def test_generator_counts_and_rules(spark):
    t = generate(spark, contracts=40, events_per_contract=5, ledger_entries=100, seed=7, loss_fraction=0.3)
    assert (t.contracts.count(), t.events.count(), t.ledger.count()) == (40, 200, 100)
    c = t.contracts.orderBy("id").first()
    assert c["id"].endswith("_001") or c["id"].split("_")[-1].isdigit()
    first = t.events.where(F.col("description") == "Contract Created").count()
    assert first == 40
    amounts = [r["amount"] for r in t.ledger.collect()]
    assert all(1 <= abs(a) <= 1000 for a in amounts) and any(a < 0 for a in amounts)
    again = generate(spark, contracts=40, events_per_contract=5, ledger_entries=100, seed=7, loss_fraction=0.3)
    assert again.ledger.exceptAll(t.ledger).count() == 0      # deterministic


def test_generator_count_validation():
    with pytest.raises(ValueError):
        validate_counts(0, 1, 1)
    assert validate_counts("3", 0, 0) == (3, 0, 0)


def test_run_history(spark):
    d = tempfile.mkdtemp(prefix="hist-")
    with open(os.path.join(d, "benchmark-results-1.json"), "w") as f:
        f.write('{"timestamp": "2025-01-01T00:00:00Z", "summary": {"x": 1}}')
    with open(os.path.join(d, "contrast-benchmark-2.json"), "w") as f:
        f.write("{bad")
    now = time.time()
    os.utime(os.path.join(d, "benchmark-results-1.json"), (now - 60, now - 60))   # older
    os.utime(os.path.join(d, "contrast-benchmark-2.json"), (now, now))            # newer
    with open(os.path.join(d, "other.json"), "w") as f:
        f.write("{}")
    rows = run_history(spark, d).collect()
    assert [r["filename"] for r in rows] == ["contrast-benchmark-2.json", "benchmark-results-1.json"]
    assert rows[0]["error"] == "Failed to parse" and rows[1]["summary"] == '{"x":1}'
    assert run_by_name(spark, d, "benchmark-results-1.json").count() == 1
    with pytest.raises(ValueError):
        run_by_name(spark, d, "../x.json")


def test_inventory_and_readiness(spark):
    inv = table_inventory(spark, SF, ["customer", "no_such_table"])
    r = {x["table_name"]: x for x in inv.collect()}
    assert r["customer"]["present"] and r["customer"]["row_count"] > 0
    assert not r["no_such_table"]["present"] and r["no_such_table"]["row_count"] is None
    assert readiness(inv).first()["ready"] is False
    assert readiness(table_inventory(spark, SF, ["nothing_a", "nothing_b"])).first()["ready"] is True


def test_store_versions_and_bounded_files(spark):
    t = make_tables(spark, [(i, "Bound", "Evil", "X", None) for i in range(10)], [],
                    [(i, i % 10, 1, "2024-01-01 00:00:00", "x") for i in range(100)])
    base = tempfile.mkdtemp(prefix="store-")
    root = write_store(spark, base, 1, tables=t, targets={"normalized"}, max_records_per_file=30)
    files = [f for f in os.listdir(f"{root}/ledger") if f.endswith(".parquet")]
    assert len(files) >= 4
    assert read_store(spark, base).ledger.count() == 100
    write_store(spark, base, 2, tables=t.with_(ledger=t.ledger.limit(5)), targets={"normalized"})
    assert read_store(spark, base).ledger.count() == 5


def test_targets():
    assert resolve_targets() == {"items", "normalized"}
    assert resolve_targets("NORMALIZED") == {"normalized"}
    assert resolve_targets("normalized", items_only=True) == {"items"}
    assert resolve_targets(normalized_only=True, items_only=True) == {"items"}
    assert resolve_targets("items", skip_items=True) == set()


def test_count_fallbacks():
    from covenant.sources.generate import resolve_counts
    assert resolve_counts() == (1000, 50, 5000)
    assert resolve_counts("20", 0, "x") == (20, 0, 5000)
    assert resolve_counts(0, -1, 7) == (1000, 50, 7)


def test_lookups(spark):
    t = make_tables(spark, [(i, "Bound", "Evil", "X", None) for i in range(5)], [], [])
    assert batch_get(t.contracts, [3, 3, 99, 1]).count() == 2
    ids = spark.createDataFrame([(3,), (3,), (99,)], "id long")
    assert batch_get(t.contracts, ids).count() == 1
    assert [r["id"] for r in resolve_ids(t.contracts, ids=[4, 2, 4]).orderBy("pos").collect()] == [4, 2]
    assert resolve_ids(t.contracts, sample_size=2).count() == 2


def test_write_chunked_and_missing_tables(spark):
    from covenant.operators.lookups import missing_tables
    from covenant.sources.store import write_chunked
    d = tempfile.mkdtemp(prefix="chunk-")
    write_chunked(spark.range(10000).coalesce(1), f"{d}/t", 3000)
    assert len([f for f in os.listdir(f"{d}/t") if f.endswith(".parquet")]) == 4
    inv = table_inventory(spark, SF, ["customer", "gone"])
    assert [r[0] for r in missing_tables(inv).collect()] == ["gone"]


def test_clustered_day_partitioned_store(spark):
    from covenant.operators.lookups import lookup_by_date, point_get
    from covenant.sources.binding import load_tables
    t = load_tables(spark, SF)
    base = tempfile.mkdtemp(prefix="store-layout-")
    write_store(spark, base, 1, tables=t, targets={"normalized"}, cluster=True, partition_by_day=True,
                num_partitions=4)
    s = read_store(spark, base)
    q = lookup_by_date(s.events, "event_time", "2024-01-15")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_time_date" in plan
    assert q.count() == lookup_by_date(t.events, "event_time", "2024-01-15").count()
    # range-clustered contracts: each file covers a disjoint id range
    files = (s.contracts.select(F.col("_metadata.file_name").alias("f"), "id").groupBy("f")
             .agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect())
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:]))
    assert point_get(s.contracts, {"id": 5}).count() == 1


def test_size_checked_broadcast(spark):
    from covenant.plans.sizing import bounded_count, broadcast_if_small
    small = spark.range(10)
    big = spark.range(1000)
    assert bounded_count(big, 100) == 101                       # stops counting past the bound
    facts = spark.range(5000).withColumn("k", F.col("id") % 10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(facts.join(broadcast_if_small(small, 100), facts.k == small.id))
        assert "BroadcastHashJoin" not in plan(facts.join(broadcast_if_small(big, 100), facts.k == big.id))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_bucketed_store_joins_without_shuffles(spark):
    from covenant.operators.analytics import risk_analysis_fanout
    from covenant.sources.binding import load_tables
    from covenant.sources.store import read_bucketed, write_bucketed
    t = load_tables(spark, SF)
    base = tempfile.mkdtemp(prefix="bucketed-")
    b = write_bucketed(spark, t, base, 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = risk_analysis_fanout(b)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" not in plan and "hashpartitioning(soul_contract_id" not in plan
        assert "SortMergeJoin" in plan
        assert sorted(map(tuple, q.collect())) == sorted(map(tuple, risk_analysis_fanout(t).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # as in a new session: forget the tables (external, so the files stay) and reopen
    from covenant.sources.store import _bucket_table
    for n in ("contracts", "events", "ledger"):
        spark.sql(f"DROP TABLE {_bucket_table(base, n)}")
    again = read_bucketed(spark, base, 8)
    assert again.ledger.count() == t.ledger.count()
    assert "hashpartitioning(soul_contract_id" not in \
        risk_analysis_fanout(again)._jdf.queryExecution().executedPlan().toString()


def test_bucketed_store_plain_read_for_skew(spark):
    from covenant.sources.binding import load_tables
    from covenant.sources.store import read_bucketed, write_bucketed
    from covenant.operators.analytics import risk_analysis_fanout
    t = load_tables(spark, SF)
    base = tempfile.mkdtemp(prefix="bucketed-plain-")
    write_bucketed(spark, t, base, 4, max_records_per_file=100)     # ~375 ledger rows per bucket
    ledger_files = [f for f in os.listdir(f"{base}/ledger") if f.endswith(".parquet")]
    assert len(ledger_files) > 4                               # buckets split into bounded files
    plain = read_bucketed(spark, base, 4, use_buckets=False)
    plan = risk_analysis_fanout(plain)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Exchange hashpartitioning" in plan
    assert plain.events.count() == t.events.count()


def test_bucketed_items_put_without_shuffle(spark):
    from covenant.sources.binding import load_tables
    from covenant.sources.items import put_items, to_items
    from covenant.sources.store import write_bucketed_items
    items = to_items(load_tables(spark, SF))
    b = write_bucketed_items(spark, items, tempfile.mkdtemp(prefix="bucketed-items-"), 8)
    put = put_items(b)
    plan = put._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert put.count() == put_items(items).count()


def test_store_inventory(spark):
    from covenant.operators.lookups import store_inventory
    from covenant.sources.binding import load_tables
    t = load_tables(spark, SF)
    inv = {r["table_name"]: r for r in store_inventory({"contracts": t.contracts, "events": None},
                                                       ["contracts", "events", "ledger"]).collect()}
    assert inv["contracts"]["present"] and inv["contracts"]["row_count"] == t.contracts.count()
    assert not inv["events"]["present"] and not inv["ledger"]["present"]
    assert readiness(store_inventory({"contracts": t.contracts}, ["contracts", "events"])).first()["ready"] is False
