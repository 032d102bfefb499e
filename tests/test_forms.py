"""Selection of percentiles, the hash tree of a collection, Bloom filters, footer counts, the multiset profile, ranks."""

import math
import random
import tempfile

from pyspark.sql import functions as F

from covenant.operators import lookups as L
from covenant.operators import parity as V
from covenant.operators import stats as T
from covenant.operators.lookups import point_get
from covenant.operators.positional import group_positions, ranks
from covenant.operators.profile import profile_joined, profile_multiset
from covenant.sources.store import current_version, read_store, write_store
from tests.conftest import SF, make_tables


def test_selection_equals_the_sort(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1e6)) for _ in range(30_000)] + [("b", float(rng.randrange(3))) for _ in range(20_000)]
    rows += [("c", 5.0), ("d", -1.0), ("d", 1e300), ("d", 1e-300), (None, 2.0), (None, 3.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.p50, r.p95, r.p99) for r in T.nearest_ranks(df, "v", ["g"], accuracy=200).collect()}
    for g in {g for g, v in rows if v is not None}:
        vs = sorted(v for x, v in rows if x == g and v is not None)
        assert got[g] == tuple(vs[math.floor(len(vs) * p)] for p in (0.5, 0.95, 0.99)), g
    assert "e" not in got and T.nearest_ranks(df.limit(0), "v", ["g"]).count() == 0


def test_selection_ranks_few_rows(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    p = T.nearest_ranks(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in p and "hashpartitioning(g" not in p.split("_i")[0].split("Window")[0]


def test_only_differing_blocks_are_compared(spark):
    rows = [(i, 1 if i % 3 else i, i % 7, "2024-01-01 00:00:00", f"d{i:06d}") for i in range(3_000)]
    left = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [], rows)
    changed = left.ledger.withColumn("amount", F.when(F.col("id") == 1_000, F.lit(99)).otherwise(F.col("amount")).cast("decimal(18,6)"))
    issues = lambda **kw: sorted(map(str, V.parity_ledger(left.ledger, changed, **kw).collect()))
    assert issues(block=64) == issues() and len(issues()) == 1
    cl, cr = (V._collection(x, "transaction_time", True).where("cid = '1'") for x in (left.ledger, changed))
    both = cl.withColumn("side", F.lit(0)).unionByName(cr.withColumn("side", F.lit(1)))
    pos = group_positions(both, ["side", "cid"], ["t", "d", "a"])
    assert pos.count() == 4_000 and V.differing_blocks(pos, 64).count() == 128
    shifted = left.ledger.where("id <> 1000")
    issues = lambda **kw: sorted(map(str, V.parity_ledger(left.ledger, shifted, **kw).collect()))
    assert issues(block=64) == issues()


def _scanned(df):
    """Rows that the scan below ``df`` gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    while "Stage" in leaf.nodeName() or leaf.collectLeaves().head().nodeName() != leaf.nodeName():
        leaf = leaf.plan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_point_reads_of_an_unclustered_store_skip_row_groups(spark):
    n = 20_000
    c = spark.range(n).select(F.format_string("soul_%09d", F.pmod(F.xxhash64("id"), F.lit(10 ** 9))).alias("id"), F.lit("Bound").alias("contract_status"),
                              F.lit("Evil").alias("soul_type"), F.lit("X").alias("contract_location"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    c = c.repartition(8, F.rand(1))
    t = make_tables(spark, [], [], []).with_(contracts=c)
    for keys in (None, n):
        base = tempfile.mkdtemp(prefix="bloom-")
        write_store(spark, base, 1, tables=t, targets={"normalized"}, point_keys=keys)
        stored = read_store(spark, base).contracts
        some = stored.orderBy("id").offset(n // 2).first()["id"]
        got = point_get(stored, {"id": some})
        assert got.count() == 1
        read = _scanned(got)
        assert read >= n / 2 if keys is None else read <= n / 4, (keys, read)


def test_versions_are_published_by_new_entries(spark):
    base = tempfile.mkdtemp(prefix="manifest-")
    t = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [], [])
    for v in (7, 3, 9, 8):
        write_store(spark, base, v, tables=t, targets={"normalized"})
        assert current_version(spark, base) == v
    assert spark.read.parquet(f"{base}/manifest").count() == 4


def test_counts_come_from_footers(spark):
    df = L.read_v2(spark, f"{SF}/customer.parquet").agg(F.count(F.lit(1)).alias("n"))
    assert df.first()["n"] == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert "PushedAggregation: [COUNT(*)]" in df._jdf.queryExecution().executedPlan().toString()
    plan = L.table_inventory(spark, SF, ["customer", "souls"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert "FileScan parquet" in spark.read.parquet(f"{SF}/customer.parquet")._jdf.queryExecution().executedPlan().toString()


def test_multiset_profile_of_a_hot_contract(spark):
    t = make_tables(spark, [(1, "Bound", "Evil", "X", None), (2, "Bound", "Evil", "X", None), (3, "Bound", "Evil", "X", None)], [],
                    [(i, 3, 1, None, "x") for i in range(2)])
    ev = spark.range(1_000_000).select("id", F.lit(1).cast("long").alias("soul_contract_id"), F.lit(None).cast("timestamp_ntz").alias("event_time"),
                                       F.when(F.col("id") % 3 != 0, (F.col("id") % 2).cast("string")).alias("description"))
    lg = spark.range(1_000).select(F.col("id") + 10, F.lit(1).cast("long"), F.lit(2).cast("decimal(18,6)"), F.lit(None).cast("timestamp_ntz"), F.lit("y"))
    got = {(r["id"], r["event"]): (r["times"], r["total_power"]) for r in profile_multiset(t.with_(events=ev, ledger=t.ledger.union(lg))).collect()}
    assert sum(n for (i, _), (n, _) in got.items() if i == 1) == 10 ** 9 and got[1, None][0] == 333_334_000
    assert got[1, "0"][1] == 2_000 * 10 ** 6 and got[2, None] == (1, None) and got[3, None] == (2, 2)
    small = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [(1, 1, None, "a"), (2, 1, None, "a"), (3, 1, None, None)], [(1, 1, 4, None, "x")] * 2)
    joined = profile_joined(small, [1]).first()
    flat = [r["event"] for r in profile_multiset(small).collect() for _ in range(r["times"])]
    assert sorted(map(str, flat)) == sorted(map(str, joined["events"])) and profile_multiset(small).first()["total_power"] == joined["total_power"]


def test_ranks_with_ties(spark):
    rng = random.Random(4)
    vals = [rng.choice([None, 1, 2, 2, 2, 5, 8]) for _ in range(500)]
    got = ranks(spark.createDataFrame(list(enumerate(vals)), "i int, v int"), "v").collect()
    key = lambda v: (v is not None, -(v or 0))
    order = sorted(vals, key=key)
    dense = {v: i + 1 for i, v in enumerate(dict.fromkeys(order))}
    assert all((r["rank"], r["dense_rank"]) == (order.index(r["v"]) + 1, dense[r["v"]]) for r in got) and len(got) == 500
