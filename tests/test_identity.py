"""A request is known by its place in the source; replay checks never shuffle the store."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from covenant.operators import keyset as K
from covenant.operators import mutations as M
from covenant.sources import items as I
from covenant.sources.commands import read_commands, with_places
from covenant.sources.store import read_with_deltas, rejected_commands
from covenant.streaming.commands import apply_commands_stream
from tests.conftest import make_tables

BODY = '{"soulContractId": "%s", "newStatus": "Redeemed", "amount": 3, "ts": "2031-03-01 00:00:00", "seq": 4}'
NOW = "2031-03-02 00:00:00"


def _store(spark):
    return make_tables(spark, [(1, "Bound", "Evil", "X", "2024-01-01 00:00:00")], [], [])


def _files(spark, bodies, files=3):
    root = tempfile.mkdtemp(prefix="identity-")
    spark.createDataFrame([(b,) for b in bodies], "value string").repartition(files).write.text(f"{root}/in")
    return root


def test_repeated_bodies_and_client_numbers_in_batch_items_and_stream(spark):
    root = _files(spark, [BODY % 1] * 5 + [BODY % 2] * 2)
    base = _store(spark)
    valid, rejected = M.validate_commands(read_commands(spark, f"{root}/in"), cid_type="bigint")
    batch = M.apply_commands(base, valid)
    assert rejected.count() == 0 and batch.events.count() == batch.ledger.count() == 7
    assert batch.events.select("id").distinct().count() == 7
    items = M.apply_commands_items(I.to_items(base), valid)
    assert items.where("SK like 'EVENT#%'").count() == items.where("SK like 'LEDGER#%'").count() == 7
    apply_commands_stream(spark, f"{root}/in", f"{root}/store", f"{root}/ckpt", cid_type="bigint", max_files_per_trigger=1).awaitTermination(300)
    streamed = read_with_deltas(spark, base, f"{root}/store")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(streamed.events) == ids(batch.events) and ids(streamed.ledger) == ids(batch.ledger)
    # a replay adds nothing, in either shape
    again = M.apply_commands(batch, valid)
    assert ids(again.events) == ids(batch.events) and ids(again.ledger) == ids(batch.ledger)
    assert M.apply_commands_items(items, valid).count() == items.count()


def test_places_do_not_depend_on_splits_or_other_files(spark):
    root = _files(spark, [f"{BODY % i} " + "x" * (i % 50) for i in range(4_000)], files=2)

    def places(path):
        return {(r["value"], r["seq"]) for r in with_places(read_commands(spark, path)).collect()}

    whole = places(f"{root}/in")
    assert len({s for _, s in whole}) == 4_000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert read_commands(spark, f"{root}/in").select("origin_block").distinct().count() > 5
        assert places(f"{root}/in") == whole
        name = sorted(f for f in os.listdir(f"{root}/in") if f.startswith("part-"))[1]
        assert places(f"{root}/in/{name}") < whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_places_of_logs_and_parquet_rows(spark):
    root = tempfile.mkdtemp(prefix="logs-")
    rows = [("a", 0, 7), ("a", 3, 7), ("b", 3, 8)]
    spark.createDataFrame(rows, "value string, partition int, offset long").write.parquet(f"{root}/log")
    got = {(r["value"], r["seq"]) for r in with_places(read_commands(spark, f"{root}/log", format="parquet")).collect()}
    assert got == {("a", 7), ("a", (3 << 48) + 7), ("b", (3 << 48) + 8)}
    spark.createDataFrame([("same",)] * 40, "value string").repartition(2).write.parquet(f"{root}/rows")
    assert with_places(read_commands(spark, f"{root}/rows", format="parquet")).select("seq").distinct().count() == 40
    spark.createDataFrame([("a", 1 << 13, 7)], "value string, partition int, offset long").write.parquet(f"{root}/wide")
    with pytest.raises(Exception, match="request place out of range"):
        with_places(read_commands(spark, f"{root}/wide", format="parquet")).collect()


def test_text_contract_ids_by_default(spark):
    root = _files(spark, [BODY % "innocent_graveyard_0001", BODY % 1, '{"soulContractId": ""}'])
    t = _store(spark)
    text = t.with_(contracts=t.contracts.withColumn("id", F.lit("innocent_graveyard_0001")),
                   events=t.events.withColumn("soul_contract_id", F.lit("").cast("string")),
                   ledger=t.ledger.withColumn("soul_contract_id", F.lit("").cast("string")))
    apply_commands_stream(spark, f"{root}/in", f"{root}/store", f"{root}/ckpt").awaitTermination(300)
    state = read_with_deltas(spark, text, f"{root}/store")
    assert {r["id"]: r["contract_status"] for r in state.contracts.collect()} == {"innocent_graveyard_0001": "Redeemed", "1": "Redeemed"}
    assert state.events.count() == state.ledger.count() == 2 and rejected_commands(spark, f"{root}/store").count() == 1
    # the same log over a store of numbers: what is no number is reported, not lost
    numbers = read_with_deltas(spark, t, f"{root}/store")
    assert numbers.events.count() == 1 and numbers.contracts.count() == 1
    assert {r["reason"] for r in rejected_commands(spark, f"{root}/store", "bigint").collect()} == {M.REASON_STRICT, M.REASON_ID}


@pytest.mark.parametrize("bytes_,keys", [(1 << 30, 1 << 20), (0, 1 << 20), (0, 10)])
def test_held_keys_equal_a_plain_join(spark, monkeypatch, bytes_, keys):
    monkeypatch.setattr(K, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(K, "FILTER_KEYS", keys)
    store = spark.range(5_000).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    batch = spark.range(4_900, 5_400).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"),
                                             F.col("id").alias("payload"))
    have = {(r["a"], r["b"]) for r in store.collect()}
    fresh = K.fresh_rows(store, batch, ("a", "b")).collect()
    assert sorted(r["payload"] for r in fresh) == sorted(r["payload"] for r in batch.collect() if (r["a"], r["b"]) not in have)
    held = {(r["a"], r["b"]) for r in K.held_keys(store, batch, ("a", "b")).collect()}
    assert held == {(r["a"], r["b"]) for r in batch.collect()} & have


def test_filter_lets_few_others_pass_and_shuffles_nothing(spark):
    store, batch = spark.range(200_000).withColumnRenamed("id", "k"), spark.range(100_000, 101_000).withColumnRenamed("id", "k")
    passed = K.may_hold(store, batch, ["k"], 1_000)
    n = passed.count()
    assert 1_000 <= n < 200_000 / 8 and passed.join(batch, "k", "left_semi").count() == 1_000
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = passed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(k" not in plan and "SortMergeJoin" not in plan


def test_demo_and_touch_items(spark):
    t = make_tables(spark, [(1, "Bound", "Evil", "X", "2024-01-01 00:00:00")], [(5, 1, "2024-02-01 00:00:00", "old event")],
                    [(6, 1, 2, "2024-02-01 00:00:00", "old entry")])
    items = I.put_items(I.to_items(t))
    cmds = spark.createDataFrame([(1, "Redeemed", 5, "2024-02-01 00:00:00", 1), (1, "Condemned", 3, "2024-02-01 00:00:00", 2),
                                  (2, "Bound", 4, "2024-03-01 00:00:00", 3)], "contract_id long, new_status string, amount int, ts string, seq long")
    cmds = cmds.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "amount": F.col("amount").cast("decimal(18,6)")})
    out = {(r["PK"], r["SK"]): r for r in M.apply_demo_items(items, cmds).collect()}
    at = "2024-02-01T00:00:00.000Z"
    assert len(out) == 6
    assert out["SOUL#1", "CONTRACT"]["status"] == "Condemned" and out["SOUL#1", "CONTRACT"]["soul_type"] == "Evil"
    assert out["SOUL#1", f"EVENT#{at}"]["description"] == "Contract updated to 'Condemned'"       # the later put stands
    assert out["SOUL#1", f"LEDGER#{at}"]["transaction_type"] == "redemption" and out["SOUL#1", f"LEDGER#{at}"]["description"] is None
    assert out["SOUL#2", "CONTRACT"]["status"] == "Bound" and out["SOUL#2", "CONTRACT"]["soulId"] is None
    assert {k: str(v) for k, v in out.items()} == {(r["PK"], r["SK"]): str(r) for r in M.apply_demo_items(
        M.apply_demo_items(items, cmds), cmds).collect()}                                          # a replay changes nothing
    touched = {(r["PK"], r["SK"]): r for r in M.apply_touches_items(items, cmds).collect()}
    assert touched["SOUL#1", "CONTRACT"]["status"] == "Bound" and touched["SOUL#1", "CONTRACT"]["updated_at"] == at
    assert touched["SOUL#1", f"EVENT#{at}"]["description"] == "Benchmark event 2"
    assert touched["SOUL#1", f"LEDGER#{at}"]["description"] == "old entry"
