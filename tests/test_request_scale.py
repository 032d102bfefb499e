"""Batches of requests at size: a body is parsed once, no single task and no shuffle of what a batch cannot touch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from covenant.operators import keyset as K
from covenant.operators import mutations as M
from covenant.sources import items as I
from covenant.sources.commands import read_commands, with_places
from covenant.streaming.commands import commit_commands

BODY = '{"soulContractId": "%d", "newStatus": "Redeemed", "amount": 3, "ts": "2031-03-01 00:00:00"}'
LOG = "value string, partition int, offset long"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_body_is_parsed_once(spark):
    raw = spark.createDataFrame([(BODY % 1, 1), ("{bad", 2), (None, 3)], "value string, seq long").repartition(1)
    for part in M.validate_commands(raw, cid_type="bigint"):
        assert _plan(part).lower().count("parsejson(") == 1
    valid, rejected = M.validate_commands(raw, cid_type="bigint")
    assert [(r["contract_id"], str(r["ts"]), r["seq"]) for r in valid.collect()] == [("1", "2031-03-01 00:00:00", 1)]
    assert sorted((str(r["value"]), r["reason"]) for r in rejected.collect()) == [("None", M.REASON_NO_BODY), ("{bad", M.REASON_BAD_JSON)]


def test_records_that_name_their_place_meet_no_block(spark):
    none = lambda name, kind: F.when(F.col("id") < 0, F.lit("7")).cast(kind).alias(name)
    log = spark.range(0, 300, 1, 3).select(F.lit("x").alias("value"), none("origin_file", "string"), none("origin_block", "long"),
                                           none("origin_row", "long"), F.lit(2).cast("long").alias("origin_partition"), F.col("id").alias("origin_offset"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        placed = with_places(log)
        tasks = placed.select("seq", F.spark_partition_id().alias("p")).where("seq >= 0").groupBy("p").count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 300 and max(r["count"] for r in tasks) < 300       # one key: one task for all


def test_a_batch_of_one_file_is_checked_by_many_tasks(spark):
    root = tempfile.mkdtemp(prefix="one-file-")
    spark.createDataFrame([(BODY % i, 0, i) for i in range(400)], LOG).coalesce(1).write.parquet(f"{root}/in")
    commit_commands(spark, f"{root}/store", 0, read_commands(spark, f"{root}/in", format="parquet"), cid_type="bigint")
    folder = f"{root}/store/commands_delta/source=batch/batch_id=0"
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 1
    assert spark.read.parquet(folder).select("seq").distinct().count() == 400


@pytest.mark.parametrize("bytes_,keys", [(1 << 30, 1 << 20), (0, 1 << 20), (0, 10)])
def test_rows_without_equal_a_plain_join(spark, monkeypatch, bytes_, keys):
    monkeypatch.setattr(K, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(K, "FILTER_KEYS", keys)
    store = spark.range(3_000).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"), "id")
    batch = spark.range(2_900, 3_300).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    got = sorted(r["id"] for r in K.rows_without(store, batch, ("a", "b")).collect())
    assert got == [*range(2_901)] and K.rows_without(store, batch.limit(0), ("a", "b")).count() == 3_000


def test_whole_puts_equal_puts_by_attribute(spark):
    writes = spark.range(400).select(F.concat(F.lit("SOUL#"), F.when(F.col("id") % 50 != 0, F.col("id") % 9).cast("string")).alias("PK"),
                                     F.concat(F.lit("EVENT#"), (F.col("id") % 4).cast("string")).alias("SK"),
                                     F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("description"),
                                     F.when(F.col("id") > 3, F.col("id")).alias("_seq"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(I.put_items(writes, whole=True)) == rows(I.put_items(writes)) and I.put_items(writes, whole=True).dtypes == I.put_items(writes).dtypes
    # one order column travels with a row, not one for each attribute
    assert _plan(I.put_items(writes, whole=True)).count("max_by(") == 1


def test_touches_meet_items_of_their_kind_only(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "FILTER_KEYS", 0)
    at = "2024-02-01T00:00:00.000Z"
    items = I._conform(spark.createDataFrame(
        [("SOUL#1", "CONTRACT", "Bound", None, 0), ("SOUL#1", f"EVENT#{at}", None, "old", 5), ("SOUL#1", f"LEDGER#{at}", None, "entry", 6),
         ("SOUL#1", "NOTE", None, "kept", 7)], "PK string, SK string, status string, description string, _seq long"))
    cmds = spark.sql("SELECT id AS contract_id, 'Redeemed' AS new_status, 5.0BD AS amount, TIMESTAMP_NTZ'2024-02-01 00:00:00' AS ts, id + 8 AS seq "
                     "FROM VALUES (1L), (2L) AS t(id)")
    out = M.apply_touches_items(items, cmds)
    got = {(r["PK"], r["SK"]): (r["status"], r["description"], r["updated_at"]) for r in out.collect()}
    assert out.count() == 6 and got == {
        ("SOUL#1", "CONTRACT"): ("Bound", None, at), ("SOUL#1", f"EVENT#{at}"): (None, "Benchmark event 9", None),
        ("SOUL#1", f"LEDGER#{at}"): (None, "entry", None), ("SOUL#1", "NOTE"): (None, "kept", None),
        ("SOUL#2", "CONTRACT"): (None, None, at), ("SOUL#2", f"EVENT#{at}"): (None, "Benchmark event 10", None)}
    assert _plan(out).count("LeftAnti") == 2            # the stored items that go, and new contracts: the puts are not asked again
