import os
import tempfile

from pyspark.sql import functions as F

from covenant.operators.mutations import apply_commands, validate_commands
from covenant.sources.binding import load_command_json, load_tables
from covenant.sources.commands import read_commands
from covenant.sources.store import read_with_deltas, rejected_commands
from covenant.streaming.commands import apply_commands_stream
from tests.conftest import SF


def _write_bodies(spark, d):
    src = load_command_json(spark, SF).select(
        F.to_json(F.struct(
            F.get_json_object("value", "$.soulContractId").alias("soulContractId"),
            F.get_json_object("value", "$.newStatus").alias("newStatus"),
            F.get_json_object("value", "$.amount").cast("double").alias("amount"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
            F.col("seq"))).alias("value"))
    bad = spark.createDataFrame([("{bad",), ('{"soulContractId": "1"}',)], "value string")
    src.unionByName(bad).repartition(3).write.mode("overwrite").text(d)


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src, store, ckpt = (os.path.join(root, x) for x in ("in", "store", "ckpt"))
    _write_bodies(spark, src)
    q = apply_commands_stream(spark, src, store, ckpt)
    q.awaitTermination(300)
    base = load_tables(spark, SF)
    streamed = read_with_deltas(spark, base, store)
    valid, _ = validate_commands(read_commands(spark, src))
    batch = apply_commands(base, valid.withColumn("ts", F.col("ts")))
    for a, b in ((streamed.contracts, batch.contracts), (streamed.events, batch.events),
                 (streamed.ledger, batch.ledger)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert rejected_commands(spark, store).count() == 2
    # a restarted query finds nothing new: the checkpoint keeps it exactly-once
    q2 = apply_commands_stream(spark, src, store, ckpt)
    q2.awaitTermination(300)
    assert read_with_deltas(spark, base, store).events.count() == streamed.events.count()


def _same(a, b):
    for x, y in ((a.contracts, b.contracts), (a.events, b.events), (a.ledger, b.ledger)):
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_multi_batch_stream_restarted(spark):
    root = tempfile.mkdtemp(prefix="stream2-")
    src, store, ckpt = (os.path.join(root, x) for x in ("in", "store", "ckpt"))
    bodies = load_command_json(spark, SF).select("value")
    first, second = bodies.randomSplit([0.6, 0.4], seed=3)
    first.repartition(3).write.mode("overwrite").text(src)
    apply_commands_stream(spark, src, store, ckpt, max_files_per_trigger=1,
                          now="2024-02-01 00:00:00").awaitTermination(300)
    base = load_tables(spark, SF)
    valid, _ = validate_commands(read_commands(spark, src), now="2024-02-01 00:00:00")
    _same(read_with_deltas(spark, base, store), apply_commands(base, valid))      # three batches equal one
    second.repartition(2).write.mode("append").text(src)
    apply_commands_stream(spark, src, store, ckpt, max_files_per_trigger=1,
                          now="2024-02-01 00:00:00").awaitTermination(300)
    after = read_with_deltas(spark, base, store)
    valid, _ = validate_commands(read_commands(spark, src), now="2024-02-01 00:00:00")
    _same(after, apply_commands(base, valid))                     # files that came later renumber nothing
    assert after.events.count() == base.events.count() + bodies.count()


def test_batch_commit_is_idempotent(spark):
    from covenant.streaming.commands import commit_commands
    root = tempfile.mkdtemp(prefix="commit-")
    store = os.path.join(root, "store")
    raw = load_command_json(spark, SF).select("value", "ts", "seq")
    commit_commands(spark, store, 0, raw)
    base = load_tables(spark, SF)
    once = read_with_deltas(spark, base, store)
    commit_commands(spark, store, 0, raw)                     # the same batch again
    _same(read_with_deltas(spark, base, store), once)
    valid, _ = validate_commands(raw)
    _same(once, apply_commands(base, valid))                   # equals the pure batch bundle


def test_command_source_formats(spark):
    from covenant.sources.commands import ORIGIN
    root = tempfile.mkdtemp(prefix="cmdsrc-")
    bodies = spark.createDataFrame([('{"soulContractId": "1", "newStatus": "Bound", "amount": 1}',)], "value string")
    bodies.write.mode("overwrite").parquet(f"{root}/pq")
    bodies.write.mode("overwrite").text(f"{root}/txt")
    for fmt, path in (("parquet", f"{root}/pq"), ("text", f"{root}/txt")):
        got = read_commands(spark, path, format=fmt)
        assert got.columns == ["value", *ORIGIN] and validate_commands(got)[0].count() == 1


def test_update_only_store_ignores_unknown_contracts(spark):
    from covenant.streaming.commands import commit_commands
    root = tempfile.mkdtemp(prefix="upd-only-")
    store = os.path.join(root, "store")
    raw = spark.createDataFrame(
        [('{"soulContractId": "999999", "newStatus": "Redeemed", "amount": 3, "ts": "2024-03-01 00:00:00", "seq": 7}',)],
        "value string")
    commit_commands(spark, store, 0, raw)
    base = load_tables(spark, SF)
    upd = read_with_deltas(spark, base, store, mode="update_only")
    ups = read_with_deltas(spark, base, store, mode="upsert")
    assert upd.contracts.count() == base.contracts.count()              # unknown id not inserted
    assert ups.contracts.count() == base.contracts.count() + 1
    assert upd.events.count() == base.events.count() + 1                # the event is still recorded
    assert upd.ledger.count() == base.ledger.count() + 1


def test_no_source_and_no_batch_order_hides_a_command(spark):
    from covenant.streaming.commands import commit_commands
    root = tempfile.mkdtemp(prefix="sources-")
    store = os.path.join(root, "store")
    body = '{"soulContractId": "%d", "newStatus": "Redeemed", "amount": 3, "ts": "2031-03-0%d 00:00:00", "seq": %d}'
    base = load_tables(spark, SF)
    for i in (1, 2):                                            # two streams, both start with batch 0
        spark.createDataFrame([(body % (990000 + i, i, i),)], "value string").write.text(f"{root}/in{i}")
        apply_commands_stream(spark, f"{root}/in{i}", store, f"{root}/ckpt{i}").awaitTermination(300)
    commit_commands(spark, store, 5, spark.createDataFrame([(body % (990003, 3, 3),)], "value string"))
    commit_commands(spark, store, 4, spark.createDataFrame([(body % (990004, 4, 4),), (body % (990003, 1, 0),)], "value string"))
    state = read_with_deltas(spark, base, store)
    new = {r["id"]: r["updated_at"].day for r in state.contracts.where("id > 990000").collect()}
    assert new == {990001: 1, 990002: 2, 990003: 3, 990004: 4}
    assert state.events.count() == base.events.count() + 5 and state.ledger.count() == base.ledger.count() + 5
