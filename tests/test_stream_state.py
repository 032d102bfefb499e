"""The latest command per contract as stream state: late commands, restarts, changes, text ids."""

import random
import tempfile

from pyspark.sql import functions as F

from covenant.streaming.commands import contracts_with_state, latest_state, latest_state_stream
from tests.conftest import make_tables

LOG = "value string, partition int, offset long"


def _body(cid, status, day):
    return f'{{"soulContractId": "{cid}", "newStatus": "{status}", "amount": 1, "ts": "2024-03-{day:02d} 00:00:00"}}'


def test_late_commands_never_win_and_restarts_lose_none(spark):
    root = tempfile.mkdtemp(prefix="state-")
    rng = random.Random(7)
    log = [(_body(rng.randrange(20), rng.choice(["Bound", "Redeemed", "Condemned"]), rng.randrange(1, 29)), i % 2, i) for i in range(400)]
    log += [("{bad", 0, 400), (_body("soul_x", "Bound", 3), 1, 401)]
    rng.shuffle(log)
    for k in range(3):                                   # three runs of the query, each over what is new
        spark.createDataFrame(log[k::3], LOG).repartition(2).write.mode("append").parquet(f"{root}/in")
        latest_state_stream(spark, f"{root}/in", f"{root}/ckpt", f"{root}/changes", max_files_per_trigger=1,
                            source_schema=LOG).awaitTermination(300)
    import json
    want = {}
    for value, part, offset in log:
        if value != "{bad":
            b = json.loads(value)
            want[b["soulContractId"]] = max(want.get(b["soulContractId"], ("",)), (b["ts"], (part << 48) + offset, b["newStatus"]))
    state = latest_state(spark, f"{root}/ckpt")
    assert {r["contract_id"]: (str(r["ts"]), r["seq"], r["new_status"]) for r in state.collect()} == want
    assert state.count() == len(want) == 21              # one row per contract, however long the log
    changes = spark.read.parquet(f"{root}/changes")
    last = changes.groupBy("contract_id").agg(F.max_by("seq", "batch_id").alias("seq"))
    assert {r["contract_id"]: r["seq"] for r in last.collect()} == {c: w[1] for c, w in want.items()}
    t = make_tables(spark, [(1, "Old", "Evil", "X", None), (99, "Old", "Evil", "X", None)], [], [])
    rows = {r["id"]: r["contract_status"] for r in contracts_with_state(t, state).collect()}
    assert rows == {99: "Old", **{int(c): w[2] for c, w in want.items() if c != "soul_x"}}
    assert contracts_with_state(t, state, "update_only").count() == 2
