"""No request stops a stream or is changed silently; positions do not depend on the plan."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from covenant.operators import mutations as M
from covenant.operators.positional import group_positions
from covenant.sources import items as I
from tests.conftest import make_tables


def test_every_rejection_reason(spark):
    ok = '{"soulContractId": "7", "newStatus": "Redeemed", "amount": 5}'
    bodies = {ok: None, "": M.REASON_NO_BODY, "{": M.REASON_BAD_JSON, "{}": M.REASON_STRICT,
              ok.replace("5}", "5000000000000.5}"): M.REASON_AMOUNT, ok.replace("5}", '5, "seq": -1}'): M.REASON_SEQ,
              ok.replace("5}", '5, "seq": 5000000000000000000}'): M.REASON_SEQ, ok.replace('"7"', '"innocent_0001"'): M.REASON_ID}
    raw = spark.createDataFrame([(b,) for b in bodies] + [(None,)], "value string")
    valid, rejected = M.validate_commands(raw, now="2024-01-01 00:00:00", cid_type="bigint")
    assert {r["value"]: r["reason"] for r in rejected.collect()} == {**{b: r for b, r in bodies.items() if r}, None: M.REASON_NO_BODY}
    assert [r["contract_id"] for r in valid.collect()] == ["7"]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions_with_payload(spark, reuse):
    df = spark.range(120_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).alias("v"), "id")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = group_positions(df, ["g"], ["v", "id"], size_col="n")
        want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
        assert got.join(want.select("id", "want"), "id").where("pos <> want or n <> 40000").count() == 0
        assert got.count() == 120_000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_repeated_bodies_stay_requests_of_their_own(spark):
    body = '{"soulContractId": 1, "newStatus": "Redeemed", "amount": 2.5}'
    raw = spark.createDataFrame([(body,), (body,), (body,)], "value string")
    first = [r["seq"] for r in M.validate_commands(raw, now="2024-01-01 00:00:00")[0].collect()]
    again = [r["seq"] for r in M.validate_commands(raw, now="2024-01-01 00:00:00")[0].collect()]
    later = [r["seq"] for r in M.validate_commands(raw, now="2024-01-02 00:00:00")[0].collect()]
    assert len(set(first)) == 3 and sorted(first) == sorted(again) and not set(first) & set(later)


def test_item_writes_without_a_key_are_rejected_with_a_reason(spark):
    t = make_tables(spark, [(1, "Bound", "Evil", "X", None)],
                    [(1, 1, None, "a"), (2, 1, None, "b"), (3, 1, "2024-01-01", "c")],
                    [(5, 1, 2, None, "e"), (6, 1, 3, "2024-01-02", "f")])
    writes = I.to_items(t)
    strays = writes.where("_seq in (3, 5)").withColumn("PK", F.lit(None).cast("string"))
    kept, rejected = I.put_items(writes, strays).collect(), I.rejected_items(writes, strays).collect()
    assert sorted((r["_seq"], r["description"], r["reason"]) for r in rejected) == [
        (1, "a", I.REASON_NO_SK), (2, "b", I.REASON_NO_SK), (3, "c", I.REASON_NO_PK), (5, "e", I.REASON_NO_PK), (5, "e", I.REASON_NO_SK)]
    assert len(kept) == 3 and len(kept) + len(rejected) == writes.count() + strays.count()       # no write is lost
