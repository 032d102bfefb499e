from decimal import Decimal

from pyspark.sql import functions as F

from covenant.operators import mutations as M
from covenant.operators.parity import items_vs_tables
from covenant.sources import items as I
from covenant.sources.schemas import COMMANDS
from tests.conftest import D, make_tables, ts


def test_strict_and_lenient_validation(spark):
    bodies = ['{"soulContractId": "1", "newStatus": "Redeemed", "amount": 5}',
              '{"soulContractId": "1", "newStatus": "Redeemed", "amount": "7"}',
              '{"soulContractId": "1", "newStatus": "Redeemed", "amount": null}',
              '{"soulContractId": "1", "newStatus": "Redeemed"}',
              '{"soulContractId": "1", "newStatus": "", "amount": 5}',
              '{bad', '5']
    raw = spark.createDataFrame([(b,) for b in bodies], "value string")
    valid, rejected = M.validate_commands(raw, "strict")
    assert [r["amount"] for r in valid.collect()] == [Decimal("5.000000")]
    reasons = {r["value"]: r["reason"] for r in rejected.collect()}
    assert reasons["{bad"] == "Invalid JSON" and len(reasons) == 6
    lraw = spark.createDataFrame([(b.replace("soulContractId", "soulId"),) for b in bodies], "value string")
    lvalid, _ = M.validate_commands(lraw, "lenient")
    assert lvalid.count() == 3          # number, "7" and null pass; missing amount does not


def _cmds(spark, rows):
    return spark.createDataFrame([(c, s, D(a), ts(t), q) for c, s, a, t, q in rows], COMMANDS)


def _store(spark):
    return make_tables(spark, [(1, "Bound", "Evil", "X", "2024-01-01 00:00:00")], [], [])


def test_two_commands_one_id(spark):
    cmds = _cmds(spark, [(1, "Redeemed", 5, "2024-02-01 00:00:00", 1), (1, "Condemned", 3, "2024-03-01 00:00:00", 2)])
    t = M.apply_commands(_store(spark), cmds)
    c = t.contracts.first()
    assert c["contract_status"] == "Condemned" and str(c["updated_at"]) == "2024-03-01 00:00:00"
    assert t.events.count() == 2 and t.ledger.count() == 2
    assert {r["description"] for r in t.events.collect()} == {"Contract updated to 'Redeemed'",
                                                             "Contract updated to 'Condemned'"}
    # replaying the same commands adds nothing (deterministic row ids)
    again = M.apply_commands(t, cmds)
    assert again.events.count() == 2 and again.ledger.count() == 2


def test_unknown_id_upsert_vs_update_only(spark):
    cmds = _cmds(spark, [(9, "Redeemed", 5, "2024-02-01 00:00:00", 1)])
    up = M.apply_commands(_store(spark), cmds, mode="upsert")
    new = up.contracts.where(F.col("id") == 9).first()
    assert new["contract_status"] == "Redeemed" and new["soul_type"] is None and new["contract_location"] is None
    only = M.apply_commands(_store(spark), cmds, mode="update_only")
    assert only.contracts.count() == 1 and only.events.count() == 1 and only.ledger.count() == 1


def test_touch_keeps_status(spark):
    cmds = _cmds(spark, [(1, "Redeemed", 5, "2024-02-01 00:00:00", 7)])
    t = M.apply_touches(_store(spark), cmds)
    assert t.contracts.first()["contract_status"] == "Bound" and t.ledger.count() == 0
    assert t.events.first()["description"] == "Benchmark event 7"


def test_handler_shaped_items(spark):
    items = I._conform(spark.createDataFrame(
        [("SOUL#7", "CONTRACT", None, "Redeemed", "2024-01-01T00:00:00.000Z"),
         ("SOUL#7", "EVENT#0b8f-uuid", None, None, None)],
        "PK string, SK string, status string, contract_status string, updated_at string"))
    compat = I.from_items(items, "compat")
    c = compat.contracts.first()
    assert c["contract_status"] == "Redeemed" and c["updated_at"] is None
    full = I.from_items(items, "full").contracts.first()
    assert str(full["updated_at"]) == "2024-01-01 00:00:00"
    assert I.location_index(items).count() == 0 and I.status_index(items).count() == 0
    e = compat.events.first()
    assert e["event_time"] is None and e["event_time_text"] == "0b8f-uuid"


def test_item_update_creates_sparse_contract(spark):
    items = I.to_items(_store(spark))
    cmds = _cmds(spark, [(5, "Redeemed", 1, "2024-02-01 00:00:00", 1)])
    out = M.apply_commands_items(items, cmds)
    c = out.where((F.col("PK") == "SOUL#5") & (F.col("SK") == "CONTRACT")).first()
    assert c["contract_status"] == "Redeemed" and c["status"] is None
    assert out.where(F.col("PK") == "SOUL#5").count() == 3


def test_item_collision_reported(spark):
    t = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [],
                    [(1, 1, 5, "2024-01-01 00:00:00", "a"), (2, 1, 6, "2024-01-01 00:00:00", "b")])
    items = I.put_items(I.to_items(t))
    led = items.where(F.col("SK").startswith("LEDGER#")).collect()
    assert len(led) == 1 and led[0]["description"] == "b"           # later write wins
    issues = items_vs_tables(items, t).collect()
    assert [(r["scope"], r["left_value"], r["right_value"]) for r in issues] == [("ledger", "1", "2")]


def test_parity_report_switches(spark):
    from covenant.operators.parity import parity_report
    left = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [(1, 1, "2024-01-01 00:00:00", "e")],
                       [(1, 1, 5, "2024-01-01 00:00:00", "a")])
    right = make_tables(spark, [(1, "Redeemed", "Evil", "X", None)], [], [(1, 1, 6, "2024-01-01 00:00:00", "a")])
    scopes = lambda df: sorted({r["scope"] for r in df.collect()})
    assert scopes(parity_report(left, right)) == ["contracts", "events", "ledger entries"]
    assert scopes(parity_report(left, right, include_events=False, include_ledger=False)) == ["contracts"]
    amt = [r for r in parity_report(left, right).collect() if r["field"] == "amount"]
    assert [(r["idx"], r["left_value"], r["right_value"]) for r in amt] == [(0, "5.000000", "6.000000")]


def test_camel_case_fallbacks(spark):
    items = I._conform(spark.createDataFrame(
        [("SOUL#8", "CONTRACT", "Bound", None, None, "Evil", "X",
          "2024-01-01T00:00:00.000Z", "2024-02-01T00:00:00.000Z")],
        "PK string, SK string, status string, soul_type string, contract_location string, soulType string, "
        "contractLocation string, createdAt string, updatedAt string"))
    c = I.from_items(items, "compat").contracts.first()
    assert (c["soul_type"], c["contract_location"]) == ("Evil", "X")      # snake case missing -> camel case
    assert str(c["updated_at"]) == "2024-02-01 00:00:00"                  # updatedAt before createdAt


def test_parity_summary_skip_switches(spark):
    from covenant.operators.parity import parity_report, parity_summary
    left = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [(1, 1, "2024-01-01 00:00:00", "e")],
                       [(1, 1, 5, "2024-01-01 00:00:00", "a")])
    right = make_tables(spark, [(1, "Bound", "Evil", "X", None)], [], [(1, 1, 6, "2024-01-01 00:00:00", "a")])
    issues = parity_report(left, right)
    ids = spark.createDataFrame([("1",)], "id string")
    assert parity_summary(issues, ids).first()["mismatches"] == 2          # event count + ledger amount
    only_events = parity_summary(issues, ids, skip_ledger=True).first()
    assert only_events["mismatches"] == 1 and not only_events["ok"]
    assert parity_summary(issues, ids, skip_events=True, skip_ledger=True).first()["ok"]
