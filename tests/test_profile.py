from decimal import Decimal

from covenant.operators.profile import audit_latest, profile_full
from tests.conftest import make_tables


def _t(spark):
    contracts = [(1, "Bound", "Evil", "X", "2024-01-01 00:00:00"), (2, "Bound", "Evil", "X", None),
                 (3, "Bound", "Evil", "X", None)]
    events = [(10, 1, "2024-01-02 00:00:00", "old"), (11, 1, None, "no time"), (12, 1, "2024-01-03 00:00:00", "new"),
              (20, 2, "2024-01-05 00:00:00", "tie-b"), (19, 2, "2024-01-05 00:00:00", "tie-a")]
    ledger = [(30, 1, 5, "2024-01-02 00:00:00", "x"), (31, 1, 7, "2024-01-04 00:00:00", "y"),
              (41, 2, 1, "2024-01-01 00:00:00", "p"), (40, 2, 2, "2024-01-01 00:00:00", "q")]
    return make_tables(spark, contracts, events, ledger)


def test_latest_null_time_first_then_newest_then_lowest_id(spark):
    a = {r["id"]: r for r in audit_latest(_t(spark)).collect()}
    assert a[1]["last_event"] == "no time" and a[1]["last_event_time"] is None   # DESC NULLS FIRST
    assert a[1]["last_amount"] == Decimal("7.000000")
    assert a[2]["last_event"] == "tie-a"                                        # tie: lowest id (19)
    assert a[2]["last_amount"] == Decimal("2.000000")                           # tie: lowest id (40)
    assert a[3]["last_event"] is None and a[3]["last_amount"] is None           # LEFT: NULLs


def test_profile_flat_and_nested(spark):
    t = _t(spark)
    flat = profile_full(t, [1])
    assert flat.count() == 1 + 3 + 2
    kinds = [r["kind"] for r in flat.collect()]
    assert kinds == ["contract", "event", "event", "event", "ledger", "ledger"]
    nested = {r["contract_id"]: r for r in profile_full(t, [1, 2, 3], nested=True).collect()}
    ev = [e["description"] for e in nested[1]["events"]]
    assert ev == ["old", "new", "no time"]          # time ascending, NULL time last (as the flat form)
    assert [x["amount"] for x in nested[1]["ledger"]] == [Decimal("5.000000"), Decimal("7.000000")]
    assert nested[3]["events"] is None


def test_array_profiles_need_ids(spark):
    import pytest
    from covenant.operators.profile import profile_joined
    with pytest.raises(ValueError):
        profile_joined(_t(spark), None)
    with pytest.raises(ValueError):
        profile_full(_t(spark), nested=True)
