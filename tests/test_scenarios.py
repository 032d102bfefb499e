from covenant.plans import scenarios as S
from covenant.sources import items as I
from covenant.sources.binding import load_commands, load_measurements, load_tables, right_store
from tests.conftest import SF


def test_scenarios_plan_and_run(spark):
    t = load_tables(spark, SF)
    r = right_store(t)
    items = I.put_items(I.to_items(t))
    s1 = S.complete_profile(t, r, items)
    n_items = s1["items"].count()
    n_flat = s1["profile"].count()
    assert s1["id"] is not None and n_flat >= 1 and n_items >= 1
    s2 = S.business_analytics(t, items)
    a = {r["contract_location"]: r["soul_count"] for r in s2["normalized"].collect()}
    b = {r["contract_location"]: r["soul_count"] for r in s2["items"].collect()}
    assert a == b                      # both shapes agree on counts
    s3 = S.redemption_write(t, load_commands(spark, SF))
    assert s3["audit"].count() > 0
    s4 = S.batch_lookup(t)
    assert s4["contracts"].count() == s4["ids"].count()
    s5 = S.risk_analytics(t)
    assert s5["fanout"].count() == s5["corrected"].count()
    rep = S.timing_report(load_measurements(spark, SF), "click", "view")
    assert rep["ttest"].count() == 5


def test_benchmark_suite(spark):
    t = load_tables(spark, SF)
    b = S.benchmark_suite(t, right_store(t), load_commands(spark, SF))
    assert b["profile"].count() == 1
    assert b["batch"].count() == 8
    assert b["writes"].ledger.count() == t.ledger.count()          # touches add no ledger rows
    assert b["complex"].count() == b["analytics"].count()
