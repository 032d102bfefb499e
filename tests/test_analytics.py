from decimal import Decimal

from pyspark.sql import functions as F

from covenant.functions.exprs import rate_1dp
from covenant.operators import analytics as A
from covenant.operators import profile as P
from covenant.sources.binding import load_tables
from tests.conftest import SF, make_tables

T0 = "2024-01-01 00:00:00"


def fixture(spark):
    contracts = [
        (1, "Redeemed", "Evil", "X", T0),       # 2 events x 3 ledger rows (fan-out)
        (2, "Bound", "Sinner", "X", T0),        # events only
        (3, "Bound", "Evil", "Y", T0),          # ledger only
        (4, "Redeemed", "Evil", "Y", None),     # neither
        (5, "Bound", "Evil", None, T0),         # NULL location, one ledger row
    ]
    events = [(10, 1, "2024-01-02 00:00:00", "a"), (11, 1, "2024-01-03 00:00:00", "b"),
              (12, 2, "2024-01-02 00:00:00", "c"), (13, 2, "2024-01-04 00:00:00", None)]
    ledger = [(20, 1, 10, "2024-01-02 00:00:00", "l1"), (21, 1, -4, "2024-01-03 00:00:00", "l2"),
              (22, 1, 1, "2024-01-03 00:00:00", "l3"),
              (23, 3, 5, "2024-01-05 00:00:00", "m1"), (24, 3, 6, "2024-01-05 00:00:00", "m2"),
              (25, 3, 7, "2024-01-06 00:00:00", "m3"), (26, 5, 2, "2024-01-06 00:00:00", "n1")]
    return make_tables(spark, contracts, events, ledger)


def by_id(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_fanout_multiplicities(spark):
    m = by_id(A.fanout_join_metrics(fixture(spark)))
    assert m[1]["event_count"] == 6 and m[1]["gains"] == Decimal("22") and m[1]["losses"] == Decimal("8")
    assert m[2]["event_count"] == 2 and m[2]["gains"] == 0       # no ledger: gains 0 (not NULL)
    assert m[3]["event_count"] == 0 and m[3]["gains"] == Decimal("18")   # no events: not multiplied
    assert m[4]["event_count"] == 0 and m[4]["last_activity"] is None
    once = by_id(A.fanout_join_metrics(fixture(spark), corrected=True))
    assert once[1]["event_count"] == 2 and once[1]["gains"] == Decimal("11")


def test_fanout_equals_literal_join(spark):
    """H1 against the literal LEFT JOIN fan-out on driver data (brute force)."""
    t = load_tables(spark, SF)
    c, e, lg = t.contracts.alias("c"), t.events.alias("e"), t.ledger.alias("l")
    lit = (c.join(e, F.col("c.id") == F.col("e.soul_contract_id"), "left")
           .join(lg, F.col("c.id") == F.col("l.soul_contract_id"), "left")
           .groupBy(F.col("c.id").alias("id"))
           .agg(F.count("e.id").alias("event_count"),
                F.sum(F.when(F.col("l.amount") > 0, F.col("l.amount")).otherwise(0)).cast("decimal(38,6)").alias("gains"),
                F.sum(F.when(F.col("l.amount") < 0, F.abs("l.amount")).otherwise(0)).cast("decimal(38,6)").alias("losses"),
                F.max("e.event_time").alias("last_activity")))
    ours = A.fanout_join_metrics(t).select("id", "event_count", "gains", "losses", "last_activity")
    assert ours.exceptAll(lit).count() == 0 and lit.exceptAll(ours).count() == 0


def test_dashboard_edges(spark):
    d = {r["contract_location"]: r for r in A.location_dashboard(fixture(spark)).collect()}
    assert d["X"]["soul_count"] == 2 and d["X"]["total_power"] == Decimal("7")   # contract 2 adds 0
    assert d["X"]["avg_power_per_soul"] == Decimal("3.500000")
    assert d[None]["soul_count"] == 1                                           # NULL location own group
    assert d["Y"]["redeemed"] == 1 and d["Y"]["redemption_rate"] == 50.0


def test_joined_dashboard_counts_rows(spark):
    d = {r["contract_location"]: r for r in A.location_dashboard_joined(fixture(spark)).collect()}
    assert d["X"]["soul_count"] == 4          # 3 joined rows for contract 1 + 1 for contract 2
    assert d["X"]["redeemed"] == 3
    assert d["Y"]["soul_count"] == 4          # 3 + 1 (contract 4 without ledger)


def test_risk_drops_contracts_without_movement(spark):
    r = {x["contract_location"]: x for x in A.risk_analysis_fanout(fixture(spark)).collect()}
    assert r["X"]["total_souls"] == 1         # contract 2 has no ledger movement
    assert r["X"]["active_souls"] == 1        # event_count 6 > 5
    assert r["X"]["avg_net_power"] == Decimal("14.00")


def test_rank_ties(spark):
    c = [(i, "Bound", "Evil", loc, T0) for i, loc in ((1, "A"), (2, "B"), (3, "C"))]
    lg = [(10, 1, 5, T0, "x"), (11, 2, 5, T0, "x"), (12, 3, 1, T0, "x")]
    t = make_tables(spark, c, [], lg)
    ranks = sorted(r["profitability_rank"] for r in A.location_profitability(t).collect())
    assert ranks == [1, 1, 3]


def test_golden_rates(spark):
    pairs = [(42, 172), (48, 180), (51, 168), (45, 157), (37, 159), (46, 164)]
    df = spark.createDataFrame(pairs, "r long, n long")
    got = [x[0] for x in df.select(rate_1dp("r", "n")).collect()]
    assert got == [24.4, 26.7, 30.4, 28.7, 23.3, 28.0]


def test_profile_joined_nulls(spark):
    p = by_id(P.profile_joined(fixture(spark), [1, 2, 3, 4, 5]))
    assert sorted(p[1]["events"]) == ["a", "a", "a", "b", "b", "b"]
    assert p[1]["total_power"] == Decimal("14")                 # 7 x 2 events
    assert p[2]["total_power"] is None and sorted(p[2]["events"], key=str) == [None, "c"]
    assert p[3]["events"] == [None, None, None]
    assert p[4]["events"] == [None] and p[4]["total_power"] is None


def test_running_totals(spark):
    t = fixture(spark)
    rows = A.running_totals(A.daily_totals(t.ledger)).collect()
    assert [r["running_total"] for r in rows] == [Decimal(x) for x in ("10", "7", "18", "27")]
    assert {r["day_rank"] for r in rows} == {1, 2, 3, 4}


def test_dataset_summary(spark):
    s = {r["table_name"]: r["row_count"] for r in A.dataset_summary(fixture(spark)).collect()}
    assert s == {"contracts": 5, "events": 4, "ledger": 7}


def test_active_threshold_parameter(spark):
    r5 = {x["contract_location"]: x["active_souls"] for x in A.risk_analysis_fanout(fixture(spark)).collect()}
    r10 = {x["contract_location"]: x["active_souls"] for x in A.risk_analysis_fanout(fixture(spark), 10).collect()}
    assert r5["X"] == 1 and r10["X"] == 0          # contract 1 has 6 joined events
