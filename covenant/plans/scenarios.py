"""The reference's named scenarios as compositions of operators.

Each returns a dict of lazily planned DataFrames; nothing is collected. The
measurement side of a scenario (timings of two systems) is a measurement
DataFrame fed to ``covenant.operators.stats``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from covenant.operators import analytics as A
from covenant.operators import lookups as L
from covenant.operators import mutations as M
from covenant.operators import profile as P
from covenant.operators import stats as T
from covenant.sources import items as I
from covenant.sources.binding import Tables


def complete_profile(t: Tables, right: Tables, items: DataFrame, status: str = "Bound") -> dict:
    """Scenario 1: pick a contract present in both stores, its item collection
    and its normalized profile (contract + events + ledger by time)."""
    row = L.sample_common_id(t.contracts, right.contracts, status).first()
    cid = None if row is None else row[0]
    return {"id": cid,
            "items": I.item_collection(items, cid),
            "profile": P.profile_full(t, [cid]),
            "joined": P.profile_joined(t, [cid])}


def business_analytics(t: Tables, items: DataFrame, locations=None) -> dict:
    """Scenario 2: the dashboard from both shapes of the store."""
    return {"normalized": A.location_dashboard(t),
            "items": A.location_dashboard_items(items, locations)}


def redemption_write(t: Tables, commands: DataFrame) -> dict:
    """Scenario 3: apply the write bundle and audit the result."""
    after = M.apply_commands(t, commands, mode="update_only")
    return {"tables": after, "audit": P.audit_latest(after, commands.select("contract_id"))}


def batch_lookup(t: Tables, status: str = "Bound", n: int = 10) -> dict:
    """Scenario 4: the first ``n`` contracts of a status, fetched as one batch."""
    ids = L.lookup_status(t.contracts, status, n).select("id")
    return {"ids": ids, "contracts": L.batch_get(t.contracts, ids)}


def risk_analytics(t: Tables) -> dict:
    """Scenario 5: risk ranking as the reference computes it and corrected."""
    return {"fanout": A.risk_analysis_fanout(t), "corrected": A.risk_analysis(t)}


def timing_report(measurements: DataFrame, baseline: str, other: str, by=("scenario",)) -> dict:
    """Statistics block shared by all scenarios."""
    return {"summary": T.summary_stats(measurements, "elapsed_ms", [*by, "system"]),
            "ttest": T.two_sample_ttest(measurements, "elapsed_ms", "system", baseline, other, list(by)),
            "compare": T.compare_systems(measurements, "elapsed_ms", "system", baseline, other, list(by))}


def benchmark_suite(t: Tables, right: Tables, commands: DataFrame, status: str = "Bound") -> dict:
    """The five benchmark workloads: joined profile of one contract (A7), the
    joined-rows dashboard (A4), a batch get of the first 8 of 10 contracts of a
    status (S9), touch bundles (M7: time + event, no ledger) and the
    profitability ranking (A5)."""
    row = L.sample_common_id(t.contracts, right.contracts, status).first()
    cid = None if row is None else row[0]
    ids = L.lookup_status(t.contracts, status, 10).select("id").limit(8)
    return {"profile": P.profile_joined(t, [cid]),
            "analytics": A.location_dashboard_joined(t),
            "batch": L.batch_get(t.contracts, ids),
            "writes": M.apply_touches(t, commands),
            "complex": A.location_profitability(t)}
