"""SQL text shared by the DuckDB oracle queries: the table binding and exact helpers.

The binding mirrors ``covenant.sources.binding`` clause for clause.
"""

from __future__ import annotations

BINDING = """
contracts AS (
  SELECT c.c_custkey AS id,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Redeemed' WHEN 'AUTOMOBILE' THEN 'Bound'
              WHEN 'MACHINERY' THEN 'Pending_Judgment' ELSE 'Condemned' END AS contract_status,
         CASE c.c_custkey % 6 WHEN 0 THEN 'Innocent' WHEN 1 THEN 'Sinner' WHEN 2 THEN 'Corrupt'
              WHEN 3 THEN 'Evil' WHEN 4 THEN 'Murderer' WHEN 5 THEN 'Betrayer' END AS soul_type,
         n.n_name AS contract_location,
         u.updated_at
  FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey) u
         ON u.o_custkey = c.c_custkey
),
contract_events AS (
  SELECT event_id AS id, user_id AS soul_contract_id, ts AS event_time, event_type AS description
  FROM events
),
ledger AS (
  SELECT o_orderkey AS id, o_custkey AS soul_contract_id,
         CAST(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,6)) AS amount,
         o_orderdate AS transaction_time, o_orderpriority AS description
  FROM orders
),
r_contracts AS (
  SELECT id,
         CASE WHEN id % 89 = 0 THEN 'Condemned' ELSE contract_status END AS contract_status,
         CASE WHEN id % 83 = 0 THEN NULL ELSE soul_type END AS soul_type,
         contract_location, updated_at
  FROM contracts WHERE id % 97 <> 0
),
r_ledger AS (
  SELECT id, soul_contract_id,
         CAST(CASE WHEN id % 1009 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(18,6)) AS amount,
         transaction_time,
         CASE WHEN id % 997 = 0 THEN NULL ELSE description END AS description
  FROM ledger WHERE id % 1013 <> 0
),
commands AS (
  SELECT user_id AS contract_id,
         CASE event_type WHEN 'purchase' THEN 'Redeemed' WHEN 'signup' THEN 'Bound'
              WHEN 'error' THEN 'Condemned' END AS new_status,
         CAST(value AS DECIMAL(18,6)) AS amount, ts, event_id AS seq
  FROM events WHERE event_type IN ('purchase', 'signup', 'error')
),
measurements AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS scenario, event_type AS system,
         event_id AS iteration, value AS elapsed_ms
  FROM events WHERE event_type IN ('click', 'view')
)"""


def with_binding(*ctes: str) -> str:
    """``WITH <binding>, <ctes...>`` prefix."""
    extra = "".join(",\n" + c for c in ctes)
    return "WITH " + BINDING.strip() + extra + "\n"


def rate_1dp(part: str, whole: str) -> str:
    return (f"CASE WHEN ({whole}) > 0 THEN CAST(((2000 * CAST({part} AS BIGINT) + ({whole})) "
            f"// (2 * CAST({whole} AS BIGINT))) AS DOUBLE) / 10.0::DOUBLE END")


def dec_mean(total: str, n: str, scale: int = 6) -> str:
    """Exact decimal total/n rounded half away from zero to ``scale`` digits."""
    a = f"CAST(({total}) * 1000000 AS HUGEINT)"
    d = f"(CAST({n} AS HUGEINT) * {10 ** (6 - scale)})"
    q = (f"(CASE WHEN {a} >= 0 THEN (2 * {a} + {d}) // (2 * {d}) "
         f"ELSE -((2 * (-{a}) + {d}) // (2 * {d})) END)")
    unit = f"CAST({10.0 ** -scale:.{scale}f} AS DECIMAL({scale + 1},{scale}))" if scale else "1"
    return f"CAST(CAST({q} AS DECIMAL(38,0)) * {unit} AS DECIMAL(38,{scale}))"

