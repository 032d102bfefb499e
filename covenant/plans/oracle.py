"""DuckDB-runnable SQL for every registered query that SQL can express.

Each string starts from the same table binding as ``covenant.sources.binding``;
column names and types are aligned with the Spark results (decimals cast to
DECIMAL(38,s), counts and ranks BIGINT, 1-dp rates DOUBLE).
"""

from __future__ import annotations

from covenant.plans.sqlbits import dec_mean, rate_1dp, with_binding

Q: dict[str, str] = {}

Q["location_dashboard"] = with_binding("""
lt AS (SELECT soul_contract_id, SUM(amount) AS total_power_per_soul FROM ledger GROUP BY soul_contract_id)""") + f"""
, g AS (
  SELECT sc.contract_location,
         COUNT(*) AS soul_count,
         COUNT(CASE WHEN sc.contract_status = 'Redeemed' THEN 1 END) AS redeemed,
         CAST(SUM(COALESCE(lt.total_power_per_soul, 0)) AS DECIMAL(38,6)) AS total_power
  FROM contracts sc LEFT JOIN lt ON lt.soul_contract_id = sc.id
  GROUP BY sc.contract_location)
SELECT contract_location, soul_count, redeemed, total_power,
       {dec_mean('total_power', 'soul_count')} AS avg_power_per_soul,
       {rate_1dp('redeemed', 'soul_count')} AS redemption_rate
FROM g ORDER BY total_power DESC NULLS FIRST, contract_location
"""

# ------------------------------------------------------------------ analytics
# the literal fan-out (every event with every ledger row of a contract), reduced per contract
_SOUL_METRICS = """
pairs AS (
  SELECT c.id AS cid, e.id AS eid, e.event_time AS seen, l.amount AS amt
  FROM ledger l RIGHT JOIN contracts c ON l.soul_contract_id = c.id
  LEFT JOIN contract_events e ON e.soul_contract_id = c.id),
reduced AS (
  SELECT cid, COUNT(eid) AS event_count, MAX(seen) AS last_activity,
         CAST(COALESCE(SUM(amt) FILTER (amt > 0), 0) AS DECIMAL(38,6)) AS gains,
         CAST(COALESCE(-SUM(amt) FILTER (amt < 0), 0) AS DECIMAL(38,6)) AS losses
  FROM pairs GROUP BY cid),
soul_metrics AS (
  SELECT c.id, c.contract_location, c.soul_type, r.event_count, r.gains, r.losses, r.last_activity
  FROM contracts c JOIN reduced r ON r.cid = c.id)"""

_SOUL_METRICS_ONCE = """
touched AS (SELECT soul_contract_id AS cid, COUNT(id) AS n, MAX(event_time) AS seen FROM contract_events GROUP BY 1),
moved AS (SELECT soul_contract_id AS cid, SUM(amount) FILTER (amount > 0) AS up, -SUM(amount) FILTER (amount < 0) AS down
          FROM ledger GROUP BY 1),
soul_metrics AS (
  SELECT c.id, c.contract_location, c.soul_type, COALESCE(t.n, 0) AS event_count,
         CAST(COALESCE(m.up, 0) AS DECIMAL(38,6)) AS gains, CAST(COALESCE(m.down, 0) AS DECIMAL(38,6)) AS losses,
         t.seen AS last_activity
  FROM contracts c LEFT JOIN touched t ON t.cid = c.id LEFT JOIN moved m ON m.cid = c.id)"""

_RISK_TAIL = f"""
, per_place AS (
  SELECT contract_location AS place, COUNT(*) AS souls, SUM(gains) - SUM(losses) AS net,
         COUNT(*) FILTER (event_count > 5) AS busy
  FROM soul_metrics WHERE NOT (gains = 0 AND losses = 0) GROUP BY 1)
SELECT place AS contract_location, souls AS total_souls, {dec_mean('net', 'souls', 2)} AS avg_net_power,
       busy AS active_souls, RANK() OVER (ORDER BY net / souls DESC) AS profitability_rank,
       {rate_1dp('busy', 'souls')} AS activity_rate
FROM per_place ORDER BY profitability_rank
"""

Q["risk_analysis_fanout"] = with_binding(_SOUL_METRICS) + _RISK_TAIL
Q["risk_analysis"] = with_binding(_SOUL_METRICS_ONCE) + _RISK_TAIL
Q["fanout_join_metrics"] = with_binding(_SOUL_METRICS) + "SELECT * FROM soul_metrics"

# a contract counts once per ledger row, at least once
_JOINED_STATS = """
moved AS (SELECT soul_contract_id AS cid, COUNT(*) AS k, SUM(amount) AS power FROM ledger GROUP BY 1),
spread AS (
  SELECT contract_location, contract_status, COALESCE(k, 1) AS k, COALESCE(power, 0) AS power
  FROM contracts LEFT JOIN moved ON cid = id),
location_stats AS (
  SELECT contract_location, CAST(SUM(k) AS BIGINT) AS n_rows,
         CAST(COALESCE(SUM(k) FILTER (contract_status = 'Redeemed'), 0) AS BIGINT) AS n_redeemed,
         CAST(SUM(power) AS DECIMAL(38,6)) AS sum_power, SUM(power) / SUM(k) AS avg_power
  FROM spread GROUP BY 1)"""

Q["location_dashboard_joined"] = with_binding(_JOINED_STATS) + f"""
SELECT contract_location, n_rows AS soul_count, n_redeemed AS redeemed, sum_power AS total_power,
       {dec_mean('sum_power', 'n_rows')} AS avg_power_per_soul,
       {rate_1dp('n_redeemed', 'n_rows')} AS redemption_rate
FROM location_stats ORDER BY total_power DESC NULLS FIRST
"""

Q["location_profitability"] = with_binding(_JOINED_STATS) + f"""
SELECT contract_location, n_rows AS total_contracts, n_redeemed AS redeemed_count,
       {rate_1dp('n_redeemed', 'n_rows')} AS redemption_rate,
       {dec_mean('sum_power', 'n_rows', 2)} AS avg_net_power,
       RANK() OVER (ORDER BY avg_power DESC NULLS FIRST) AS profitability_rank,
       CASE WHEN n_redeemed > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS activity_rate
FROM location_stats ORDER BY profitability_rank
"""

Q["ledger_totals"] = with_binding() + """
SELECT soul_contract_id, CAST(SUM(amount) AS DECIMAL(38,6)) AS total_power_per_soul FROM ledger GROUP BY 1"""

Q["gains_losses"] = with_binding() + """
SELECT soul_contract_id,
       CAST(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS gains,
       CAST(SUM(CASE WHEN amount < 0 THEN ABS(amount) ELSE 0 END) AS DECIMAL(38,6)) AS losses
FROM ledger GROUP BY 1"""

Q["last_activity"] = with_binding() + """
SELECT soul_contract_id, MAX(event_time) AS last_activity FROM contract_events GROUP BY 1"""

_DAILY = """
daily AS (SELECT CAST(transaction_time AS DATE) AS contract_date, CAST(SUM(amount) AS DECIMAL(38,6)) AS daily_total
          FROM ledger GROUP BY 1)"""

Q["daily_totals"] = with_binding(_DAILY) + "SELECT * FROM daily"

Q["running_totals"] = with_binding(_DAILY) + """
SELECT contract_date, daily_total,
       CAST(SUM(daily_total) OVER (ORDER BY contract_date NULLS FIRST) AS DECIMAL(38,6)) AS running_total,
       RANK() OVER (ORDER BY daily_total DESC NULLS FIRST) AS day_rank
FROM daily ORDER BY contract_date"""

Q["dataset_summary"] = with_binding() + """
SELECT 'contracts' AS table_name, COUNT(*) AS row_count FROM contracts
UNION ALL SELECT 'events', COUNT(*) FROM contract_events
UNION ALL SELECT 'ledger', COUNT(*) FROM ledger"""

# ------------------------------------------------------------------ lookups
_PICK = """
cand AS (SELECT id FROM contracts WHERE contract_status = 'Bound' ORDER BY id LIMIT 10),
pick AS (SELECT COALESCE(MIN(c.id) FILTER (WHERE r.id IS NOT NULL), MIN(c.id)) AS id
         FROM cand c LEFT JOIN r_contracts r ON r.id = c.id)"""

Q["scan_contracts"] = with_binding() + "SELECT * FROM contracts"
Q["scan_events"] = with_binding() + "SELECT * FROM contract_events"
Q["scan_ledger"] = with_binding() + "SELECT * FROM ledger"
Q["lookup_status"] = with_binding() + "SELECT * FROM contracts WHERE contract_status = 'Bound' ORDER BY id"
Q["lookup_by_date"] = with_binding() + """
SELECT * FROM contract_events
WHERE event_time >= TIMESTAMP '2024-01-15 00:00:00' AND event_time < TIMESTAMP '2024-01-16 00:00:00'
ORDER BY event_time, id"""
Q["resolve_ids"] = with_binding() + """
SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS pos, id
FROM (SELECT id FROM contracts ORDER BY id LIMIT 25)"""
Q["sample_common_id"] = with_binding(_PICK) + "SELECT id FROM pick WHERE id IS NOT NULL"
Q["point_get"] = with_binding(_PICK) + "SELECT c.* FROM contracts c JOIN pick p ON c.id = p.id"
Q["batch_get"] = with_binding() + """
SELECT * FROM contracts WHERE id IN (SELECT id FROM contracts WHERE contract_status = 'Bound' ORDER BY id LIMIT 10)"""
Q["missing_in_other"] = with_binding() + """
SELECT * FROM contracts c WHERE NOT EXISTS (SELECT 1 FROM r_contracts r WHERE r.id = c.id)"""
Q["structure_sample"] = with_binding() + """
SELECT id, contract_status, soul_type, contract_location FROM contracts ORDER BY id LIMIT 3"""
_INVENTORY = """
inventory AS (
  SELECT 'customer' AS table_name, TRUE AS present, COUNT(*) AS row_count FROM customer
  UNION ALL SELECT 'orders', TRUE, COUNT(*) FROM orders
  UNION ALL SELECT 'events', TRUE, COUNT(*) FROM events)"""
Q["table_inventory"] = with_binding(_INVENTORY) + "SELECT * FROM inventory"
Q["readiness"] = with_binding(_INVENTORY) + """
SELECT COUNT(*) AS expected, COUNT(CASE WHEN present THEN 1 END) AS present,
       CAST(SUM(COALESCE(row_count, 0)) AS BIGINT) AS total_rows,
       (COUNT(CASE WHEN present THEN 1 END) = COUNT(*)) OR (COUNT(CASE WHEN present THEN 1 END) = 0) AS ready
FROM inventory"""

# ------------------------------------------------------------------ profiles
Q["profile_joined"] = with_binding(_PICK) + """
, texts AS (SELECT description FROM contract_events WHERE soul_contract_id = (SELECT id FROM pick)),
sums AS (SELECT amount FROM ledger WHERE soul_contract_id = (SELECT id FROM pick)),
grid AS (SELECT description, amount FROM (SELECT 1 AS one) LEFT JOIN texts ON TRUE LEFT JOIN sums ON TRUE),
told AS (
  SELECT string_agg(COALESCE(description, 'NULL'), '|' ORDER BY description NULLS LAST) AS events,
         CAST(SUM(amount) AS DECIMAL(38,6)) AS total_power FROM grid)
SELECT c.id, contract_status, soul_type, contract_location, updated_at, events, total_power
FROM pick JOIN contracts c ON c.id = pick.id CROSS JOIN told"""

_FLAT = """
flat AS (
  SELECT id AS contract_id, 'contract' AS kind, updated_at AS time, NULL::VARCHAR AS description,
         NULL::DECIMAL(38,6) AS amount, contract_status, soul_type, contract_location FROM contracts
  UNION ALL
  SELECT soul_contract_id, 'event', event_time, description, NULL, NULL, NULL, NULL FROM contract_events
  UNION ALL
  SELECT soul_contract_id, 'ledger', transaction_time, description, CAST(amount AS DECIMAL(38,6)), NULL, NULL, NULL
  FROM ledger)"""
Q["profile_full"] = with_binding(_FLAT) + "SELECT * FROM flat"
Q["profile_one"] = with_binding(_PICK, _FLAT) + "SELECT * FROM flat WHERE contract_id = (SELECT id FROM pick)"

Q["audit_latest"] = with_binding("""
le AS (SELECT soul_contract_id, description AS last_event, event_time AS last_event_time,
              row_number() OVER (PARTITION BY soul_contract_id ORDER BY event_time DESC NULLS FIRST, id) AS rn
       FROM contract_events),
ll AS (SELECT soul_contract_id, amount AS last_amount, transaction_time AS last_amount_time,
              row_number() OVER (PARTITION BY soul_contract_id ORDER BY transaction_time DESC NULLS FIRST, id) AS rn
       FROM ledger)""") + """
SELECT sc.id, sc.contract_status, sc.updated_at, le.last_event, le.last_event_time, ll.last_amount, ll.last_amount_time
FROM contracts sc
LEFT JOIN le ON le.soul_contract_id = sc.id AND le.rn = 1
LEFT JOIN ll ON ll.soul_contract_id = sc.id AND ll.rn = 1"""

# ------------------------------------------------------------------ item store
_ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
_ITEMS = f"""
items_raw AS (
  SELECT 'SOUL#' || CAST(id AS VARCHAR) AS PK, 'CONTRACT' AS SK, CAST(id AS VARCHAR) AS soulId,
         contract_status AS status, NULL::VARCHAR AS contract_status, soul_type, contract_location,
         strftime(updated_at, {_ISO}) AS createdAt, NULL::VARCHAR AS updated_at, NULL::VARCHAR AS eventType,
         NULL::VARCHAR AS "timestamp", NULL::VARCHAR AS event_time, NULL::VARCHAR AS transaction_time,
         NULL::VARCHAR AS transaction_type, NULL::DECIMAL(18,6) AS amount, NULL::VARCHAR AS description,
         'STATUS#' || contract_status AS GSI1PK, strftime(updated_at, {_ISO}) AS GSI1SK,
         NULL::VARCHAR AS updatedAt, NULL::VARCHAR AS soulType, NULL::VARCHAR AS contractLocation,
         CAST(0 AS BIGINT) AS _seq
  FROM contracts
  UNION ALL
  SELECT 'SOUL#' || CAST(soul_contract_id AS VARCHAR), 'EVENT#' || strftime(event_time, {_ISO}), NULL, NULL, NULL,
         NULL, NULL, NULL, NULL, replace(description, ' ', '_'), strftime(event_time, {_ISO}), NULL, NULL, NULL, NULL,
         description, 'EVENT#' || substring(strftime(event_time, {_ISO}), 1, 10), strftime(event_time, {_ISO}),
         NULL, NULL, NULL, id
  FROM contract_events
  UNION ALL
  SELECT 'SOUL#' || CAST(soul_contract_id AS VARCHAR), 'LEDGER#' || strftime(transaction_time, {_ISO}), NULL, NULL,
         NULL, NULL, NULL, NULL, NULL, NULL, strftime(transaction_time, {_ISO}), NULL, NULL, NULL, amount,
         description, 'LEDGER#' || substring(strftime(transaction_time, {_ISO}), 1, 10),
         strftime(transaction_time, {_ISO}), NULL, NULL, NULL, id
  FROM ledger),
items AS (
  SELECT * FROM items_raw WHERE PK IS NOT NULL AND SK IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY PK, SK ORDER BY _seq DESC) = 1)"""

Q["to_items"] = with_binding(_ITEMS) + "SELECT * FROM items_raw"
Q["put_items"] = with_binding(_ITEMS) + "SELECT * FROM items"
Q["items_contracts"] = with_binding(_ITEMS) + """
SELECT substring(PK, 6) AS id, COALESCE(NULLIF(status, ''), NULLIF(contract_status, ''), 'Unknown') AS status
FROM items WHERE SK = 'CONTRACT'"""
Q["item_collection"] = with_binding(_PICK, _ITEMS) + """
SELECT * FROM items WHERE PK = 'SOUL#' || CAST((SELECT id FROM pick) AS VARCHAR) ORDER BY SK"""
Q["items_by_prefix"] = with_binding(_PICK, _ITEMS) + """
SELECT * FROM items WHERE PK = 'SOUL#' || CAST((SELECT id FROM pick) AS VARCHAR) AND starts_with(SK, 'LEDGER#')
ORDER BY SK"""
Q["lookup_location"] = with_binding(_ITEMS) + """
SELECT * FROM items WHERE contract_location IS NOT NULL AND status IS NOT NULL AND contract_location = 'NATION_1'
ORDER BY status, PK, SK"""
Q["from_items_contracts"] = with_binding(_ITEMS) + """
SELECT COALESCE(NULLIF(soulId, ''), substring(PK, 6)) AS id,
       COALESCE(NULLIF(status, ''), NULLIF(contract_status, ''), 'Unknown') AS contract_status,
       COALESCE(NULLIF(soul_type, ''), NULLIF(soulType, '')) AS soul_type,
       COALESCE(NULLIF(contract_location, ''), NULLIF(contractLocation, '')) AS contract_location,
       CAST(try_strptime(COALESCE(NULLIF(updatedAt, ''), NULLIF(createdAt, '')), '%Y-%m-%dT%H:%M:%S.%gZ') AS TIMESTAMP)
         AS updated_at
FROM items WHERE SK = 'CONTRACT'"""
Q["from_items_ledger"] = with_binding(_ITEMS) + """
SELECT SK AS id, substring(PK, 6) AS soul_contract_id, amount,
       CAST(try_strptime(COALESCE(NULLIF("timestamp", ''), NULLIF(substring(SK, 8), '')), '%Y-%m-%dT%H:%M:%S.%gZ') AS TIMESTAMP)
         AS transaction_time,
       COALESCE(NULLIF("timestamp", ''), NULLIF(substring(SK, 8), '')) AS transaction_time_text,
       NULLIF(description, '') AS description
FROM items WHERE starts_with(SK, 'LEDGER#')"""
Q["location_dashboard_items"] = with_binding(_ITEMS, """
ci AS (SELECT PK, status, contract_location FROM items
       WHERE contract_location IS NOT NULL AND status IS NOT NULL AND SK = 'CONTRACT'),
li AS (SELECT PK, SUM(COALESCE(amount, 0)) AS s FROM items WHERE starts_with(SK, 'LEDGER#') GROUP BY PK),
g AS (SELECT contract_location, COUNT(*) AS soul_count, COUNT(CASE WHEN status = 'Redeemed' THEN 1 END) AS redeemed,
             CAST(SUM(COALESCE(li.s, 0)) AS DECIMAL(38,6)) AS total_power
      FROM ci LEFT JOIN li ON li.PK = ci.PK GROUP BY contract_location)""") + f"""
SELECT contract_location, soul_count, redeemed, total_power,
       {dec_mean('total_power', 'soul_count')} AS avg_power_per_soul,
       CAST(redeemed AS DOUBLE) / soul_count * 100.0::DOUBLE AS redemption_rate
FROM g WHERE soul_count > 0 ORDER BY total_power DESC NULLS FIRST"""

# ------------------------------------------------------------------ parity
_LEFT_ITEM_CONTRACTS = """
lic AS (SELECT substring(PK, 6) AS id, COALESCE(NULLIF(status, ''), NULLIF(contract_status, ''), 'Unknown') AS status
        FROM items WHERE SK = 'CONTRACT'),
ric AS (SELECT CAST(id AS VARCHAR) AS id, contract_status AS status FROM r_contracts)"""

Q["consistency_report"] = with_binding(_ITEMS, _LEFT_ITEM_CONTRACTS) + """
SELECT NULL::VARCHAR AS contract_id, 'contracts' AS scope, 'count' AS field, NULL::BIGINT AS idx,
       CAST((SELECT COUNT(*) FROM lic) AS VARCHAR) AS left_value, CAST((SELECT COUNT(*) FROM ric) AS VARCHAR) AS right_value
WHERE (SELECT COUNT(*) FROM lic) <> (SELECT COUNT(*) FROM ric)
UNION ALL
SELECT l.id, 'contracts', 'missing_right', NULL, 'present', NULL FROM lic l
WHERE NOT EXISTS (SELECT 1 FROM ric r WHERE r.id = l.id)
UNION ALL
SELECT l.id, 'contracts', 'status', NULL, l.status, r.status FROM lic l JOIN ric r ON r.id = l.id
WHERE l.status IS DISTINCT FROM r.status"""

_PARITY_CONTRACTS = """
pln AS (SELECT CAST(id AS VARCHAR) AS id, COALESCE(NULLIF(contract_status, ''), 'Unknown') AS status,
               NULLIF(soul_type, '') AS soulType, NULLIF(contract_location, '') AS contractLocation FROM contracts),
prn AS (SELECT CAST(id AS VARCHAR) AS id, COALESCE(NULLIF(contract_status, ''), 'Unknown') AS status,
               NULLIF(soul_type, '') AS soulType, NULLIF(contract_location, '') AS contractLocation FROM r_contracts),
all_ids AS (SELECT id FROM pln UNION SELECT id FROM prn),
pj AS (SELECT i.id, l.id IS NOT NULL AS hl, r.id IS NOT NULL AS hr,
              l.status AS ls, r.status AS rs, l.soulType AS lt, r.soulType AS rt,
              l.contractLocation AS ll, r.contractLocation AS rl
       FROM all_ids i LEFT JOIN pln l ON l.id = i.id LEFT JOIN prn r ON r.id = i.id),
contract_issues AS (
  SELECT id AS contract_id, 'contracts' AS scope,
         CASE WHEN NOT hl AND NOT hr THEN 'missing_both' WHEN NOT hl THEN 'missing_left' ELSE 'missing_right' END AS field,
         NULL::BIGINT AS idx, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value
  FROM pj WHERE NOT hl OR NOT hr
  UNION ALL SELECT id, 'contracts', 'status', NULL, ls, rs FROM pj WHERE hl AND hr AND ls IS DISTINCT FROM rs
  UNION ALL SELECT id, 'contracts', 'soulType', NULL, lt, rt FROM pj WHERE hl AND hr AND lt IS DISTINCT FROM rt
  UNION ALL SELECT id, 'contracts', 'contractLocation', NULL, ll, rl FROM pj
  WHERE hl AND hr AND ll IS DISTINCT FROM rl)"""


def _positional(scope: str, lsrc: str, rsrc: str, ltime: str, rtime: str, amount: bool, name: str) -> str:
    """Positional comparison of two collections (count issues + per-position field issues)."""
    a = "amount" if amount else "NULL::DECIMAL(18,6)"
    return f"""
{name}_lc AS (SELECT CAST(soul_contract_id AS VARCHAR) AS cid, {ltime} AS t,
                     COALESCE(description, '') AS d, {a} AS a FROM {lsrc}),
{name}_rc AS (SELECT CAST(soul_contract_id AS VARCHAR) AS cid, {rtime} AS t,
                     COALESCE(description, '') AS d, {a} AS a FROM {rsrc}),
{name}_cnt AS (SELECT COALESCE(l.cid, r.cid) AS cid, COALESCE(l.n, 0) AS nl, COALESCE(r.n, 0) AS nr
               FROM (SELECT cid, COUNT(*) AS n FROM {name}_lc GROUP BY cid) l
               FULL JOIN (SELECT cid, COUNT(*) AS n FROM {name}_rc GROUP BY cid) r ON l.cid = r.cid),
{name}_lp AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY t NULLS FIRST, d NULLS FIRST, a NULLS FIRST) - 1
                      AS pos FROM {name}_lc),
{name}_rp AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY t NULLS FIRST, d NULLS FIRST, a NULLS FIRST) - 1
                      AS pos FROM {name}_rc),
{name}_pairs AS (SELECT l.cid, l.pos, l.t AS lt, r.t AS rt, l.d AS ld, r.d AS rd, l.a AS la, r.a AS ra
                 FROM {name}_lp l JOIN {name}_rp r ON l.cid = r.cid AND l.pos = r.pos),
{name}_issues AS (
  SELECT cid AS contract_id, '{scope}' AS scope, 'count' AS field, NULL::BIGINT AS idx,
         CAST(nl AS VARCHAR) AS left_value, CAST(nr AS VARCHAR) AS right_value FROM {name}_cnt WHERE nl <> nr
  UNION ALL SELECT cid, '{scope}', 'timestamp', pos, lt, rt FROM {name}_pairs WHERE lt IS DISTINCT FROM rt
  UNION ALL SELECT cid, '{scope}', 'description', pos, NULL, NULL FROM {name}_pairs WHERE ld <> rd
  UNION ALL SELECT cid, '{scope}', 'amount', pos, CAST(la AS VARCHAR), CAST(ra AS VARCHAR) FROM {name}_pairs
  WHERE (la IS NOT NULL OR ra IS NOT NULL) AND la IS DISTINCT FROM ra)"""


_ISO_TX = "strftime(transaction_time, '%Y-%m-%dT%H:%M:%S.%gZ')"
_ISO_EV = "strftime(event_time, '%Y-%m-%dT%H:%M:%S.%gZ')"
_LEDGER_PARITY = _positional("ledger entries", "ledger", "r_ledger", _ISO_TX, _ISO_TX, True, "lpar")

Q["parity_contracts"] = with_binding(_PARITY_CONTRACTS) + "SELECT * FROM contract_issues"
Q["parity_ledger"] = with_binding(_LEDGER_PARITY) + "SELECT * FROM lpar_issues"
Q["parity_ledger_keyed"] = with_binding("""
klc AS (SELECT CAST(soul_contract_id AS VARCHAR) AS cid, strftime(transaction_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS t,
               COALESCE(description, '') AS d, amount AS a FROM ledger),
krc AS (SELECT CAST(soul_contract_id AS VARCHAR) AS cid, strftime(transaction_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS t,
               COALESCE(description, '') AS d, amount AS a FROM r_ledger),
kcnt AS (SELECT COALESCE(l.cid, r.cid) AS cid, COALESCE(l.n, 0) AS nl, COALESCE(r.n, 0) AS nr
         FROM (SELECT cid, COUNT(*) AS n FROM klc GROUP BY cid) l
         FULL JOIN (SELECT cid, COUNT(*) AS n FROM krc GROUP BY cid) r ON l.cid = r.cid)""") + """
SELECT cid AS contract_id, 'ledger entries' AS scope, 'count' AS field, NULL::BIGINT AS idx,
       CAST(nl AS VARCHAR) AS left_value, CAST(nr AS VARCHAR) AS right_value FROM kcnt WHERE nl <> nr
UNION ALL
SELECT cid, 'ledger entries', 'missing_right', NULL, concat_ws('|', t, d, CAST(a AS VARCHAR)), NULL
FROM (SELECT * FROM klc EXCEPT ALL SELECT * FROM krc)
UNION ALL
SELECT cid, 'ledger entries', 'missing_left', NULL, NULL, concat_ws('|', t, d, CAST(a AS VARCHAR))
FROM (SELECT * FROM krc EXCEPT ALL SELECT * FROM klc)"""

_ITEM_EVENTS = """
item_events AS (SELECT substring(PK, 6) AS soul_contract_id,
                       COALESCE(NULLIF("timestamp", ''), NULLIF(substring(SK, 7), '')) AS event_time_text,
                       NULLIF(description, '') AS description
                FROM items WHERE starts_with(SK, 'EVENT#'))"""
Q["parity_events"] = with_binding(_ITEMS, _ITEM_EVENTS, _positional(
    "events", "item_events", "contract_events", "event_time_text", _ISO_EV, False, "epar")) + \
    "SELECT * FROM epar_issues"

_ALL_ISSUES = """
all_issues AS (SELECT * FROM contract_issues UNION ALL SELECT * FROM lpar_issues),
per_id AS (SELECT contract_id, COUNT(*) AS n_issues FROM all_issues GROUP BY contract_id)"""
Q["parity_summary"] = with_binding(_PARITY_CONTRACTS, _LEDGER_PARITY, _ALL_ISSUES) + """
SELECT CAST(COUNT(*) AS BIGINT) AS ids_checked,
       CAST(COALESCE(SUM(p.n_issues), 0) + (SELECT COUNT(*) FROM all_issues WHERE contract_id IS NULL) AS BIGINT)
         AS mismatches,
       CAST(COUNT(p.n_issues) AS BIGINT) AS ids_with_issues,
       COALESCE(SUM(p.n_issues), 0) + (SELECT COUNT(*) FROM all_issues WHERE contract_id IS NULL) = 0 AS ok
FROM all_ids i LEFT JOIN per_id p ON p.contract_id = i.id"""
Q["parity_issue_counts"] = with_binding(_PARITY_CONTRACTS, _LEDGER_PARITY, _ALL_ISSUES) + """
SELECT i.id AS contract_id, CAST(COALESCE(p.n_issues, 0) AS BIGINT) AS n_issues
FROM all_ids i LEFT JOIN per_id p ON p.contract_id = i.id"""

Q["threshold_violations"] = with_binding("""
limits AS (SELECT * FROM (VALUES ('click', 100.0::DOUBLE), ('view', 500.0::DOUBLE)) v(system, limit_ms))""") + """
SELECT m.scenario, m.system, m.iteration, m.elapsed_ms, l.limit_ms
FROM measurements m JOIN limits l ON l.system = m.system WHERE m.elapsed_ms > l.limit_ms"""

Q["items_vs_tables"] = with_binding(_ITEMS, """
ic AS (SELECT substring(PK, 6) AS cid, CASE WHEN starts_with(SK, 'EVENT#') THEN 'event' ELSE 'ledger' END AS kind,
              COUNT(*) AS ni FROM items WHERE starts_with(SK, 'EVENT#') OR starts_with(SK, 'LEDGER#') GROUP BY 1, 2),
tc AS (SELECT cid, kind, COUNT(*) AS nt FROM (
         SELECT CAST(soul_contract_id AS VARCHAR) AS cid, 'event' AS kind FROM contract_events
         UNION ALL SELECT CAST(soul_contract_id AS VARCHAR), 'ledger' FROM ledger) GROUP BY 1, 2)""") + """
SELECT COALESCE(ic.cid, tc.cid) AS contract_id, COALESCE(ic.kind, tc.kind) AS scope, 'count' AS field,
       NULL::BIGINT AS idx, CAST(COALESCE(ni, 0) AS VARCHAR) AS left_value, CAST(COALESCE(nt, 0) AS VARCHAR) AS right_value
FROM ic FULL JOIN tc ON ic.cid = tc.cid AND ic.kind = tc.kind
WHERE COALESCE(ni, 0) <> COALESCE(nt, 0)"""

# ------------------------------------------------------------------ statistics


def _labels_cv(cv: str, levels: int) -> str:
    if levels == 3:
        return f"CASE WHEN {cv} < 20 THEN 'Excellent' WHEN {cv} < 40 THEN 'Good' ELSE 'Variable' END"
    return (f"CASE WHEN {cv} < 20 THEN 'Excellent' WHEN {cv} < 40 THEN 'Good' WHEN {cv} < 60 THEN 'Variable' "
            f"ELSE 'Highly Variable' END")


def _summary(by: str, levels: int) -> str:
    join = " AND ".join(f"p.{c} = mom.{c}" for c in by.split(", "))
    sel_p = ", ".join(f"p.{c}" for c in by.split(", "))
    return with_binding(f"""
mom AS (SELECT {by}, COUNT(elapsed_ms) AS n, AVG(elapsed_ms) AS mean, MIN(elapsed_ms) AS mn,
               MAX(elapsed_ms) AS mx, STDDEV_SAMP(elapsed_ms) AS sd FROM measurements GROUP BY {by}),
pos AS (SELECT {by}, elapsed_ms, row_number() OVER (PARTITION BY {by} ORDER BY elapsed_ms) - 1 AS pos
        FROM measurements WHERE elapsed_ms IS NOT NULL),
pct AS (SELECT {sel_p},
               MAX(CASE WHEN pos = floor(CAST(n AS DOUBLE) * 0.5::DOUBLE) THEN elapsed_ms END) AS p50,
               MAX(CASE WHEN pos = floor(CAST(n AS DOUBLE) * 0.95::DOUBLE) THEN elapsed_ms END) AS p95,
               MAX(CASE WHEN pos = floor(CAST(n AS DOUBLE) * 0.99::DOUBLE) THEN elapsed_ms END) AS p99
        FROM pos p JOIN mom ON {join} GROUP BY {sel_p}),
s AS (SELECT mom.*, pct.p50, pct.p95, pct.p99, 100.0::DOUBLE * sd / NULLIF(mean, 0) AS cvd
      FROM mom LEFT JOIN pct USING ({by}))""") + f"""
SELECT {by}, CAST(n AS BIGINT) AS n, CAST(mean AS DECIMAL(18,4)) AS mean, mn AS min, mx AS max,
       CAST(sd AS DECIMAL(18,4)) AS stddev, CAST(cvd AS DECIMAL(18,4)) AS cv,
       CAST(1.96::DOUBLE * sd / sqrt(CAST(n AS DOUBLE)) AS DECIMAL(18,4)) AS ci95, p50, p95, p99,
       {_labels_cv('cvd', levels)} AS consistency,
       CASE WHEN n >= 100 THEN 'HIGH' WHEN n >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM s"""


Q["summary_stats"] = _summary("scenario, system", 4)
Q["summary_stats_3level"] = _summary("system", 3)

Q["two_sample_ttest"] = with_binding("""
s AS (SELECT scenario,
             COUNT(CASE WHEN system = 'click' THEN elapsed_ms END) AS n1,
             COUNT(CASE WHEN system = 'view' THEN elapsed_ms END) AS n2,
             AVG(CASE WHEN system = 'click' THEN elapsed_ms END) AS m1,
             AVG(CASE WHEN system = 'view' THEN elapsed_ms END) AS m2,
             VAR_SAMP(CASE WHEN system = 'click' THEN elapsed_ms END) AS v1,
             VAR_SAMP(CASE WHEN system = 'view' THEN elapsed_ms END) AS v2
      FROM measurements WHERE system IN ('click', 'view') GROUP BY scenario),
t AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sp, abs(m1 - m2) AS diff FROM s),
u AS (SELECT *, diff / (sp * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS tt, diff / sp AS dd FROM t),
w AS (SELECT *, CASE WHEN tt > 3 THEN 0.001::DOUBLE WHEN tt > 2.5 THEN 0.01::DOUBLE WHEN tt > 2 THEN 0.05::DOUBLE
                     WHEN tt > 1.5 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS p FROM u)""") + """
SELECT scenario, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       CAST(m1 AS DECIMAL(18,4)) AS mean1, CAST(m2 AS DECIMAL(18,4)) AS mean2,
       CAST(tt AS DECIMAL(18,4)) AS t_stat, CAST(n1 + n2 - 2 AS BIGINT) AS dof, p AS p_value,
       p < 0.05 AS significant, CAST(dd AS DECIMAL(18,4)) AS effect_size,
       CASE WHEN dd < 0.2 THEN 'negligible' WHEN dd < 0.5 THEN 'small' WHEN dd < 0.8 THEN 'medium' ELSE 'large' END
         AS effect
FROM w"""

Q["compare_systems"] = with_binding("""
g AS (SELECT scenario, AVG(CASE WHEN system = 'click' THEN elapsed_ms END) AS mb,
             AVG(CASE WHEN system = 'view' THEN elapsed_ms END) AS mo,
             MAX(CASE WHEN system = 'view' THEN elapsed_ms END) AS xo
      FROM measurements WHERE system IN ('click', 'view') GROUP BY scenario)""") + """
SELECT scenario, CAST(mb AS DECIMAL(18,4)) AS mean_baseline, CAST(mo AS DECIMAL(18,4)) AS mean_other,
       CAST(mo / mb AS DECIMAL(18,4)) AS ratio, CAST(mo - mb AS DECIMAL(18,4)) AS delta,
       CASE WHEN mb <= mo THEN 'click' ELSE 'view' END AS faster,
       CAST(mb / 10 AS DECIMAL(18,4)) AS per_item_baseline, CAST(mo / 10 AS DECIMAL(18,4)) AS per_item_other,
       xo > 200 AS outlier, CAST(xo / mb AS DECIMAL(18,4)) AS outlier_ratio
FROM g"""

# ------------------------------------------------------------------ commands
_JSON_BODIES = """
bodies AS (SELECT seq, ts, CAST(json_object('soulContractId', CAST(contract_id AS VARCHAR), 'newStatus', new_status,
                                            'amount', CAST(amount AS DOUBLE)) AS VARCHAR) AS value FROM commands)"""

Q["validate_commands"] = with_binding(_JSON_BODIES) + """
SELECT json_extract_string(value, '$.soulContractId') AS contract_id, json_extract_string(value, '$.newStatus') AS new_status,
       CAST(CAST(json_extract(value, '$.amount') AS DOUBLE) AS DECIMAL(18,6)) AS amount, ts, seq
FROM bodies
WHERE json_valid(value) AND COALESCE(json_extract_string(value, '$.soulContractId'), '') <> ''
  AND COALESCE(json_extract_string(value, '$.newStatus'), '') <> ''
  AND json_type(value, '$.amount') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"""


def _rejects(id_key: str, amount_ok: str, reason: str) -> str:
    return with_binding() + f"""
SELECT props AS value,
       CASE WHEN props IS NULL THEN 'Missing request body'
            WHEN NOT json_valid(props) THEN 'Invalid JSON'
            ELSE '{reason}' END AS reason
FROM events
WHERE props IS NULL OR NOT json_valid(props)
   OR json_type(props) <> 'OBJECT'
   OR COALESCE(json_extract_string(props, '$.{id_key}'), '') IN ('', '0', 'false')
   OR COALESCE(json_extract_string(props, '$.newStatus'), '') IN ('', '0', 'false')
   OR NOT ({amount_ok})"""


Q["validate_commands_rejected"] = _rejects(
    "soulContractId", "COALESCE(json_type(props, '$.amount') IN ('BIGINT', 'UBIGINT', 'DOUBLE'), FALSE)",
    "Missing soulContractId, newStatus, or amount")
Q["validate_commands_lenient"] = _rejects(
    "soulId", "json_type(props, '$.amount') IS NOT NULL", "Missing soulId, newStatus, or amount in request")

_LATEST = """
latest AS (SELECT contract_id, new_status, ts FROM commands
           QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY ts DESC, seq DESC) = 1)"""

Q["apply_commands_contracts"] = with_binding(_LATEST) + """
SELECT COALESCE(c.id, l.contract_id) AS id,
       CASE WHEN l.contract_id IS NOT NULL THEN l.new_status ELSE c.contract_status END AS contract_status,
       c.soul_type, c.contract_location,
       CASE WHEN l.contract_id IS NOT NULL THEN l.ts ELSE c.updated_at END AS updated_at
FROM contracts c FULL JOIN latest l ON c.id = l.contract_id"""

Q["apply_update_only_contracts"] = with_binding(_LATEST) + """
SELECT c.id,
       CASE WHEN l.contract_id IS NOT NULL THEN l.new_status ELSE c.contract_status END AS contract_status,
       c.soul_type, c.contract_location,
       CASE WHEN l.contract_id IS NOT NULL THEN l.ts ELSE c.updated_at END AS updated_at
FROM contracts c LEFT JOIN latest l ON c.id = l.contract_id"""

_NEW_EVENTS = """
new_events AS (SELECT -(seq * 2 + 2) AS id, contract_id AS soul_contract_id, ts AS event_time,
                      'Contract updated to ''' || new_status || '''' AS description FROM commands),
new_ledger AS (SELECT -(seq * 2 + 1) AS id, contract_id AS soul_contract_id, amount, ts AS transaction_time,
                      'Financial transaction: ' || new_status AS description FROM commands),
a_events AS (SELECT * FROM contract_events UNION ALL
             SELECT * FROM new_events n WHERE NOT EXISTS (SELECT 1 FROM contract_events e WHERE e.id = n.id)),
a_ledger AS (SELECT * FROM ledger UNION ALL
             SELECT * FROM new_ledger n WHERE NOT EXISTS (SELECT 1 FROM ledger e WHERE e.id = n.id))"""

Q["apply_commands_events"] = with_binding(_NEW_EVENTS) + "SELECT * FROM a_events"
Q["apply_commands_ledger"] = with_binding(_NEW_EVENTS) + "SELECT * FROM a_ledger"
Q["apply_touches_events"] = with_binding() + """
SELECT * FROM contract_events UNION ALL
SELECT -(seq * 2 + 2), contract_id, ts, 'Benchmark event ' || CAST(seq AS VARCHAR) FROM commands"""

Q["audit_after_commands"] = with_binding(_LATEST, _NEW_EVENTS, """
a_contracts AS (
  SELECT COALESCE(c.id, l.contract_id) AS id,
         CASE WHEN l.contract_id IS NOT NULL THEN l.new_status ELSE c.contract_status END AS contract_status,
         CASE WHEN l.contract_id IS NOT NULL THEN l.ts ELSE c.updated_at END AS updated_at
  FROM contracts c FULL JOIN latest l ON c.id = l.contract_id),
le AS (SELECT soul_contract_id, description AS last_event, event_time AS last_event_time,
              row_number() OVER (PARTITION BY soul_contract_id ORDER BY event_time DESC NULLS FIRST, id) AS rn
       FROM a_events),
ll AS (SELECT soul_contract_id, amount AS last_amount, transaction_time AS last_amount_time,
              row_number() OVER (PARTITION BY soul_contract_id ORDER BY transaction_time DESC NULLS FIRST, id) AS rn
       FROM a_ledger)""") + """
SELECT sc.id, sc.contract_status, sc.updated_at, le.last_event, le.last_event_time, ll.last_amount, ll.last_amount_time
FROM a_contracts sc
LEFT JOIN le ON le.soul_contract_id = sc.id AND le.rn = 1
LEFT JOIN ll ON ll.soul_contract_id = sc.id AND ll.rn = 1"""

Q["apply_commands_items"] = with_binding(_ITEMS, _LATEST, f"""
upd AS (SELECT 'SOUL#' || CAST(contract_id AS VARCHAR) AS upk, new_status AS ust, strftime(ts, {_ISO}) AS uts
        FROM latest),
merged AS (
  SELECT COALESCE(i.PK, u.upk) AS PK, COALESCE(i.SK, 'CONTRACT') AS SK, i.soulId, i.status,
         CASE WHEN u.upk IS NOT NULL THEN u.ust ELSE i.contract_status END AS contract_status,
         i.soul_type, i.contract_location, i.createdAt,
         CASE WHEN u.upk IS NOT NULL THEN u.uts ELSE i.updated_at END AS updated_at,
         i.eventType, i."timestamp", i.event_time, i.transaction_time, i.transaction_type, i.amount, i.description,
         i.GSI1PK, i.GSI1SK, i.updatedAt, i.soulType, i.contractLocation, COALESCE(i._seq, 0) AS _seq
  FROM items i FULL JOIN upd u ON i.SK = 'CONTRACT' AND i.PK = u.upk),
puts AS (
  SELECT 'SOUL#' || CAST(contract_id AS VARCHAR) AS PK, 'EVENT#' || sha256('event|' || CAST(seq AS VARCHAR)) AS SK,
         NULL::VARCHAR AS soulId, NULL::VARCHAR AS status, NULL::VARCHAR AS contract_status, NULL::VARCHAR AS soul_type,
         NULL::VARCHAR AS contract_location, NULL::VARCHAR AS createdAt, NULL::VARCHAR AS updated_at,
         NULL::VARCHAR AS eventType, NULL::VARCHAR AS "timestamp", strftime(ts, {_ISO}) AS event_time,
         NULL::VARCHAR AS transaction_time, NULL::VARCHAR AS transaction_type, NULL::DECIMAL(18,6) AS amount,
         'Contract updated to ''' || new_status || '''' AS description, NULL::VARCHAR AS GSI1PK,
         NULL::VARCHAR AS GSI1SK, NULL::VARCHAR AS updatedAt, NULL::VARCHAR AS soulType,
         NULL::VARCHAR AS contractLocation, seq AS _seq
  FROM commands
  UNION ALL
  SELECT 'SOUL#' || CAST(contract_id AS VARCHAR), 'LEDGER#' || sha256('ledger|' || CAST(seq AS VARCHAR)),
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, strftime(ts, {_ISO}), NULL, amount,
         'Financial transaction for contract update: ' || new_status, NULL, NULL, NULL, NULL, NULL, seq
  FROM commands)""") + """
SELECT * FROM (SELECT * FROM merged UNION ALL SELECT * FROM puts)
QUALIFY row_number() OVER (PARTITION BY PK, SK ORDER BY _seq DESC) = 1"""

# ------------------------------------------------------------------ remaining lookups
Q["lookup_ledger_by_date"] = with_binding() + """
SELECT * FROM ledger
WHERE transaction_time >= TIMESTAMP '1995-03-01 00:00:00' AND transaction_time < TIMESTAMP '1995-03-02 00:00:00'
ORDER BY transaction_time, id"""
Q["item_point_get"] = with_binding(_PICK, _ITEMS) + """
SELECT * FROM items WHERE PK = 'SOUL#' || CAST((SELECT id FROM pick) AS VARCHAR) AND SK = 'CONTRACT'"""
Q["normalize_contract"] = with_binding() + """
SELECT CAST(id AS VARCHAR) AS id, COALESCE(NULLIF(contract_status, ''), 'Unknown') AS status,
       NULLIF(soul_type, '') AS soulType, NULLIF(contract_location, '') AS contractLocation FROM contracts"""
Q["from_items_events"] = with_binding(_ITEMS) + """
SELECT SK AS id, substring(PK, 6) AS soul_contract_id,
       CAST(try_strptime(COALESCE(NULLIF("timestamp", ''), NULLIF(substring(SK, 7), '')), '%Y-%m-%dT%H:%M:%S.%gZ') AS TIMESTAMP)
         AS event_time,
       COALESCE(NULLIF("timestamp", ''), NULLIF(substring(SK, 7), '')) AS event_time_text,
       NULLIF(description, '') AS description
FROM items WHERE starts_with(SK, 'EVENT#')"""
Q["status_index"] = with_binding(_ITEMS) + """
SELECT status, SK, PK FROM items WHERE status IS NOT NULL AND SK IS NOT NULL"""

# ------------------------------------------------------------------ parity of the two shapes
_ITEM_LEDGER = """
item_ledger AS (SELECT substring(PK, 6) AS soul_contract_id,
                       COALESCE(NULLIF("timestamp", ''), NULLIF(substring(SK, 8), '')) AS time_text,
                       NULLIF(description, '') AS description, amount
                FROM items WHERE starts_with(SK, 'LEDGER#'))"""
Q["parity_ledger_items"] = with_binding(_ITEMS, _ITEM_LEDGER, _positional(
    "ledger entries", "item_ledger", "ledger", "time_text", _ISO_TX, True, "ipar")) + "SELECT * FROM ipar_issues"
Q["parity_contracts_items"] = with_binding(_ITEMS) + """
, pln AS (SELECT COALESCE(NULLIF(soulId, ''), substring(PK, 6)) AS id,
                 COALESCE(NULLIF(status, ''), NULLIF(contract_status, ''), 'Unknown') AS status,
                 NULLIF(soul_type, '') AS soulType, NULLIF(contract_location, '') AS contractLocation
          FROM items WHERE SK = 'CONTRACT'),
prn AS (SELECT CAST(id AS VARCHAR) AS id, COALESCE(NULLIF(contract_status, ''), 'Unknown') AS status,
               NULLIF(soul_type, '') AS soulType, NULLIF(contract_location, '') AS contractLocation FROM contracts),
all_ids AS (SELECT id FROM pln UNION SELECT id FROM prn),
pj AS (SELECT i.id, l.id IS NOT NULL AS hl, r.id IS NOT NULL AS hr, l.status AS ls, r.status AS rs,
              l.soulType AS lt, r.soulType AS rt, l.contractLocation AS ll, r.contractLocation AS rl
       FROM all_ids i LEFT JOIN pln l ON l.id = i.id LEFT JOIN prn r ON r.id = i.id)
SELECT id AS contract_id, 'contracts' AS scope,
       CASE WHEN NOT hl AND NOT hr THEN 'missing_both' WHEN NOT hl THEN 'missing_left' ELSE 'missing_right' END AS field,
       NULL::BIGINT AS idx, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value
FROM pj WHERE NOT hl OR NOT hr
UNION ALL SELECT id, 'contracts', 'status', NULL, ls, rs FROM pj WHERE hl AND hr AND ls IS DISTINCT FROM rs
UNION ALL SELECT id, 'contracts', 'soulType', NULL, lt, rt FROM pj WHERE hl AND hr AND lt IS DISTINCT FROM rt
UNION ALL SELECT id, 'contracts', 'contractLocation', NULL, ll, rl FROM pj WHERE hl AND hr AND ll IS DISTINCT FROM rl"""

# ------------------------------------------------------------------ streaming applier
# the stream over the same commands must end in exactly the batch bundle's state
Q["stream_commands_contracts"] = Q["apply_commands_contracts"]
Q["stream_commands_events"] = Q["apply_commands_events"]
Q["stream_commands_ledger"] = Q["apply_commands_ledger"]

# ------------------------------------------------------------------ item store after the handlers' writes
_ITEMS_AFTER = "items_after AS (" + Q["apply_commands_items"] + ")"
Q["from_items_after_commands_full"] = f"""
WITH {_ITEMS_AFTER}
SELECT COALESCE(NULLIF(soulId, ''), substring(PK, 6)) AS id,
       COALESCE(NULLIF(contract_status, ''), NULLIF(status, ''), 'Unknown') AS contract_status,
       COALESCE(NULLIF(soul_type, ''), NULLIF(soulType, '')) AS soul_type,
       COALESCE(NULLIF(contract_location, ''), NULLIF(contractLocation, '')) AS contract_location,
       CAST(try_strptime(COALESCE(NULLIF(updated_at, ''), NULLIF(updatedAt, ''), NULLIF(createdAt, '')),
                         '%Y-%m-%dT%H:%M:%S.%gZ') AS TIMESTAMP) AS updated_at
FROM items_after WHERE SK = 'CONTRACT'"""
Q["consistency_after_commands"] = f"""
WITH {_ITEMS_AFTER},
lic AS (SELECT substring(PK, 6) AS id, COALESCE(NULLIF(status, ''), NULLIF(contract_status, ''), 'Unknown') AS status
        FROM items_after WHERE SK = 'CONTRACT'),
ric AS (SELECT CAST(id AS VARCHAR) AS id, contract_status AS status FROM ({Q["apply_commands_contracts"]}))
SELECT NULL::VARCHAR AS contract_id, 'contracts' AS scope, 'count' AS field, NULL::BIGINT AS idx,
       CAST((SELECT COUNT(*) FROM lic) AS VARCHAR) AS left_value, CAST((SELECT COUNT(*) FROM ric) AS VARCHAR) AS right_value
WHERE (SELECT COUNT(*) FROM lic) <> (SELECT COUNT(*) FROM ric)
UNION ALL
SELECT l.id, 'contracts', 'missing_right', NULL, 'present', NULL FROM lic l
WHERE NOT EXISTS (SELECT 1 FROM ric r WHERE r.id = l.id)
UNION ALL
SELECT l.id, 'contracts', 'status', NULL, l.status, r.status FROM lic l JOIN ric r ON r.id = l.id
WHERE l.status IS DISTINCT FROM r.status"""

# ------------------------------------------------------------------ more compositions
Q["parity_report"] = with_binding(_PARITY_CONTRACTS, _LEDGER_PARITY, _positional(
    "events", "contract_events", "contract_events", _ISO_EV, _ISO_EV, False, "evpar")) + """
SELECT * FROM contract_issues UNION ALL SELECT * FROM evpar_issues UNION ALL SELECT * FROM lpar_issues"""
Q["stream_compacted_events"] = Q["apply_commands_events"]
Q["stream_compacted_ledger"] = Q["apply_commands_ledger"]

_SUMMARY_ALL = _summary("scenario, system", 4)
Q["summary_stats_all_systems"] = f"""
WITH groups AS (SELECT DISTINCT CAST(user_id % 5 AS VARCHAR) AS scenario, event_type AS system FROM events),
stats AS ({_SUMMARY_ALL})
SELECT g.scenario, g.system,
       CASE WHEN s.scenario IS NULL THEN 0 ELSE s.n END AS n,
       CASE WHEN s.scenario IS NULL THEN CAST(0 AS DECIMAL(18,4)) ELSE s.mean END AS mean,
       CASE WHEN s.scenario IS NULL THEN 0.0::DOUBLE ELSE s.min END AS min,
       CASE WHEN s.scenario IS NULL THEN 0.0::DOUBLE ELSE s.max END AS max,
       CASE WHEN s.scenario IS NULL THEN CAST(0 AS DECIMAL(18,4)) ELSE s.stddev END AS stddev,
       CASE WHEN s.scenario IS NULL THEN CAST(0 AS DECIMAL(18,4)) ELSE s.cv END AS cv,
       CASE WHEN s.scenario IS NULL THEN CAST(0 AS DECIMAL(18,4)) ELSE s.ci95 END AS ci95,
       CASE WHEN s.scenario IS NULL THEN 0.0::DOUBLE ELSE s.p50 END AS p50,
       CASE WHEN s.scenario IS NULL THEN 0.0::DOUBLE ELSE s.p95 END AS p95,
       CASE WHEN s.scenario IS NULL THEN 0.0::DOUBLE ELSE s.p99 END AS p99,
       CASE WHEN s.scenario IS NULL THEN 'Excellent' ELSE s.consistency END AS consistency,
       CASE WHEN s.scenario IS NULL THEN 'LOW' ELSE s.confidence END AS confidence
FROM groups g LEFT JOIN stats s ON s.scenario = g.scenario AND s.system = g.system"""
Q["items_by_date_bucket"] = with_binding(_ITEMS) + """
SELECT * FROM items WHERE GSI1PK = 'EVENT#2024-01-15' ORDER BY GSI1SK, PK, SK"""
Q["items_by_status"] = with_binding(_ITEMS) + """
SELECT * FROM items WHERE status IS NOT NULL AND SK IS NOT NULL AND status = 'Bound' ORDER BY SK, PK"""
Q["items_structure_sample"] = with_binding(_ITEMS) + "SELECT PK, SK FROM items ORDER BY PK, SK LIMIT 3"
Q["store_inventory"] = with_binding() + """
SELECT 'contracts' AS table_name, TRUE AS present, COUNT(*) AS row_count FROM contracts
UNION ALL SELECT 'events', TRUE, COUNT(*) FROM contract_events
UNION ALL SELECT 'ledger', TRUE, COUNT(*) FROM ledger"""

# ------------------------------------------------------------------ requests that repeat


def _twice(sql: str) -> str:
    """``sql`` over commands that all come twice, at two places of the log."""
    return sql.replace("commands AS (", "commands_once AS (", 1).replace("measurements AS (", """commands AS (
  SELECT contract_id, new_status, amount, ts, seq * 2 + again AS seq FROM commands_once, (VALUES (0), (1)) v(again)),
measurements AS (""", 1)


Q["requests_repeated_events"] = _twice(Q["apply_commands_events"])
Q["requests_repeated_ledger"] = _twice(Q["apply_commands_ledger"])
Q["requests_repeated_items"] = _twice(Q["apply_commands_items"])
Q["stream_repeated_events"] = _twice(Q["apply_commands_events"])

# ------------------------------------------------------------------ text ids
Q["stream_text_ids_contracts"] = f"""
SELECT printf('soul_%09d', id) AS id, contract_status, soul_type, contract_location, updated_at
FROM ({Q["apply_commands_contracts"]})"""
Q["stream_text_ids_ledger"] = f"""
SELECT id, printf('soul_%09d', soul_contract_id) AS soul_contract_id, amount, transaction_time, description
FROM ({Q["apply_commands_ledger"]})"""

# ------------------------------------------------------------------ item forms
_ITEM_TYPES = {c: "VARCHAR" for c in (
    "PK", "SK", "soulId", "status", "contract_status", "soul_type", "contract_location", "createdAt", "updated_at", "eventType",
    '"timestamp"', "event_time", "transaction_time", "transaction_type", "amount", "description", "GSI1PK", "GSI1SK", "updatedAt",
    "soulType", "contractLocation", "_seq")} | {"amount": "DECIMAL(18,6)", "_seq": "BIGINT"}


def _item(**given: str) -> str:
    """Select list of an item: the given attributes, NULL for the others."""
    given = {('"timestamp"' if k == "timestamp" else k): v for k, v in given.items()}
    return ", ".join(f"{given[c]} AS {c}" if c in given else f"NULL::{t} AS {c}" for c, t in _ITEM_TYPES.items())


def _put_bundle(puts: str, **sets: str) -> str:
    """The item store after an update of contract items (``sets``: columns of latest) and puts that replace."""
    merged = ", ".join({"PK": "COALESCE(i.PK, u.PK)", "SK": "COALESCE(i.SK, 'CONTRACT')", "_seq": "COALESCE(i._seq, 0)"}.get(
        c, f"CASE WHEN u.PK IS NOT NULL THEN u.{c} ELSE i.{c} END" if c in sets else f"i.{c}") + f" AS {c}" for c in _ITEM_TYPES)
    upd = ", ".join(f"{v} AS {c}" for c, v in sets.items())
    return with_binding(_ITEMS, _LATEST, f"""
upd AS (SELECT 'SOUL#' || CAST(contract_id AS VARCHAR) AS PK, {upd} FROM latest),
all_puts AS ({puts}),
puts AS (SELECT * FROM all_puts QUALIFY row_number() OVER (PARTITION BY PK, SK ORDER BY _seq DESC) = 1),
kept AS (SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM puts p WHERE p.PK = i.PK AND p.SK = i.SK))""") + f"""
SELECT {merged} FROM kept i FULL JOIN upd u ON i.SK = 'CONTRACT' AND i.PK = u.PK
UNION ALL SELECT * FROM puts"""


_CMD_PK, _CMD_TS = "'SOUL#' || CAST(contract_id AS VARCHAR)", f"strftime(ts, {_ISO})"
Q["apply_demo_items"] = _put_bundle(
    "SELECT " + _item(PK=_CMD_PK, SK=f"'EVENT#' || {_CMD_TS}", timestamp=_CMD_TS, description="'Contract updated to ''' || new_status || ''''",
                      _seq="seq") + " FROM commands UNION ALL SELECT "
    + _item(PK=_CMD_PK, SK=f"'LEDGER#' || {_CMD_TS}", timestamp=_CMD_TS, amount="amount", transaction_type="'redemption'", _seq="seq")
    + " FROM commands", status="new_status", updated_at=_CMD_TS)
Q["apply_touches_items"] = _put_bundle(
    "SELECT " + _item(PK=_CMD_PK, SK=f"'EVENT#' || {_CMD_TS}", timestamp=_CMD_TS, description="'Benchmark event ' || CAST(seq AS VARCHAR)",
                      _seq="seq") + " FROM commands", updated_at=_CMD_TS)
Q["audit_latest_items"] = with_binding(_ITEMS, """
le AS (SELECT PK, SK, description FROM items WHERE starts_with(SK, 'EVENT#')
       QUALIFY row_number() OVER (PARTITION BY PK ORDER BY SK DESC) = 1),
ll AS (SELECT PK, SK, amount FROM items WHERE starts_with(SK, 'LEDGER#')
       QUALIFY row_number() OVER (PARTITION BY PK ORDER BY SK DESC) = 1)""") + """
SELECT substring(i.PK, 6) AS id, COALESCE(NULLIF(i.status, ''), NULLIF(i.contract_status, '')) AS status,
       COALESCE(NULLIF(i.updated_at, ''), NULLIF(i.updatedAt, ''), NULLIF(i.createdAt, '')) AS updated_at,
       le.SK AS last_event, le.description AS last_event_text, ll.SK AS last_ledger, ll.amount AS last_amount
FROM items i LEFT JOIN le ON le.PK = i.PK LEFT JOIN ll ON ll.PK = i.PK WHERE i.SK = 'CONTRACT'"""
Q["location_dashboard_items_listed"] = Q["location_dashboard_items"].replace(
    "status IS NOT NULL AND SK = 'CONTRACT')",
    "status IS NOT NULL AND SK = 'CONTRACT' AND contract_location IN ('NATION_1', 'NATION_7', 'NATION_12', 'Hell_Gate'))")

# ------------------------------------------------------------------ parity of requested ids, events that differ
Q["parity_requested_ids"] = with_binding(_PARITY_CONTRACTS.replace(
    "all_ids AS (SELECT id FROM pln UNION SELECT id FROM prn)",
    "all_ids AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part)")) + "SELECT * FROM contract_issues"
Q["parity_events_drifted"] = with_binding("""
drifted AS (SELECT id, soul_contract_id, event_time, CASE WHEN id % 53 = 0 THEN 'changed' ELSE description END AS description
            FROM contract_events WHERE id % 50 <> 0)""",
    _positional("events", "contract_events", "drifted", _ISO_EV, _ISO_EV, False, "dpar")) + "SELECT * FROM dpar_issues"

# ------------------------------------------------------------------ rejections
Q["validate_commands_reasons"] = """
WITH b AS (SELECT event_id AS i, event_id % 9 AS k, '{"soulContractId": ' AS a, ', "newStatus": "Bound", ' AS s FROM events)
SELECT CASE k WHEN 1 THEN '' WHEN 2 THEN '{bad ' || i WHEN 3 THEN a || i || s || '"note": 1}'
              WHEN 4 THEN a || i || s || '"amount": "5"}' WHEN 5 THEN a || i || s || '"amount": 5000000000000}'
              WHEN 6 THEN a || i || s || '"amount": 5, "seq": -1}' WHEN 7 THEN a || '"soul_' || i || '"' || s || '"amount": 5}' END AS value,
       CASE k WHEN 0 THEN 'Missing request body' WHEN 1 THEN 'Missing request body' WHEN 2 THEN 'Invalid JSON'
              WHEN 5 THEN 'Amount out of range' WHEN 6 THEN 'Invalid seq' WHEN 7 THEN 'Invalid contract id'
              ELSE 'Missing soulContractId, newStatus, or amount' END AS reason
FROM b WHERE k <> 8"""
Q["rejected_items"] = with_binding() + f"""
SELECT CASE WHEN id % 103 <> 0 THEN 'SOUL#' || CAST(soul_contract_id AS VARCHAR) END AS PK,
       CASE WHEN id % 101 <> 0 THEN 'EVENT#' || strftime(event_time, {_ISO}) END AS SK, description, id AS _seq,
       CASE WHEN id % 103 = 0 THEN 'no partition key (null contract id)' ELSE 'no sort key (null time)' END AS reason
FROM contract_events WHERE id % 103 = 0 OR id % 101 = 0"""

# ------------------------------------------------------------------ ranks and running totals over many groups
Q["contract_activity_ranks"] = with_binding() + """
, n AS (SELECT c.id, COUNT(l.id) AS entries FROM contracts c LEFT JOIN ledger l ON l.soul_contract_id = c.id GROUP BY c.id)
SELECT id, entries, CAST(rank() OVER (ORDER BY entries DESC) AS BIGINT) AS activity_rank,
       CAST(dense_rank() OVER (ORDER BY entries DESC) AS BIGINT) AS activity_dense_rank FROM n"""
Q["ledger_running_totals"] = with_binding() + """
, d AS (SELECT CAST(transaction_time AS DATE) AS contract_date, soul_contract_id, CAST(SUM(amount) AS DECIMAL(38,6)) AS daily_total
        FROM ledger GROUP BY ALL)
SELECT contract_date, soul_contract_id, daily_total,
       CAST(SUM(daily_total) OVER (ORDER BY contract_date NULLS FIRST, soul_contract_id NULLS FIRST
                                   ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,6)) AS running_total FROM d"""

# ------------------------------------------------------------------ other forms
Q["profile_multiset"] = with_binding() + """
, fan AS (SELECT c.id, e.description AS event, l.amount FROM contracts c
          LEFT JOIN contract_events e ON e.soul_contract_id = c.id LEFT JOIN ledger l ON l.soul_contract_id = c.id),
power AS (SELECT id, CAST(SUM(amount) AS DECIMAL(38,6)) AS total_power FROM fan GROUP BY id)
SELECT id, event, COUNT(*) AS times, MIN(total_power) AS total_power FROM fan JOIN power USING (id) GROUP BY id, event"""
Q["summary_stats_sorted"] = Q["summary_stats"]
Q["parity_ledger_blocks"] = Q["parity_ledger"]
_EXPECTED = """
WITH inv AS (SELECT 'customer' AS table_name, TRUE AS present, (SELECT COUNT(*) FROM customer) AS row_count
  UNION ALL SELECT 'orders', TRUE, (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'events', TRUE, (SELECT COUNT(*) FROM events)
  UNION ALL SELECT 'souls', FALSE, NULL)
"""
Q["missing_tables"] = _EXPECTED + "SELECT table_name FROM inv WHERE NOT present"
Q["readiness_partial"] = _EXPECTED + """
SELECT COUNT(*) AS expected, COUNT(CASE WHEN present THEN 1 END) AS present, CAST(SUM(COALESCE(row_count, 0)) AS BIGINT) AS total_rows,
       COUNT(CASE WHEN present THEN 1 END) IN (0, COUNT(*)) AS ready FROM inv"""
Q["first_seen_ids"] = with_binding() + """
, f AS (SELECT soul_contract_id AS id, MIN(id) AS first FROM contract_events WHERE soul_contract_id IS NOT NULL GROUP BY soul_contract_id)
SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS pos, id FROM f"""
Q["write_chunked"] = with_binding() + "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS files_above_bound FROM ledger"
Q["write_targets"] = with_binding(_ITEMS, """
counts AS (SELECT 'contracts' AS table_name, COUNT(*) AS n FROM contracts UNION ALL SELECT 'items', COUNT(*) FROM items),
cases AS (SELECT * FROM (VALUES ('all', TRUE, TRUE), ('items_only', FALSE, TRUE), ('normalized', TRUE, FALSE), ('last_wins', FALSE, TRUE),
                                ('skipped', FALSE, FALSE)) v(switches, tables, store))""") + """
SELECT switches, table_name, CASE WHEN (table_name = 'items' AND store) OR (table_name = 'contracts' AND tables) THEN n END AS row_count
FROM cases, counts"""
Q["stream_state_contracts"] = Q["apply_commands_contracts"]
