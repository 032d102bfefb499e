"""Entity profiles and the post-write audit.

"Latest per contract" is an aggregate (min over a composite sort key), not a
window: partial aggregation keeps a hot contract from landing in one task.
Because the winning row carries text (the description), Spark runs it as a
sort-based aggregate (partial in every map task, then final), which spills
gracefully; fetching the text by a join back to the winning row would shuffle
every event again instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.functions.exprs import SUM_MONEY, latest_first_key
from covenant.operators.lookups import batch_get
from covenant.sources.binding import Tables


def _restrict(t: Tables, ids) -> Tables:
    if ids is None:
        return t
    return Tables(batch_get(t.contracts, ids, "id"),
                  batch_get(t.events, ids, "soul_contract_id"),
                  batch_get(t.ledger, ids, "soul_contract_id"))


def profile_joined(t: Tables, ids) -> DataFrame:
    """Contract row + array_agg(event description) + sum(amount) over the
    contracts LEFT events LEFT ledger fan-out, without building the fan-out.

    ``ids`` is required: the result holds a contract's whole event list in one
    row, so it is a per-contract lookup (as in the original), not a table scan
    output; use ``profile_full`` (flat) for every contract.

    With E events and L ledger rows: each description appears max(L,1) times,
    a contract without events gets max(L,1) NULLs, total_power = sum * max(E,1)
    (NULL without ledger rows). NULL descriptions are kept (a struct wrapper
    stops collect_list from dropping them).
    """
    if ids is None:
        raise ValueError("profile_joined needs ids; use profile_full(...) for all contracts")
    t = _restrict(t, ids)
    ev = (t.events.groupBy(F.col("soul_contract_id").alias("e_cid"))
          .agg(F.transform(F.collect_list(F.struct(F.col("description").alias("d"))),
                           lambda s: s["d"]).alias("descs"),
               F.count(F.lit(1)).alias("n_e")))
    lg = (t.ledger.groupBy(F.col("soul_contract_id").alias("l_cid"))
          .agg(F.count(F.lit(1)).alias("n_l"), F.sum("amount").cast(SUM_MONEY).alias("s_l")))
    c = t.contracts
    j = c.join(ev, c.id == ev.e_cid, "left").join(lg, c.id == lg.l_cid, "left")
    l_mult = F.greatest(F.coalesce("n_l", F.lit(0)), F.lit(1)).cast("int")
    e_mult = F.greatest(F.coalesce("n_e", F.lit(0)), F.lit(1))
    events = F.when(F.col("descs").isNull(), F.array_repeat(F.lit(None).cast("string"), l_mult)) \
        .otherwise(F.flatten(F.transform("descs", lambda d: F.array_repeat(d, l_mult))))
    return j.select(*[F.col(x) for x in c.columns],
                    events.alias("events"),
                    (F.col("s_l") * e_mult).cast(SUM_MONEY).alias("total_power"))


def profile_multiset(t: Tables, ids=None) -> DataFrame:
    """A7 as a multiset, for some or all contracts: one row per contract and different event text with the number of times
    it stands in the fan-out (its events times max(L, 1); a contract without events has the text NULL max(L, 1) times), and
    the contract's ``total_power`` as in ``profile_joined``.

    No row holds a contract's event list: texts are counted before the join, so a contract with 10^6 events is as many
    rows as it has different texts, and the ledger is one row per contract.
    """
    t = _restrict(t, ids)
    ev = t.events.groupBy(F.col("soul_contract_id").alias("e_cid"), F.col("description").alias("event")).agg(F.count(F.lit(1)).alias("n_d"))
    n_e = t.events.groupBy(F.col("soul_contract_id").alias("n_cid")).agg(F.count(F.lit(1)).alias("n_e"))
    lg = (t.ledger.groupBy(F.col("soul_contract_id").alias("l_cid"))
          .agg(F.count(F.lit(1)).alias("n_l"), F.sum("amount").cast(SUM_MONEY).alias("s_l")))
    per = t.contracts.select("id").join(n_e, F.col("id") == F.col("n_cid"), "left").join(lg, F.col("id") == F.col("l_cid"), "left").select(
        "id", F.greatest(F.coalesce("n_l", F.lit(0)), F.lit(1)).alias("l_mult"),
        (F.col("s_l") * F.greatest(F.coalesce("n_e", F.lit(0)), F.lit(1))).cast(SUM_MONEY).alias("total_power"))
    return per.join(ev, F.col("id") == F.col("e_cid"), "left").select(
        "id", "event", (F.coalesce("n_d", F.lit(1)) * F.col("l_mult")).cast("long").alias("times"), "total_power")


def events_text(arr) -> F.Column:
    """Order-free text form of an array (sorted, NULLs as 'NULL') for comparisons."""
    return F.array_join(F.array_sort(F.col(arr)), "|", "NULL")


def profile_full(t: Tables, ids=None, nested: bool = False) -> DataFrame:
    """Contract + its events by time + its ledger rows by time.

    Flat form (default): one row per contract, event and ledger row with a
    ``kind`` column; 1 + E + L rows per contract, for some or all contracts.
    ``nested=True`` gives one row per contract with time-sorted arrays; it holds
    a whole contract in one row, so it needs ``ids``.
    """
    if nested and ids is None:
        raise ValueError("the nested profile needs ids; the flat form serves all contracts")
    t = _restrict(t, ids)
    c = t.contracts.select(
        F.col("id").alias("contract_id"), F.lit("contract").alias("kind"), F.lit(0).alias("kind_order"),
        F.col("updated_at").alias("time"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast(SUM_MONEY).alias("amount"), "contract_status", "soul_type", "contract_location")
    e = t.events.select(
        F.col("soul_contract_id").alias("contract_id"), F.lit("event").alias("kind"), F.lit(1).alias("kind_order"),
        F.col("event_time").alias("time"), "description", F.lit(None).cast(SUM_MONEY).alias("amount"),
        *[F.lit(None).cast("string").alias(x) for x in ("contract_status", "soul_type", "contract_location")])
    lg = t.ledger.select(
        F.col("soul_contract_id").alias("contract_id"), F.lit("ledger").alias("kind"), F.lit(2).alias("kind_order"),
        F.col("transaction_time").alias("time"), "description", F.col("amount").cast(SUM_MONEY).alias("amount"),
        *[F.lit(None).cast("string").alias(x) for x in ("contract_status", "soul_type", "contract_location")])
    flat = c.unionByName(e).unionByName(lg)
    if not nested:
        return flat.orderBy("contract_id", "kind_order", F.asc_nulls_last("time")).drop("kind_order")
    rows = flat.where(F.col("kind") != "contract")
    # ascending time with NULL times last (the flat form's and SQL's order)
    item = F.struct("kind_order", F.col("time").isNull().alias("t_null"), "time", "description", "amount")
    arr = rows.groupBy("contract_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    head = flat.where(F.col("kind") == "contract").drop("kind", "kind_order", "time", "description", "amount")

    def part(k):
        return F.transform(F.filter("items", lambda s: s["kind_order"] == k),
                           lambda s: F.struct(s["time"].alias("time"), s["description"].alias("description"),
                                              s["amount"].alias("amount")))
    return (head.join(arr, "contract_id", "left")
            .select(*head.columns, part(1).alias("events"), part(2).alias("ledger")))


def latest_event(events: DataFrame) -> DataFrame:
    """Per contract the latest event (NULL time first, then newest, then lowest id)."""
    k = latest_first_key("event_time", "id")
    return (events.groupBy(F.col("soul_contract_id").alias("e_cid"))
            .agg(F.min(F.struct(k.alias("k"), F.col("description"), F.col("event_time"))).alias("m"))
            .select("e_cid", F.col("m.description").alias("last_event"),
                    F.col("m.event_time").alias("last_event_time")))


def latest_ledger(ledger: DataFrame) -> DataFrame:
    """Per contract the latest ledger row (NULL time first, then newest, then lowest id)."""
    k = latest_first_key("transaction_time", "id")
    return (ledger.groupBy(F.col("soul_contract_id").alias("l_cid"))
            .agg(F.min(F.struct(k.alias("k"), F.col("amount"), F.col("transaction_time"))).alias("m"))
            .select("l_cid", F.col("m.amount").alias("last_amount"),
                    F.col("m.transaction_time").alias("last_amount_time")))


def audit_latest(t: Tables, ids=None) -> DataFrame:
    """Contract status/time + its latest event + its latest ledger row (LEFT)."""
    t = _restrict(t, ids)
    c = t.contracts.select("id", "contract_status", "updated_at")
    return (c.join(latest_event(t.events), c.id == F.col("e_cid"), "left")
            .join(latest_ledger(t.ledger), c.id == F.col("l_cid"), "left")
            .select("id", "contract_status", "updated_at", "last_event", "last_event_time",
                    "last_amount", "last_amount_time"))


def audit_latest_items(items: DataFrame) -> DataFrame:
    """M12, item form: per contract item its status and update time, the event and the ledger item of greatest sort key.

    One aggregation per kind over the items' own columns; a contract without events or ledger items has nulls there.
    """
    from covenant.functions.exprs import first_truthy, strip_prefix
    from covenant.sources.items import CONTRACT_SK, EVENT_PREFIX, LEDGER_PREFIX, PK_PREFIX

    def latest(prefix: str, value: str, key: str, name: str) -> DataFrame:
        return (items.where(F.col("SK").startswith(prefix)).groupBy(F.col("PK").alias(f"{key}_pk"))
                .agg(F.max("SK").alias(key), F.max_by(value, "SK").alias(name)))

    e, lg = latest(EVENT_PREFIX, "description", "last_event", "last_event_text"), latest(LEDGER_PREFIX, "amount", "last_ledger", "last_amount")
    c = items.where(F.col("SK") == CONTRACT_SK)
    return (c.join(e, c.PK == F.col("last_event_pk"), "left").join(lg, c.PK == F.col("last_ledger_pk"), "left")
            .select(strip_prefix("PK", PK_PREFIX).alias("id"), first_truthy("status", "contract_status").alias("status"),
                    first_truthy("updated_at", "updatedAt", "createdAt").alias("updated_at"),
                    "last_event", "last_event_text", "last_ledger", "last_amount"))
