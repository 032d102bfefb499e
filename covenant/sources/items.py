"""The key-value *item* shape of the store: one wide nullable table keyed (PK, SK).

M1 to_items, M2 put_items, M3 from_items and the item lookups S2-S4, S6.
Item kinds are routed by the SK prefix: ``CONTRACT``, ``EVENT#...``, ``LEDGER#...``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.functions.exprs import falsy_null, first_truthy, iso_ms, parse_iso, strip_prefix
from covenant.sources.binding import Tables
from covenant.sources.schemas import ITEMS, MONEY

# ---- fixed values of the item layout ----
PK_PREFIX = "SOUL#"
CONTRACT_SK = "CONTRACT"
EVENT_PREFIX = "EVENT#"
LEDGER_PREFIX = "LEDGER#"
STATUS_PREFIX = "STATUS#"
UNKNOWN_STATUS = "Unknown"

ITEM_COLUMNS = [f.name for f in ITEMS.fields]


def _pk(id_col) -> F.Column:
    return F.concat(F.lit(PK_PREFIX), F.col(id_col).cast("string"))


def _conform(df: DataFrame, extra=("_seq",)) -> DataFrame:
    """Add every missing item attribute as a typed NULL, in schema order."""
    cols = []
    for f in ITEMS.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    cols += [F.col(c) for c in extra if c in df.columns]
    return df.select(*cols)


def to_items(t: Tables) -> DataFrame:
    """M1: the three relations as items (PK, SK, attributes, GSI1PK, GSI1SK) plus a
    write sequence ``_seq`` (source row id) used by ``put_items``."""
    c = t.contracts
    created = iso_ms("updated_at")
    contracts = c.select(
        _pk("id").alias("PK"), F.lit(CONTRACT_SK).alias("SK"),
        F.col("id").cast("string").alias("soulId"),
        F.col("contract_status").alias("status"),
        "soul_type", "contract_location",
        created.alias("createdAt"),
        F.concat(F.lit(STATUS_PREFIX), F.col("contract_status")).alias("GSI1PK"),
        created.alias("GSI1SK"),
        F.lit(0).cast("long").alias("_seq"))
    e = t.events
    ets = iso_ms("event_time")
    events = e.select(
        _pk("soul_contract_id").alias("PK"), F.concat(F.lit(EVENT_PREFIX), ets).alias("SK"),
        F.regexp_replace("description", " ", "_").alias("eventType"),
        ets.alias("timestamp"), "description",
        F.concat(F.lit(EVENT_PREFIX), F.substring(ets, 1, 10)).alias("GSI1PK"),
        ets.alias("GSI1SK"),
        F.col("id").cast("long").alias("_seq"))
    lg = t.ledger
    lts = iso_ms("transaction_time")
    ledger = lg.select(
        _pk("soul_contract_id").alias("PK"), F.concat(F.lit(LEDGER_PREFIX), lts).alias("SK"),
        "amount", lts.alias("timestamp"), "description",
        F.concat(F.lit(LEDGER_PREFIX), F.substring(lts, 1, 10)).alias("GSI1PK"),
        lts.alias("GSI1SK"),
        F.col("id").cast("long").alias("_seq"))
    u = contracts.unionByName(events, allowMissingColumns=True).unionByName(ledger, allowMissingColumns=True)
    return _conform(u)


def put_items(items: DataFrame, new: DataFrame | None = None, seq_col: str = "_seq", whole: bool = False) -> DataFrame:
    """M2: key-value put semantics. Rows are writes; for each (PK, SK) the write with
    the highest ``seq_col`` wins (a later put replaces the whole item).

    ``seq_col`` identifies a write: two rows with the same (PK, SK, seq) must be
    the same write (a replay). Each attribute is its own ``max_by`` over that
    sequence, so every attribute comes from the winning write, Catalyst prunes
    the attributes a query does not use before the shuffle, and partial
    aggregation collapses a key written a billion times to one row per map task.
    ``whole``: for a caller that uses every attribute. All of them are one value then,
    and a row carries the sequence once, not once for each attribute.

    Writes without a key have no place in the store: ``rejected_items`` returns them.
    """
    w = items if new is None else items.unionByName(new, allowMissingColumns=True)
    w = w.where(F.col("PK").isNotNull() & F.col("SK").isNotNull())
    attrs = [c for c in w.columns if c not in ("PK", "SK")]
    # a write without a sequence number counts as the oldest one
    order = F.coalesce(F.col(seq_col).cast("long"), F.lit(-(1 << 63)))
    if whole:
        last = w.groupBy("PK", "SK").agg(F.max_by(F.struct(*attrs), order).alias("_item"))
        return last.select("PK", "SK", *[F.col("_item").getField(c).alias(c) for c in attrs])
    return (w.withColumn("_order", order)
            .groupBy("PK", "SK")
            .agg(*[F.max_by(F.col(c), F.col("_order")).alias(c) for c in attrs]))


REASON_NO_PK = "no partition key (null contract id)"
REASON_NO_SK = "no sort key (null time)"


def rejected_items(items: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """The writes that ``put_items`` does not store, whole and with a ``reason``: those whose PK or SK is null."""
    w = items if new is None else items.unionByName(new, allowMissingColumns=True)
    reason = F.when(F.col("PK").isNull(), F.lit(REASON_NO_PK)).when(F.col("SK").isNull(), F.lit(REASON_NO_SK))
    return w.withColumn("reason", reason).where(F.col("reason").isNotNull())


def item_kind(sk="SK") -> F.Column:
    """Item kind from the SK prefix: contract, event or ledger (NULL otherwise)."""
    s = F.col(sk)
    return (F.when(s == CONTRACT_SK, F.lit("contract"))
            .when(s.startswith(EVENT_PREFIX), F.lit("event"))
            .when(s.startswith(LEDGER_PREFIX), F.lit("ledger")))


def from_items(items: DataFrame, mode: str = "compat") -> Tables:
    """M3: items -> (contracts, events, ledger) with the readers' attribute fallbacks.

    ``compat`` reproduces the reference readers exactly (``status`` before
    ``contract_status``; ``updatedAt``/``createdAt`` only; event/ledger time from
    ``timestamp`` else the SK suffix). ``full`` also honours the attributes the
    command handler writes (``contract_status``, ``updated_at``, ``event_time``,
    ``transaction_time``), newest spelling first.
    Ids stay text (the item store is untyped); times are parsed to TIMESTAMP_NTZ.
    """
    k = items.withColumn("_kind", item_kind())
    cid = strip_prefix("PK", PK_PREFIX)
    if mode == "full":
        status = first_truthy("contract_status", "status")
        updated = first_truthy("updated_at", "updatedAt", "createdAt")
        ev_time = first_truthy("event_time", "timestamp")
        lg_time = first_truthy("transaction_time", "timestamp")
    else:
        status = first_truthy("status", "contract_status")
        updated = first_truthy("updatedAt", "createdAt")
        ev_time = first_truthy("timestamp")
        lg_time = first_truthy("timestamp")
    contracts = k.where(F.col("_kind") == "contract").select(
        F.coalesce(first_truthy("soulId"), cid).alias("id"),
        F.coalesce(status, F.lit(UNKNOWN_STATUS)).alias("contract_status"),
        first_truthy("soul_type", "soulType").alias("soul_type"),
        first_truthy("contract_location", "contractLocation").alias("contract_location"),
        parse_iso(updated).alias("updated_at"),
    )
    ev_ts = F.coalesce(ev_time, falsy_null(strip_prefix("SK", EVENT_PREFIX)))
    events = k.where(F.col("_kind") == "event").select(
        F.col("SK").alias("id"), cid.alias("soul_contract_id"),
        parse_iso(ev_ts).alias("event_time"),
        ev_ts.alias("event_time_text"),
        first_truthy("description").alias("description"),
    )
    lg_ts = F.coalesce(lg_time, falsy_null(strip_prefix("SK", LEDGER_PREFIX)))
    ledger = k.where(F.col("_kind") == "ledger").select(
        F.col("SK").alias("id"), cid.alias("soul_contract_id"),
        F.col("amount").cast(MONEY).alias("amount"),
        parse_iso(lg_ts).alias("transaction_time"),
        lg_ts.alias("transaction_time_text"),
        first_truthy("description").alias("description"),
    )
    return Tables(contracts, events, ledger)


# ---------------------------------------------------------------- item lookups
def items_contracts(items: DataFrame) -> DataFrame:
    """All contract items as (id, status) with the status fallback."""
    return items.where(F.col("SK") == CONTRACT_SK).select(
        strip_prefix("PK", PK_PREFIX).alias("id"),
        F.coalesce(first_truthy("status", "contract_status"), F.lit(UNKNOWN_STATUS)).alias("status"))


def item_collection(items: DataFrame, contract_id) -> DataFrame:
    """S3: all items of one partition key, ascending by SK (pushed-down equality)."""
    pk = F.lit(PK_PREFIX + str(contract_id))
    return items.where(F.col("PK") == pk).orderBy("SK")


def items_by_prefix(items: DataFrame, contract_id, prefix: str) -> DataFrame:
    """PK equality and SK begins-with (pushed as StringStartsWith)."""
    pk = F.lit(PK_PREFIX + str(contract_id))
    return items.where((F.col("PK") == pk) & F.col("SK").startswith(prefix)).orderBy("SK")


def location_index(items: DataFrame) -> DataFrame:
    """Sparse secondary index (contract_location, status): only items owning both keys."""
    return items.where(F.col("contract_location").isNotNull() & F.col("status").isNotNull())


def lookup_location(items: DataFrame, location: str) -> DataFrame:
    """Index query by location, sorted by the index sort key (status)."""
    return (location_index(items).where(F.col("contract_location") == location)
            .orderBy("status", "PK", "SK"))


def status_index(items: DataFrame) -> DataFrame:
    """Sparse index (status, SK)."""
    return items.where(F.col("status").isNotNull() & F.col("SK").isNotNull())


def items_by_date_bucket(items: DataFrame, kind_prefix: str, day: str) -> DataFrame:
    """S7 (item form): the date-bucket read pattern, items whose GSI1PK is
    ``<EVENT#|LEDGER#><yyyy-mm-dd>``, ordered by the bucket's sort key."""
    return items.where(F.col("GSI1PK") == F.lit(kind_prefix + day)).orderBy("GSI1SK", "PK", "SK")


def items_by_status(items: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """S5 (item form): status-index query; the index sort key is SK, constant
    for contracts, so ties are ordered by PK."""
    df = status_index(items).where(F.col("status") == status).orderBy("SK", "PK")
    return df.limit(limit) if limit is not None else df
