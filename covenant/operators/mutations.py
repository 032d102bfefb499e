"""Writes as pure functions: command validation, upserts and the write bundle
(M4-M9). Parquet has no UPDATE/MERGE; a mutation returns the new state as a
DataFrame and ``covenant.sources.store`` publishes it.

"Latest command per contract" is a ``max_by`` aggregate (partial aggregation,
skew-safe); the bundle's new rows are a projection of the commands (no joins).

A request is identified by its place in its source (``covenant.sources.commands``),
never by its body: ``seq`` of a command is that place as a number, and the ids of
the rows a command creates follow from it. Repeated bodies, and clients that
repeat a ``seq`` of their own, are requests of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.functions.exprs import iso_ms, parse_iso
from covenant.operators.keyset import fresh_rows, rows_without
from covenant.plans.sizing import BROADCAST_BYTES, broadcast_within, plan_bytes
from covenant.sources.binding import Tables
from covenant.sources.commands import MAX_SEQ, ORIGIN, with_places
from covenant.sources.schemas import MONEY

# ---- fixed values: texts and rejection reasons of the command handlers ----
EVENT_TEXT = "Contract updated to '{status}'"
LEDGER_TEXT = "Financial transaction: {status}"
ITEM_LEDGER_TEXT = "Financial transaction for contract update: {status}"
TOUCH_TEXT = "Benchmark event {i}"
DEMO_TRANSACTION = "redemption"
REASON_NO_BODY = "Missing request body"
REASON_BAD_JSON = "Invalid JSON"
REASON_STRICT = "Missing soulContractId, newStatus, or amount"
REASON_LENIENT = "Missing soulId, newStatus, or amount in request"
REASON_AMOUNT = "Amount out of range"
REASON_SEQ = "Invalid seq"
REASON_ID = "Invalid contract id"
NUMERIC_JSON = ("BIGINT", "DOUBLE", "DECIMAL", "INT", "FLOAT")


def _template(template: str, **cols: Column) -> Column:
    """Fill a ``{name}`` text template with columns (concat of literal pieces)."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name].cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


# ---------------------------------------------------------------- M9
def _parse_ts(text: Column) -> Column:
    """Body time: ISO ms text with Z (the item format), else any zone-less
    timestamp text (microseconds kept), read as a wall-clock TIMESTAMP_NTZ. Text
    without a final Z is not tried as the former: failing costs more than all else."""
    return F.coalesce(F.when(F.upper(text).endswith("Z"), parse_iso(text)), text.try_cast("timestamp_ntz"))


def _is_number(kind: Column) -> Column:
    return kind.startswith("DECIMAL") | kind.isin(*NUMERIC_JSON)


def _falsy_json(v: str) -> Column:
    """JS falsiness of the JSON value in the columns of ``_json_value(v)``: absent, null, '', 0, false."""
    value, kind, text, number = (F.col(v + part) for part in ("", "_kind", "_text", "_number"))
    return (value.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == ""))
            | ((kind == "BOOLEAN") & (text == "false"))
            | _is_number(kind) & (number == 0))


def _json_value(v: str) -> list[Column]:
    """What the checks ask of a JSON value in column ``v``: its kind, its text, its number."""
    value = F.col(v)
    return [F.schema_of_variant(value).alias(f"{v}_kind"), F.try_variant_get(value, "$", "string").alias(f"{v}_text"),
            F.try_variant_get(value, "$", "double").alias(f"{v}_number")]


def check_commands(raw: DataFrame, amount: str = "strict", now: str | None = None, cid_type: str | None = None,
                   source: str = "") -> DataFrame:
    """The requests of ``raw`` with a column ``reason`` (null: valid), the columns of a command and the body (``value``) of a
    rejected one: ``validate_commands`` before it splits them. For callers that keep the checked batch and use both parts.

    A body is parsed once. Every step is a projection of what the step before computed, and the last one a generator of one
    row: Spark moves a filter on the reason below a projection and writes out there, for each time that it is named, what
    the projection computed, but not below a generator.
    """
    if "seq" not in raw.columns and set(ORIGIN) <= set(raw.columns):
        raw = with_places(raw)
    id_key = "soulContractId" if amount == "strict" else "soulId"
    placed = "seq" in raw.columns        # and fit for a streaming plan, which numbers no rows
    parsed = raw.select(
        "value", (F.col("ts") if "ts" in raw.columns else F.lit(None).cast("timestamp_ntz")).alias("_ts"),
        (F.col("seq") if placed else F.lit(None).cast("long")).alias("_seq"),
        (F.lit(0).cast("long") if placed else F.monotonically_increasing_id()).alias("_place"),
        F.try_parse_json("value").alias("_v"))
    get = lambda key, kind: F.try_variant_get("_v", f"$.{key}", kind)
    fields = parsed.select(
        "value", "_ts", "_seq", "_place", F.col("_v").isNull().alias("_bad_json"),
        F.schema_of_variant("_v").startswith("OBJECT").alias("_is_object"),
        get(id_key, "variant").alias("_id"), get("newStatus", "variant").alias("_status"), get("amount", "variant").alias("_amount"),
        get("seq", "variant").alias("_own"), get("ts", "string").alias("_ts_text"))
    values = fields.select(
        "*", *_json_value("_id"), *_json_value("_status"), F.schema_of_variant("_amount").alias("_amount_kind"),
        F.try_variant_get("_amount", "$", MONEY.simpleString()).alias("_money"),
        F.schema_of_variant("_own").alias("_own_kind"), F.try_variant_get("_own", "$", "bigint").alias("_own_seq"))
    number = _is_number(F.col("_amount_kind"))
    amount_ok = F.col("_amount").isNotNull() & number if amount == "strict" else F.col("_amount").isNotNull()
    own = F.col("_own_seq")
    bad_seq = F.col("_own").isNotNull() & (F.col("_own_kind") != "VOID") & ~F.coalesce((own >= 0) & (own < MAX_SEQ), F.lit(False))
    bad_id = F.col("_id_text").try_cast(cid_type).isNull() if cid_type else F.lit(False)
    reason = (F.when(F.col("value").isNull() | (F.col("value") == ""), F.lit(REASON_NO_BODY))
              .when(F.col("_bad_json"), F.lit(REASON_BAD_JSON))
              .when(~F.col("_is_object") | _falsy_json("_id") | _falsy_json("_status") | ~amount_ok,
                    F.lit(REASON_STRICT if amount == "strict" else REASON_LENIENT))
              .when(number & F.col("_money").isNull(), F.lit(REASON_AMOUNT))
              .when(bad_seq, F.lit(REASON_SEQ)).when(bad_id, F.lit(REASON_ID)))
    staged = values.select(
        "value", reason.alias("reason"), F.col("_id_text").alias("contract_id"), F.col("_status_text").alias("new_status"),
        F.col("_money").alias("amount"),
        F.coalesce(F.col("_ts"), _parse_ts(F.col("_ts_text")), F.lit(now).cast("timestamp_ntz")).alias("ts"),
        F.coalesce(F.col("_seq"),
                   F.pmod(F.xxhash64(F.lit(source), F.lit(now or ""), "value", "_place"), F.lit(MAX_SEQ))).alias("seq"))
    body = F.when(F.col("reason").isNotNull(), F.col("value")).alias("value")
    return staged.select(F.inline(F.array(F.struct(body, *[c for c in staged.columns if c != "value"]))))


def split_commands(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of ``check_commands``."""
    return (checked.where(F.col("reason").isNull()).select("contract_id", "new_status", "amount", "ts", "seq"),
            checked.where(F.col("reason").isNotNull()).select("value", "reason"))


def validate_commands(raw: DataFrame, amount: str = "strict", now: str | None = None, cid_type: str | None = None,
                      source: str = ""):
    """M9: raw request bodies (column ``value``; optional ``ts``/``seq``) ->
    (valid, rejected).

    valid: (contract_id string, new_status, amount decimal(18,6), ts, seq).
    rejected: (value, reason). ``strict`` (relational handler): id key
    ``soulContractId`` and amount must be a JSON number. ``lenient`` (key-value
    handler): id key ``soulId`` and amount merely present (a string or JSON
    null passes). A body may carry ``ts`` (ISO ms text); otherwise ``now``.

    ``seq`` is the request's place in its source: the column ``seq`` of ``raw``,
    or the number of the origin columns that ``read_commands`` adds. A frame
    with neither has no places; there a hash of (``source``, ``now``, body,
    place of the row in ``raw``) stands in: every request is one of its own,
    also if bodies repeat, and the same batch with the same ``now`` gives the
    same numbers again. A ``seq`` inside a body identifies nothing.

    No value is changed silently: an amount outside decimal(18,6), a body's
    ``seq`` that is no number from 0 below 2^61 and, with ``cid_type``, an id
    that is no such value are rejected with a reason of their own.
    """
    return split_commands(check_commands(raw, amount, now, cid_type, source))


# ---------------------------------------------------------------- M4 / M5
def upsert_contracts(contracts: DataFrame, changes: DataFrame, key: str = "id",
                     insert: bool = True, small: bool | None = None) -> DataFrame:
    """M4: insert-or-overwrite by key. Columns present in ``changes`` overwrite
    the old values where a change row exists; other columns keep the old value
    (NULL for new keys). ``changes`` must hold one row per key.

    Written as a LEFT join (a small change set is broadcast, so the contracts
    are not shuffled); the new keys are those that a filter of the changes does
    not find among the contracts' keys (``keyset``). A full outer join would
    shuffle every contract row for every batch of changes.
    """
    types = dict(contracts.dtypes)
    upd = [c for c in changes.columns if c != key]
    ch = changes.select(F.col(key).cast(types[key]).alias("_ck"), F.lit(True).alias("_hit"),
                        *[F.col(c).cast(types[c]).alias("_n_" + c) for c in upd if c in types])
    hit = F.col("_hit").isNotNull()
    j = contracts.join(F.broadcast(ch) if small else broadcast_within(ch) if small is None else ch, F.col(key) == F.col("_ck"), "left")
    updated = j.select(*[F.when(hit, F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in upd and c != key
                         else F.col(c) for c in contracts.columns])
    if not insert:
        return updated
    fresh = fresh_rows(contracts.select(F.col(key).alias("_ck")), ch, ["_ck"], small)
    inserted = fresh.select(*[F.col("_ck").alias(c) if c == key
                              else (F.col("_n_" + c) if c in upd else F.lit(None).cast(types[c])).alias(c)
                              for c in contracts.columns])
    return updated.unionByName(inserted)


def update_contracts(contracts: DataFrame, changes: DataFrame, key: str = "id", small: bool | None = None) -> DataFrame:
    """``UPDATE ... WHERE id``: like ``upsert_contracts`` but unknown keys are ignored."""
    return upsert_contracts(contracts, changes, key, insert=False, small=small)


def append_rows(base: DataFrame, new: DataFrame, id_cols=("id",), existing=None, small: bool | None = None) -> DataFrame:
    """M5: insert; rows that already exist are not inserted again, so a replayed
    batch changes nothing. ``id_cols`` are the columns that tell a replay.
    ``existing`` (a condition) narrows the rows of ``base`` that can hold such
    rows, e.g. only command-created ones, so the check reads a pushed-down slice
    of the table, not all of it; the table's keys are filtered by the batch's
    and never shuffled (``keyset``)."""
    known = base if existing is None else base.where(existing)
    return base.unionByName(fresh_rows(known, new, id_cols, small).select(*base.columns))


# ---------------------------------------------------------------- M6 / M7
def latest_commands(commands: DataFrame, order=("ts", "seq")) -> DataFrame:
    """Per contract the command with the greatest ``order`` key (default (ts, seq))."""
    return (commands.groupBy("contract_id")
            .agg(F.max_by(F.struct("new_status", "ts"), F.struct(*order)).alias("m"))
            .select("contract_id", F.col("m.new_status").alias("new_status"), F.col("m.ts").alias("ts")))


def _new_id(kind: str, id_type: str, seq: Column) -> Column:
    """Deterministic id for a row a command creates (so a replay is a no-op):
    negative seq-derived numbers for integral ids, a hash for text ids."""
    if id_type in ("bigint", "int", "smallint"):
        return (-(seq * 2 + (1 if kind == "ledger" else 2))).cast(id_type)
    return F.sha2(F.concat_ws("|", F.lit(kind), seq.cast("string")), 256)


def _created_rows(id_type: str):
    """Rows a command can have created: negative ids for integral id columns."""
    return (F.col("id") < 0) if id_type in ("bigint", "int", "smallint") else None


def apply_commands(t: Tables, commands: DataFrame, mode: str = "upsert", with_status: bool = True,
                   with_ledger: bool = True, event_text: str = EVENT_TEXT,
                   ledger_text: str = LEDGER_TEXT) -> Tables:
    """M6/M7: the write bundle for a batch of commands (contract_id, new_status,
    amount, ts, seq): contract status + time from the latest command per id,
    and *every* command adds one event and (``with_ledger``) one ledger row.
    ``mode='upsert'`` creates unknown contracts (NULL type/location);
    ``'update_only'`` leaves contracts untouched for unknown ids."""
    cid_type = dict(t.contracts.dtypes)["id"]
    small = plan_bytes(commands) <= BROADCAST_BYTES      # asked once: every key set of the batch is narrower
    cmd = commands.withColumn("contract_id", F.col("contract_id").cast(cid_type))
    latest = latest_commands(cmd)
    changes = latest.select(F.col("contract_id").alias("id"),
                            *([F.col("new_status").alias("contract_status")] if with_status else []),
                            F.col("ts").alias("updated_at"))
    merge = upsert_contracts if mode == "upsert" else update_contracts
    contracts = merge(t.contracts, changes, small=small)
    ev_id_type = dict(t.events.dtypes)["id"]
    new_events = cmd.select(
        _new_id("event", ev_id_type, F.col("seq")).alias("id"),
        F.col("contract_id").cast(dict(t.events.dtypes)["soul_contract_id"]).alias("soul_contract_id"),
        F.col("ts").alias("event_time"),
        _template(event_text, status=F.col("new_status"), i=F.col("seq")).alias("description"))
    # a replayed row has the id, the contract and the time of the stored one: an id alone may be a hash
    events = append_rows(t.events, new_events, ("id", "soul_contract_id", "event_time"), _created_rows(ev_id_type), small)
    ledger = t.ledger
    if with_ledger:
        lg_id_type = dict(t.ledger.dtypes)["id"]
        new_ledger = cmd.select(
            _new_id("ledger", lg_id_type, F.col("seq")).alias("id"),
            F.col("contract_id").cast(dict(t.ledger.dtypes)["soul_contract_id"]).alias("soul_contract_id"),
            F.col("amount").cast(MONEY).alias("amount"),
            F.col("ts").alias("transaction_time"),
            _template(ledger_text, status=F.col("new_status")).alias("description"))
        ledger = append_rows(t.ledger, new_ledger, ("id", "soul_contract_id", "transaction_time"), _created_rows(lg_id_type), small)
    return Tables(contracts, events, ledger)


def apply_touches(t: Tables, commands: DataFrame, mode: str = "update_only") -> Tables:
    """M7: update time + one event per command, no status change, no ledger row."""
    return apply_commands(t, commands, mode=mode, with_status=False, with_ledger=False, event_text=TOUCH_TEXT)


# ---------------------------------------------------------------- M8
def _item_pk(cid: str = "contract_id") -> Column:
    from covenant.sources.items import PK_PREFIX
    return F.concat(F.lit(PK_PREFIX), F.col(cid).cast("string"))


def _update_contract_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    """The contract items of ``items`` with the attributes of ``updates`` (PK, SK and those set; one row per contract); a
    missing item is created with the key and these attributes only."""
    types, sets = dict(items.dtypes), [c for c in updates.columns if c not in ("PK", "SK")]
    upd = updates.select(F.col("PK").alias("_upk"), *[F.col(c).cast(types[c]).alias(f"_u_{c}") for c in sets])
    hit = F.col("_upk").isNotNull()
    j = items.join(broadcast_within(upd), F.col("PK") == F.col("_upk"), "left")
    updated = j.select(*[F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in items.columns])
    created = updates.select(*[(F.col(c) if c in ("PK", "SK", *sets) else F.lit(0) if c == "_seq" else F.lit(None)).cast(types[c]).alias(c)
                               for c in items.columns])
    return updated.unionByName(fresh_rows(items, created, ("PK", "SK")).select(*items.columns))


def _item_parts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract items and the others: only the former meet an update, only the latter a put."""
    from covenant.sources.items import CONTRACT_SK
    if "_seq" not in items.columns:
        items = items.withColumn("_seq", F.lit(0).cast("long"))
    is_contract = F.col("SK").eqNullSafe(F.lit(CONTRACT_SK))
    return items.where(is_contract), items.where(~is_contract)


def _apply_item_bundle(items: DataFrame, updates: DataFrame, puts: DataFrame) -> DataFrame:
    """Contract items take the attributes of ``updates``, and ``puts`` (of events and ledger rows) are stored unless the
    store holds their keys. The store's keys are asked before the puts are grouped: a batch may repeat a key."""
    from covenant.sources.items import put_items
    contracts, others = _item_parts(items)
    stored = put_items(fresh_rows(others, puts, ("PK", "SK")), whole=True)
    return _update_contract_items(contracts, updates).unionByName(others).unionByName(stored.select(*others.columns))


def _item_sk(prefix: str, kind: str) -> Column:
    """Sort key of an item that a command creates: a digest of the request's place."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(kind + "|"), F.col("seq").cast("string")), 256))


def apply_commands_items(items: DataFrame, commands: DataFrame) -> DataFrame:
    """M8: the key-value form of the bundle. The contract item gets an Update
    (SET contract_status, updated_at; a missing item is created holding only the
    key and those two attributes, so it is absent from both indexes); event and
    ledger items are Puts keyed by a suffix that follows from the request's place."""
    from covenant.sources.items import CONTRACT_SK, EVENT_PREFIX, LEDGER_PREFIX, _conform
    updates = latest_commands(commands).select(
        _item_pk().alias("PK"), F.lit(CONTRACT_SK).alias("SK"), F.col("new_status").alias("contract_status"), iso_ms("ts").alias("updated_at"))
    ev = commands.select(_item_pk().alias("PK"), _item_sk(EVENT_PREFIX, "event").alias("SK"), iso_ms("ts").alias("event_time"),
                         _template(EVENT_TEXT, status=F.col("new_status")).alias("description"), F.col("seq").alias("_seq"))
    lg = commands.select(_item_pk().alias("PK"), _item_sk(LEDGER_PREFIX, "ledger").alias("SK"),
                         F.col("amount").cast(MONEY).alias("amount"), iso_ms("ts").alias("transaction_time"),
                         _template(ITEM_LEDGER_TEXT, status=F.col("new_status")).alias("description"), F.col("seq").alias("_seq"))
    return _apply_item_bundle(items, updates, _conform(ev.unionByName(lg, allowMissingColumns=True)))


def apply_demo_items(items: DataFrame, commands: DataFrame) -> DataFrame:
    """M8, the demo's write: the Update sets ``status`` (what the readers and the
    location index use) and ``updated_at``; the event and the ledger item are keyed
    by the time itself, so two commands of one contract in the same millisecond
    share a key and the later one (greater ``seq``) stands, as a put does."""
    from covenant.sources.items import CONTRACT_SK, EVENT_PREFIX, LEDGER_PREFIX, _conform
    updates = latest_commands(commands).select(_item_pk().alias("PK"), F.lit(CONTRACT_SK).alias("SK"), F.col("new_status").alias("status"),
                                               iso_ms("ts").alias("updated_at"))
    at = iso_ms("ts")
    ev = commands.select(_item_pk().alias("PK"), F.concat(F.lit(EVENT_PREFIX), at).alias("SK"), at.alias("timestamp"),
                         _template(EVENT_TEXT, status=F.col("new_status")).alias("description"), F.col("seq").alias("_seq"))
    lg = commands.select(_item_pk().alias("PK"), F.concat(F.lit(LEDGER_PREFIX), at).alias("SK"), F.col("amount").cast(MONEY).alias("amount"),
                         F.lit(DEMO_TRANSACTION).alias("transaction_type"), at.alias("timestamp"), F.col("seq").alias("_seq"))
    return _put_item_bundle(items, updates, _conform(ev.unionByName(lg, allowMissingColumns=True)), (EVENT_PREFIX, LEDGER_PREFIX))


def apply_touches_items(items: DataFrame, commands: DataFrame) -> DataFrame:
    """M7, item form: the Update sets ``updated_at`` alone; one event item per
    command, keyed by its time (a put: see ``apply_demo_items``)."""
    from covenant.sources.items import CONTRACT_SK, EVENT_PREFIX, _conform
    updates = latest_commands(commands).select(_item_pk().alias("PK"), F.lit(CONTRACT_SK).alias("SK"), iso_ms("ts").alias("updated_at"))
    at = iso_ms("ts")
    ev = commands.select(_item_pk().alias("PK"), F.concat(F.lit(EVENT_PREFIX), at).alias("SK"), at.alias("timestamp"),
                         _template(TOUCH_TEXT, i=F.col("seq")).alias("description"), F.col("seq").alias("_seq"))
    return _put_item_bundle(items, updates, _conform(ev), (EVENT_PREFIX,))


def _put_item_bundle(items: DataFrame, updates: DataFrame, puts: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Like ``_apply_item_bundle``, but a put replaces the item that the store holds under its key: the stored items with
    a key of the batch go, the batch's items come. ``prefixes``: those of the puts' sort keys; stored items of another kind
    have none of the keys and pass by."""
    from covenant.sources.items import put_items
    contracts, others = _item_parts(items)
    kind = F.lit(False)
    for p in prefixes:
        kind = kind | F.coalesce(F.col("SK").startswith(p), F.lit(False))
    kept = rows_without(others.where(kind), puts.where("PK is not null and SK is not null"), ("PK", "SK"))
    return (_update_contract_items(contracts, updates).unionByName(others.where(~kind)).unionByName(kept)
            .unionByName(put_items(puts, whole=True).select(*others.columns)))
