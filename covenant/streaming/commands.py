"""Apply a stream of command requests to the store.

readStream.text -> foreachBatch: validate (M9), derive the bundle's new rows
(M6) and write them as the batch's deltas with a commit marker last. The
checkpoint makes the source offsets exactly-once; a batch id of this query that
already has its commit marker is skipped and an uncommitted one is rewritten in
full, so a lost executor or a restarted query cannot double-apply a command.
Batches are keyed by query (the id in the checkpoint) and batch id: a second
stream or a new checkpoint on the same store loses none. A request is known by
its place in the source, so its rows have the same ids in a stream and in a batch.
Contract ids are text, as requests carry them, unless ``cid_type`` says otherwise:
then an id that is no such value is rejected when it comes in.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covenant.operators.mutations import (EVENT_TEXT, LEDGER_TEXT, _new_id, _template, check_commands, split_commands, upsert_contracts,
                                           update_contracts, validate_commands)
from covenant.sources.binding import Tables
from covenant.sources.commands import OFFSET_BITS, ORIGIN, read_commands, with_places
from covenant.sources.schemas import MONEY
from covenant.sources.store import BATCH_SOURCE, is_committed, write_batch


def bundle_rows(valid: DataFrame, id_type: str = "bigint", cid_type: str | None = None):
    """New event and ledger rows of a batch of valid commands."""
    cmd = valid.withColumn("contract_id", F.col("contract_id").cast(cid_type or "string"))
    ev = cmd.select(_new_id("event", id_type, F.col("seq")).alias("id"),
                    F.col("contract_id").alias("soul_contract_id"), F.col("ts").alias("event_time"),
                    _template(EVENT_TEXT, status=F.col("new_status")).alias("description"))
    lg = cmd.select(_new_id("ledger", id_type, F.col("seq")).alias("id"),
                    F.col("contract_id").alias("soul_contract_id"), F.col("amount").cast(MONEY).alias("amount"),
                    F.col("ts").alias("transaction_time"),
                    _template(LEDGER_TEXT, status=F.col("new_status")).alias("description"))
    return ev, lg


def commit_commands(spark: SparkSession, store: str, batch_id: int, raw: DataFrame, amount: str = "strict",
                    id_type: str = "bigint", cid_type: str | None = None, now: str | None = None,
                    source: str = BATCH_SOURCE) -> None:
    """Apply one batch of raw request bodies to a stored store: validate, derive
    the bundle's rows, write them as the deltas of batch ``batch_id`` of ``source``
    and commit it (the atomic unit is the batch). A batch of that source and id
    that is already committed is skipped: its first committed content stands and readers never see it
    rewritten. Used by the stream for every micro-batch and usable on its own
    for batch jobs."""
    if is_committed(spark, store, batch_id, source):
        return
    stamp = now or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    if "seq" not in raw.columns and set(ORIGIN) <= set(raw.columns):
        raw = with_places(raw)
    if "seq" in raw.columns:        # a batch of few files is few tasks: its requests, known by their places, go to all cores
        raw = raw.repartition(spark.sparkContext.defaultParallelism, "seq")
    checked = check_commands(raw, amount, stamp, cid_type, f"{source} {batch_id}").persist()    # each body is checked once
    try:
        valid, rejected = split_commands(checked)
        ev, lg = bundle_rows(valid, id_type, cid_type)
        write_batch(spark, store, batch_id, valid, ev, lg, rejected, source)
    finally:
        checked.unpersist()


def apply_commands_stream(spark: SparkSession, source: str, store: str, checkpoint: str,
                          amount: str = "strict", id_type: str = "bigint", cid_type: str | None = None,
                          available_now: bool = True, now: str | None = None,
                          max_files_per_trigger: int | None = None, source_format: str = "text",
                          source_options: dict | None = None, source_schema: str | None = None) -> StreamingQuery:
    """Run the applier over ``source`` (a folder of text bodies by default, or any
    stream source given by ``source_format``/``source_options``, e.g. kafka)."""
    raw = read_commands(spark, source, streaming=True, max_files_per_trigger=max_files_per_trigger,
                        format=source_format, options=source_options, schema=source_schema)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # like the handler's NOW(): one processing time for the whole batch; a
        # replayed batch id rewrites its own folders, so the state stays whole
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        commit_commands(batch.sparkSession, store, batch_id, batch, amount, id_type, cid_type, now, query)

    w = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ---------------------------------------------------------------- latest state per contract
def latest_state_stream(spark: SparkSession, source: str, checkpoint: str, changes: str | None = None, amount: str = "strict",
                        available_now: bool = True, max_files_per_trigger: int | None = None, source_format: str = "parquet",
                        source_options: dict | None = None, source_schema: str | None = None) -> StreamingQuery:
    """Keep the latest command of every contract as the keyed state of a streaming aggregation: the greatest (ts, place)
    wins, so neither a late command nor the order of batches overwrites a later one, and a restart loses none.

    The source has to name its places (a message log with partition and offset): text lines have no number inside a
    stream. ``changes``: a folder to which each batch's changed contracts are written (``batch_id=<b>``, replaced whole if
    the batch is repeated). The state holds one row per contract that commands name, whatever the length of the log.
    """
    raw = read_commands(spark, source, streaming=True, max_files_per_trigger=max_files_per_trigger, format=source_format,
                        options=source_options, schema=source_schema)
    place = F.shiftleft(F.coalesce("origin_partition", F.lit(0)), OFFSET_BITS) + F.col("origin_offset")
    valid, _ = validate_commands(raw.select("value", place.alias("seq")), amount=amount)
    latest = valid.groupBy("contract_id").agg(F.max(F.struct("ts", "seq", "new_status")).alias("latest"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("contract_id", "latest.new_status", "latest.ts", "latest.seq")
        if changes:
            rows.write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")
        else:
            rows.write.format("noop").mode("overwrite").save()

    w = latest.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(contract_id, new_status, ts, seq): the state of ``latest_state_stream`` as of its last finished batch, read from
    the state store itself."""
    state = spark.read.format("statestore").load(checkpoint)
    latest = F.col("value").getField(state.schema["value"].dataType.fields[0].name)
    return state.select(F.col("key").getField("contract_id").alias("contract_id"), latest["new_status"].alias("new_status"),
                        latest["ts"].alias("ts"), latest["seq"].alias("seq"))


def contracts_with_state(t: Tables, state: DataFrame, mode: str = "upsert") -> DataFrame:
    """The contracts of ``t`` with the status and time of ``state``; ids that are none of the store's type are left out."""
    cid_type = dict(t.contracts.dtypes)["id"]
    changes = state.select(F.col("contract_id").try_cast(cid_type).alias("id"), F.col("new_status").alias("contract_status"),
                           F.col("ts").alias("updated_at")).where("id is not null")
    return (upsert_contracts if mode == "upsert" else update_contracts)(t.contracts, changes)
