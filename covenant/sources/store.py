"""Publishing store state to files (M10, M11) and the log-structured command store.

Snapshot layout: ``<base>/v=<version>/<table>/`` then ``<base>/manifest/n=<k>/``
(one row: the version) written last and never again: the entry of greatest ``k``
is the published version, so a reader never sees a half-written one. ``maxRecordsPerFile`` bounds file sizes (the
reference's 25-item / 3000-row write batches).

Delta layout (for streams of commands): each micro-batch ``b`` of a source
(a streaming query, known by the id in its checkpoint) writes
``<base>/<table>_delta/source=<source>/batch_id=b/`` (overwriting only that
folder, so a replay of ``b`` is idempotent) and then
``<base>/commits/source=<source>/batch_id=b/``. Readers only see committed
batches; state is base + all committed deltas, whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from covenant.operators.mutations import latest_commands, upsert_contracts
from covenant.sources.binding import Tables

TARGETS = ("items", "normalized")


def resolve_targets(target: str | None = None, normalized_only: bool = False, items_only: bool = False,
                    skip_normalized: bool = False, skip_items: bool = False) -> set[str]:
    """Which shapes a write goes to. Precedence: the named ``target``
    ('items' or 'normalized'), then the *only* switches, then the *skip*
    switches (a skip always wins). No switch: both shapes."""
    out = set(TARGETS)
    t = (target or "").lower()
    if t in TARGETS:
        out = {t}
    if normalized_only:
        out = {"normalized"}
    if items_only:
        out = {"items"}
    if skip_normalized:
        out.discard("normalized")
    if skip_items:
        out.discard("items")
    return out


DAY_SUFFIX = "_date"
POINT_KEYS = {"contracts": ("id",), "events": ("id", "soul_contract_id"), "ledger": ("id", "soul_contract_id"), "items": ("PK",)}
TIME_COLS = {"events": "event_time", "ledger": "transaction_time"}


def write_store(spark: SparkSession, base: str, version: int, tables: Tables | None = None,
                items: DataFrame | None = None, targets: Iterable[str] = TARGETS,
                max_records_per_file: int | None = None, cluster: bool = False,
                partition_by_day: bool = False, num_partitions: int | None = None, point_keys: int | None = None) -> str:
    """Write the selected targets as version ``version`` and publish it.

    ``cluster``: contracts range-partitioned by id, events/ledger (and items)
    range-partitioned and sorted by (contract, time), so the parquet min/max
    statistics let a one-contract lookup skip almost every row group (the
    file-level form of the item store's per-contract co-location).
    ``partition_by_day``: events/ledger get a ``<time>_date`` partition column
    that ``lookup_by_date`` prunes on.
    """
    targets = set(targets)
    root = f"{base}/v={version}"
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def w(df, name, key=None, time=None):
        if partition_by_day and time:
            df = df.withColumn(time + DAY_SUFFIX, F.to_date(time))
        if cluster and key:
            order = [key] + ([time] if time else [])
            df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        wr = df.write.mode("overwrite")
        if max_records_per_file:
            wr = wr.option("maxRecordsPerFile", int(max_records_per_file))
        for column in POINT_KEYS[name] if point_keys else ():
            wr = wr.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{column}", int(point_keys))
        if partition_by_day and time:
            wr = wr.partitionBy(time + DAY_SUFFIX)
        wr.parquet(f"{root}/{name}")

    if "normalized" in targets and tables is not None:
        w(tables.contracts, "contracts", "id")
        w(tables.events, "events", "soul_contract_id", "event_time")
        w(tables.ledger, "ledger", "soul_contract_id", "transaction_time")
    if "items" in targets and items is not None:
        w(items, "items", "PK", None)
    last = _manifest(spark, base)
    (spark.range(1).select(F.lit(version).cast("long").alias("version"))
     .write.mode("error").parquet(f"{base}/manifest/n={0 if last is None else last['n'] + 1}"))
    return root


def _manifest(spark: SparkSession, base: str):
    """The last entry (n, version) of a store's manifest, or None."""
    try:
        return spark.read.parquet(f"{base}/manifest").orderBy(F.desc("n")).first()
    except AnalysisException:
        return None


def current_version(spark: SparkSession, base: str) -> int | None:
    """The published version of a snapshot store (from its manifest), or None."""
    row = _manifest(spark, base)
    return None if row is None else int(row["version"])


def read_store(spark: SparkSession, base: str) -> Tables:
    """The tables of the published version of a snapshot store."""
    v = current_version(spark, base)
    if v is None:
        raise FileNotFoundError(f"no published version under {base}")
    root = f"{base}/v={v}"
    return Tables(*(spark.read.parquet(f"{root}/{n}") for n in ("contracts", "events", "ledger")))


# ---------------------------------------------------------------- command deltas
BATCH_SOURCE = "batch"      # the source of batches that no streaming query numbers


def _folder(source: str, batch_id: int) -> str:
    return f"source={source}/batch_id={batch_id}"


def is_committed(spark: SparkSession, base: str, batch_id: int, source: str = BATCH_SOURCE) -> bool:
    """Whether batch ``batch_id`` of ``source`` already has its commit marker."""
    try:
        spark.read.parquet(f"{base}/commits/{_folder(source, batch_id)}")
        return True
    except AnalysisException:
        return False


def write_batch(spark: SparkSession, base: str, batch_id: int, commands: DataFrame,
                new_events: DataFrame, new_ledger: DataFrame, rejected: DataFrame, source: str = BATCH_SOURCE) -> None:
    """Write one micro-batch's deltas, then its commit marker (idempotent per source and batch id)."""
    for name, df in (("commands", commands), ("events", new_events), ("ledger", new_ledger),
                     ("rejects", rejected)):
        df.write.mode("overwrite").parquet(f"{base}/{name}_delta/{_folder(source, batch_id)}")
    # the marker holds only a flag: source and batch_id are the partition folders' values
    (spark.range(1).select(F.lit(True).alias("committed"))
     .write.mode("overwrite").parquet(f"{base}/commits/{_folder(source, batch_id)}"))


def _committed(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """Rows of all committed batches (with their ``source`` and ``batch_id``)."""
    try:
        commits = spark.read.parquet(f"{base}/commits").select("source", "batch_id")
        delta = spark.read.parquet(f"{base}/{name}_delta")
    except AnalysisException:
        return None
    return delta.join(commits, ["source", "batch_id"], "left_semi")


def _as_store(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Delta rows in the columns and types of a store's table; rows whose contract id is none of the store's type go
    (``rejected_commands`` returns their requests)."""
    types = dict(table.dtypes)
    rows = rows.withColumn(key, F.col(key).try_cast(types[key]))
    return rows.where(F.col(key).isNotNull()).select(*[F.col(c).cast(types[c]).alias(c) for c in table.columns])


def read_with_deltas(spark: SparkSession, base_tables: Tables, base: str, mode: str = "upsert") -> Tables:
    """Merge-on-read: ``base_tables`` plus the command deltas of all committed
    batches. Per contract the command with the greatest (ts, seq) wins, as in
    the batch bundle, so neither sources nor the order of batches can hide one.
    """
    from covenant.operators.mutations import update_contracts
    cmds = _committed(spark, base, "commands")
    if cmds is None:
        return base_tables
    cid_type = dict(base_tables.contracts.dtypes)["id"]
    cmds = cmds.withColumn("contract_id", F.col("contract_id").try_cast(cid_type)).where("contract_id is not null")
    latest = latest_commands(cmds)
    changes = latest.select(F.col("contract_id").alias("id"), F.col("new_status").alias("contract_status"),
                            F.col("ts").alias("updated_at"))
    merge = upsert_contracts if mode == "upsert" else update_contracts
    contracts = merge(base_tables.contracts, changes)
    events = base_tables.events.unionByName(_as_store(_committed(spark, base, "events"), base_tables.events, "soul_contract_id"))
    ledger = base_tables.ledger.unionByName(_as_store(_committed(spark, base, "ledger"), base_tables.ledger, "soul_contract_id"))
    return Tables(contracts, events, ledger)


def rejected_commands(spark: SparkSession, base: str, cid_type: str | None = None) -> DataFrame | None:
    """Rejected request bodies (value, reason) of all committed batches. With ``cid_type``, the type of a store's contract
    ids, also the requests that were taken in with an id that is no such value (their id as the value)."""
    from covenant.operators.mutations import REASON_ID
    r = _committed(spark, base, "rejects")
    if r is None:
        return None
    r = r.drop("source", "batch_id")
    if cid_type:
        unfit = _committed(spark, base, "commands").where(F.col("contract_id").try_cast(cid_type).isNull())
        r = r.unionByName(unfit.select(F.col("contract_id").cast("string").alias("value"), F.lit(REASON_ID).alias("reason")))
    return r


def write_chunked(df: DataFrame, path: str, max_records_per_file: int, mode: str = "overwrite") -> None:
    """Write with a bound on rows per output file (the reference's bounded
    write batches become bounded files; each task still writes in parallel)."""
    df.write.mode(mode).option("maxRecordsPerFile", int(max_records_per_file)).parquet(path)


# ---------------------------------------------------------------- bucketed layout
BUCKET_KEYS = {"contracts": "id", "events": "soul_contract_id", "ledger": "soul_contract_id", "items": "PK"}


def _bucket_table(base: str, name: str) -> str:
    import hashlib
    return f"covenant_{name}_{hashlib.sha1(base.encode()).hexdigest()[:10]}"


def write_bucketed_items(spark: SparkSession, items: DataFrame, base: str, buckets: int) -> DataFrame:
    """The item store bucketed and sorted by PK (one contract's items per bucket):
    the put (grouping on PK, SK) and the per-contract joins of item kinds then
    run without shuffling the item table."""
    (items.write.mode("overwrite").bucketBy(buckets, "PK").sortBy("PK", "SK")
     .option("path", f"{base}/items").saveAsTable(_bucket_table(base, "items")))
    return spark.table(_bucket_table(base, "items"))


def write_bucketed(spark: SparkSession, tables: Tables, base: str, buckets: int,
                   max_records_per_file: int | None = None) -> Tables:
    """Write the store bucketed (and sorted) by contract id, with the same bucket
    count on all three tables, as external tables of the session catalog.

    Joins of contracts with per-contract aggregates of events and ledger then
    need no shuffle at all: the aggregations run on the bucketed scans and the
    join partitions line up bucket by bucket (co-located joins).
    ``max_records_per_file`` bounds file sizes, so a hot bucket is several
    files that ``read_bucketed(..., use_buckets=False)`` scans in parallel.
    """
    for name, df in (("contracts", tables.contracts), ("events", tables.events), ("ledger", tables.ledger)):
        key = BUCKET_KEYS[name]
        w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{base}/{name}")
        if max_records_per_file:
            # a hot bucket becomes several files, which a plain read scans in parallel
            w = w.option("maxRecordsPerFile", int(max_records_per_file))
        w.saveAsTable(_bucket_table(base, name))
    return read_bucketed(spark, base, buckets)


def read_bucketed(spark: SparkSession, base: str, buckets: int, use_buckets: bool = True) -> Tables:
    """Open a bucketed store; in a new session the tables are registered again
    over their folders (schema from the files, bucketing from the arguments).

    A bucket is read by one task. When one contract holds a large share of the
    rows its bucket does too, so for such a store pass ``use_buckets=False``:
    the same files are read as plain parquet and the plan goes back to
    exchanges with map-side partial aggregation, which split a hot contract.
    """
    if not use_buckets:
        return Tables(*(spark.read.parquet(f"{base}/{n}") for n in ("contracts", "events", "ledger")))
    out = []
    for name in ("contracts", "events", "ledger"):
        table, key = _bucket_table(base, name), BUCKET_KEYS[name]
        if not spark.catalog.tableExists(table):
            schema = spark.read.parquet(f"{base}/{name}").schema
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                      f"INTO {int(buckets)} BUCKETS LOCATION '{base}/{name}'")
        out.append(spark.table(table))
    return Tables(*out)
