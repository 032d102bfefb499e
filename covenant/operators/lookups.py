"""Key lookups and id selection over the normalized store.

Point and batch lookups are filters that Catalyst pushes into the parquet scan
(row-group min/max skipping); a batch of ids is a semi join whose small side
Spark broadcasts only under its size threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from covenant.operators.positional import prefix_sums

# id lists up to this length become an IN-list literal (pushed to parquet);
# longer lists go through a DataFrame and a semi join.
ISIN_MAX = 1000


def lookup_status(contracts: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Contracts with a status, ordered by id, optionally the first ``limit``."""
    df = contracts.where(F.col("contract_status") == status).orderBy("id")
    return df.limit(limit) if limit is not None else df


def point_get(df: DataFrame, key: dict) -> DataFrame:
    """0 or 1 row by full key equality."""
    cond = None
    for k, v in key.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df.where(cond)


def batch_get(contracts: DataFrame, ids, id_col: str = "id") -> DataFrame:
    """Contracts for a set of ids; missing ids are dropped, repeats give one row.

    ``ids`` is a DataFrame with an ``id`` column or a Python list.
    """
    if isinstance(ids, DataFrame):
        return contracts.join(ids.select(F.col(ids.columns[0]).alias("_bid")),
                              F.col(id_col) == F.col("_bid"), "left_semi")
    ids = list(dict.fromkeys(ids))
    if len(ids) <= ISIN_MAX:
        return contracts.where(F.col(id_col).isin(ids))
    spark = contracts.sparkSession
    return batch_get(contracts, spark.createDataFrame([(i,) for i in ids], ["_bid"]), id_col)


def resolve_ids(contracts: DataFrame, ids: Sequence | None = None, sample_size: int = 25) -> DataFrame:
    """An explicit list de-duplicated in first-seen order, else the first
    ``sample_size`` contract ids. Returns (pos, id)."""
    if ids:
        spark = contracts.sparkSession
        seen = list(dict.fromkeys(ids))
        return spark.createDataFrame(list(enumerate(seen)), ["pos", "id"])
    first = contracts.select("id").orderBy("id").limit(sample_size)
    return first.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("pos"), "id")


def first_seen_ids(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """X1 over a table: the different ids of ``rows``, numbered from 0 in the order they are first seen (``order`` is a
    unique column). One row per id; the numbering is a distributed running count."""
    first = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(order).alias("_first"))
    return prefix_sums(first, ["_first"], {"_nth": F.lit(1).cast("long")}).select((F.col("_nth") - 1).alias("pos"), "id")


def sample_common_id(left: DataFrame, right: DataFrame, status: str = "Bound",
                     candidates: int = 10) -> DataFrame:
    """The first of up to ``candidates`` ``status`` contracts of ``left`` that also
    exists in ``right``; else the first candidate. One row (id).

    The candidates (at most ``candidates`` ids, a top-k) are probed in ``right``
    with a pushed-down ``IN`` filter, like the original's point lookups; the
    other store is never shuffled to test ten ids.
    """
    cand = left.where(F.col("contract_status") == status).select("id").orderBy("id").limit(candidates)
    ids = [r[0] for r in cand.collect()]
    cand_df = left.sparkSession.createDataFrame([(i,) for i in ids], f"id {dict(left.dtypes)['id']}")
    present = batch_get(right.select("id"), ids).select(F.col("id").alias("_rid")).distinct()
    j = cand_df.join(present, F.col("id") == F.col("_rid"), "left")
    return j.agg(F.min_by("id", F.struct(F.col("_rid").isNull(), F.col("id"))).alias("id")) \
        .where(F.col("id").isNotNull())


def lookup_by_date(rows: DataFrame, time_col: str, day: str) -> DataFrame:
    """Rows of one calendar day as a half-open time range (pushed to parquet)."""
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    cond = (F.col(time_col) >= start) & (F.col(time_col) < end)
    day_col = time_col + "_date"
    if day_col in rows.columns:
        # a store written with day partitions: prune to one partition folder
        cond = cond & (F.col(day_col) == F.lit(day).cast("date"))
    return rows.where(cond).orderBy(time_col, "id")


def missing_in_other(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Left rows whose key is absent on the right."""
    return left.join(right.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def structure_sample(df: DataFrame, key, n: int = 3) -> DataFrame:
    """The first ``n`` rows by key (a structure probe; the limit is the feature).
    ``key`` is a column name or a list of them."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


_V1_SOURCES = "spark.sql.sources.useV1SourceList"


def read_v2(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A file table through Spark's v2 reader, which answers count, min and max of a whole table from the files' footers
    (with ``spark.sql.parquet.aggregatePushdown``, a session default of this library; without it the count is a scan)."""
    old = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_V1_SOURCES, ",".join(x for x in old.split(",") if x.strip() != fmt))
    try:
        return spark.read.format(fmt).load(path)      # the reader is chosen here
    finally:
        spark.conf.set(_V1_SOURCES, old)


def table_inventory(spark: SparkSession, base: str, expected: Iterable[str],
                    fmt: str = "parquet", suffix: str = ".parquet") -> DataFrame:
    """Per expected table: present?, row count (NULL when absent).

    Presence is decided by trying to resolve the table's path; the count of a
    present table comes from its files' footers; the result has one row per name.
    """
    parts = []
    for name in expected:
        try:
            df = read_v2(spark, f"{base}/{name}{suffix}", fmt)
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), F.lit(True).alias("present"), "row_count"))
        except AnalysisException:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(False).alias("present"),
                                               F.lit(None).cast("long").alias("row_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def readiness(inventory: DataFrame) -> DataFrame:
    """V5: a store is ready when all expected tables exist, or none does (first run)."""
    return inventory.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count(F.when(F.col("present"), 1)).alias("present"),
        F.sum(F.coalesce(F.col("row_count"), F.lit(0))).cast("long").alias("total_rows"),
    ).withColumn("ready", (F.col("present") == F.col("expected")) | (F.col("present") == 0))


def missing_tables(inventory: DataFrame) -> DataFrame:
    """Expected table names minus the present ones."""
    return inventory.where(~F.col("present")).select("table_name")


def store_inventory(tables: dict, expected) -> DataFrame:
    """A12 over a store held as DataFrames: ``tables`` maps names to DataFrames
    (or None when absent); one row per expected name with presence and count."""
    present = {k: v for k, v in tables.items() if v is not None}
    if not present:
        raise ValueError("at least one table is needed to build the inventory")
    spark = next(iter(present.values())).sparkSession
    parts = []
    for name in expected:
        df = present.get(name)
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(False).alias("present"),
                                               F.lit(None).cast("long").alias("row_count")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), F.lit(True).alias("present"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
